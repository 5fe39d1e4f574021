"""Scalars of the model side: encodings, squashing, weights."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from phenogrid.functions.calendar import WEEKS


def circular_encoding(theta: Column, harmonics: int) -> Column:
    """Sines of the first multiples of an angle, then their cosines."""
    ks = F.sequence(F.lit(1), F.lit(harmonics))
    return F.concat(F.transform(ks, lambda k: F.sin(k * theta)), F.transform(ks, lambda k: F.cos(k * theta)))


def week_angle(week: Column) -> Column:
    return 2 * math.pi * (week - 1) / WEEKS


def sigmoid(logit: Column, bound: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-F.least(F.lit(bound), F.greatest(F.lit(-bound), logit))))


def gate_mix(gate: Column, direct: Column, habitat: Column) -> Column:
    return gate * direct + (1 - gate) * habitat


def percentile_weight(pct: Column, low: float, high: float, least: float) -> Column:
    """``least`` up to percentile ``low``, 1 from ``high``, linear between; all ``least`` if high <= low."""
    if high <= low:
        return F.when(pct.isNotNull(), F.lit(least))
    return F.when(pct >= high, F.lit(1.0)).when(pct > low, least + (pct - low) / (high - low) * (1 - least)).when(pct.isNotNull(), F.lit(least))


def draw_order(*keys: Column, seed: int = 42) -> Column:
    """A reproducible random order: the MD5 of keys and seed, alike in every engine."""
    return F.md5(F.concat_ws("|", *[k.cast("string") for k in keys], F.lit(str(seed))))


def draw_uniform(*keys: Column, seed: int = 42) -> Column:
    """A reproducible uniform number in [0, 1)."""
    return F.conv(F.substring(draw_order(*keys, seed=seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def symmetric_ratio(r: Column) -> Column:
    return F.least(r, 1 / F.greatest(r, F.lit(1e-8)))
