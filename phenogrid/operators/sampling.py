"""Reproducible samples and splits, ordered by MD5 of keys and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions.scalars import draw_order


SLOT_DIGITS = 3  # of a draw, by which rows are counted
EDGE_ROWS = 10_000  # of which the last one to be drawn is found by sorting


def _last_draw(drawn: DataFrame, fraction: float | None, count: int | None) -> str | None:
    """The draw of the last row of a sample, or None if all rows are in it.

    Rows are counted by the first digits of their draw; in the slot where
    the sample ends they are counted by further digits, until so few are
    left that sorting them tells the row.
    """
    slot, left = "", count
    while True:
        width = len(slot) + SLOT_DIGITS
        counts = {r["slot"]: r["n"] for r in drawn.where(F.col("_draw").startswith(slot)).groupBy(F.substring("_draw", 1, width).alias("slot")).agg(F.count("*").alias("n")).collect()}
        if not slot:
            total = sum(counts.values())
            left = max(1, int(total * fraction)) if left is None else left
            if left >= total:
                return None
        for name in sorted(counts):
            if left <= counts[name]:
                break
            left -= counts[name]
        slot = name
        if counts[slot] <= EDGE_ROWS or width >= 32:
            return drawn.where(F.col("_draw").startswith(slot)).select("_draw").orderBy("_draw").limit(left).agg(F.max("_draw")).first()[0]


def exact_sample(df: DataFrame, keys: list[str], fraction: float | None = None, count: int | None = None, seed: int = 42) -> DataFrame:
    """Exactly max(1, floor(n * fraction)) rows, or ``count``: those first in the draw order.

    ``keys`` identify a row.  The last draw of the sample is found by counts,
    so the sample is a filter: no task sorts or merges a share of the table.
    """
    if fraction is not None and not 0 < fraction <= 1:
        raise ValueError("fraction must be above 0 and at most 1")
    if count is not None and count < 1:
        return df.limit(0)
    draw = draw_order(*[F.col(k) for k in keys], seed=seed)
    last = _last_draw(df.select(draw.alias("_draw")), fraction, count)
    return df if last is None else df.where(draw <= F.lit(last))


def sample_by_location(df: DataFrame, location: str, fraction: float, seed: int = 42) -> DataFrame:
    """All rows of an exact sample of the locations."""
    return df.join(exact_sample(df.select(location).distinct(), [location], fraction, seed=seed), location, "left_semi")


def split(df: DataFrame, keys: list[str], val_share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, validation); rows that agree on ``keys`` stay together.  Validation has ceil(n * share) keys."""
    groups = df.select(*keys).distinct()
    n = -(-groups.count() * val_share // 1)
    held = exact_sample(groups, keys, count=int(n), seed=seed)
    return df.join(held, keys, "left_anti"), df.join(held, keys, "left_semi")


def in_boxes(lat: Column, lon: Column, boxes: list[tuple[float, float, float, float]]) -> Column:
    """Whether a point is in one of (lon_min, lat_min, lon_max, lat_max), edges included."""
    out = F.lit(False)
    for lon_min, lat_min, lon_max, lat_max in boxes:
        out = out | (lon.between(lon_min, lon_max) & lat.between(lat_min, lat_max))
    return out


def mask_regions(df: DataFrame, boxes: list[tuple[float, float, float, float]]) -> tuple[DataFrame, DataFrame]:
    """(outside, inside) of the boxes."""
    inside = in_boxes(F.col("lat"), F.col("lon"), boxes)
    return df.where(~inside), df.where(inside)


def cap_observations(presence: DataFrame, most: int, row_keys: list[str], species: str = "species", seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each species, drawn at random.

    Rows of a species are counted by the first digits of their draw.  Slots
    below the one where the species' share ends are kept whole; in that one
    rows are ranked.  So a species with most of the rows is never sorted in
    one task.
    """
    draw = draw_order(*[F.col(k) for k in row_keys], F.col(species), seed=seed)
    rows = presence.withColumn("_draw", draw).withColumn("_slot", F.substring("_draw", 1, SLOT_DIGITS))
    counts = rows.groupBy(species, "_slot").agg(F.count("*").alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(species).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = counts.withColumn("_below", below).where(f"_below < {most} and _below + _n >= {most}")
    ends = ends.select(F.col(species).alias("_species"), F.col("_slot").alias("_end"), (most - F.col("_below")).alias("_room"))
    marked = rows.join(ends, F.col(species).eqNullSafe(F.col("_species")), "left")
    kept = marked.where("_end is null or _slot < _end")
    last = marked.where("_slot = _end").withColumn("_rank", F.row_number().over(Window.partitionBy(species).orderBy("_draw", *row_keys)))
    return kept.select(*presence.columns).unionByName(last.where("_rank <= _room").select(*presence.columns))
