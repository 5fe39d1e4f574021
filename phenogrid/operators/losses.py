"""Losses of scored labels, as column expressions over logits and 0/1 targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.functions.scalars import draw_uniform, sigmoid


def bce(logit: Column, target: Column) -> Column:
    """Cross-entropy of a logit, in the form that does not overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def focal(logit: Column, target: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    p = sigmoid(logit)
    right = p * target + (1 - p) * (1 - target)
    return (alpha * target + (1 - alpha) * (1 - target)) * F.pow(1 - right, F.lit(gamma)) * bce(logit, target)


def asymmetric(logit: Column, target: Column, gamma_pos: float = 0.0, gamma_neg: float = 2.0, clip: float = 0.05) -> Column:
    """Negatives are shifted by a margin and focused on their own."""
    p = sigmoid(logit)
    q = F.greatest(p - clip, F.lit(0.0))
    eps = F.lit(1e-8)
    pos = target * F.ln(F.greatest(p, eps)) * F.pow(1 - p, F.lit(gamma_pos))
    neg = (1 - target) * F.ln(F.greatest(1 - q, eps)) * F.pow(q, F.lit(gamma_neg))
    return -(pos + neg)


def assume_negative(scored: DataFrame, by: str, positive_weight: float = 4.0, smoothing: float = 0.0, negatives: int = 0, idx: str | None = None, seed: int = 42) -> DataFrame:
    """Per sample: weighted positive loss plus the loss of all others, over the number of species; then the mean.

    With ``negatives``, so many species of each sample are drawn, with
    repeats, and the loss of those that are negative stands for that of all
    negatives, scaled up to their number.  ``idx`` then numbers a sample's
    species from 0.  Draws go by the MD5 of sample, turn and seed, so they
    are alike in every run and engine.  A sample with no more species than
    draws is taken whole.
    """
    held = F.greatest(F.lit(smoothing), F.least(F.lit(1 - smoothing), F.col("target")))
    rows = scored.withColumn("_loss", bce(F.col("logit"), held)).withColumn("_pos", F.col("target") > 0.5)
    per = rows.groupBy(by).agg(F.sum(F.when(F.col("_pos"), F.col("_loss")).otherwise(0.0)).alias("pos"), F.sum(F.when(~F.col("_pos"), F.col("_loss")).otherwise(0.0)).alias("neg"), F.count("*").alias("n"), F.count_if(~F.col("_pos")).alias("n_neg"))
    if negatives > 0:
        turns = per.where(F.col("n") > negatives).select(by, "n", F.explode(F.sequence(F.lit(0), F.lit(negatives - 1))).alias("turn"))
        drawn = turns.select(by, F.floor(draw_uniform(F.col(by), F.col("turn"), seed=seed) * F.col("n")).alias("_idx"))
        found = drawn.join(rows.select(by, F.col(idx).alias("_idx"), "_loss", "_pos"), [by, "_idx"])
        some = found.where(~F.col("_pos")).groupBy(by).agg(F.sum("_loss").alias("_some"), F.count("*").alias("_drawn"))
        scaled = F.coalesce(F.col("_some") * F.col("n_neg") / F.greatest(F.col("_drawn"), F.lit(1)), F.lit(0.0))
        per = per.join(some, by, "left").withColumn("neg", F.when(F.col("n") > negatives, scaled).otherwise(F.col("neg")))
    return per.agg(F.avg((positive_weight * F.col("pos") + F.col("neg")) / F.col("n")).alias("an_loss"))


def masked_mse(pred: Column, target: Column, bound: float = 1e4) -> Column:
    """Aggregate: mean squared error where there is a target, 0 without any."""
    held = F.least(F.greatest(pred, F.lit(-bound)), F.lit(bound))
    return F.coalesce(F.avg(F.pow(held - target, 2)), F.lit(0.0))


def class_weight(n_pos: Column, n_neg: Column, smoothing: float, most: float | None = None) -> Column:
    w = (n_neg + smoothing) / (n_pos + smoothing)
    return F.least(w, F.lit(most)) if most is not None else w
