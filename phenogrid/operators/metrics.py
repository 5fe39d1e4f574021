"""Evaluation of scored labels in long form: sample, species, prob, label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions.scalars import symmetric_ratio
from phenogrid.operators.totals import quantiles, running_total, running_totals

THRESHOLDS = (0.05, 0.10, 0.25)
# Components of the composite score and their weights.
SCORE_WEIGHTS = {"map": 0.20, "f1_10": 0.20, "list_ratio_10": 0.15, "watchlist_mean_ap": 0.10, "holdout_map": 0.10, "map_density_ratio": 0.20, "pred_density_corr": 0.05}


def average_precision(scored: DataFrame, by: str, tie: str) -> DataFrame:
    """Average precision of each group with a positive: precision at each hit, averaged.

    Ranks and hits so far are running totals by ranges of the score, so that
    a group with most of the rows is ranked by many tasks.
    """
    rows = scored.withColumn("_down", -F.col("prob")).withColumn("_hit", F.col("label").cast("int"))
    ranked = running_totals(rows, "_down", [tie], {"rank": F.lit(1), "hits": F.col("_hit")}, (by,))
    hit = F.col("_hit")
    return ranked.groupBy(by).agg(F.sum(hit).cast("long").alias("n_pos"), F.sum(hit * F.col("hits") / F.col("rank")).alias("_sum")).where("n_pos > 0").select(by, "n_pos", (F.col("_sum") / F.col("n_pos")).alias("ap"))


def topk_recall(scored: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    """Hits among the k best of each sample over all positives, of samples with positives."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("prob"), tie)))
    per = ranked.groupBy(by).agg(F.count_if(F.col("label") & (F.col("rank") <= k)).alias("hits"), F.count_if("label").alias("pos"), F.count("*").alias("n"))
    hits = F.sum(F.when((F.col("pos") > 0) & (F.col("n") >= k), F.col("hits")).otherwise(0))
    return per.agg((hits / F.greatest(F.sum("pos"), F.lit(1))).alias("recall")).select(F.lit(k).alias("k"), "recall")


def confusion(scored: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Micro precision, recall and F1 of ``prob`` above each threshold, in one pass over the rows."""
    rows = scored.withColumn("t", F.explode(F.array(*map(F.lit, thresholds)))).withColumn("hit", F.col("prob") > F.col("t"))
    n = rows.groupBy("t").agg(F.count_if(F.col("hit") & F.col("label")).alias("tp"), F.count_if(F.col("hit") & ~F.col("label")).alias("fp"), F.count_if(~F.col("hit") & F.col("label")).alias("fn"))
    n = n.withColumn("precision", F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))).withColumn("recall", F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)))
    return n.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-8)))


def list_ratio(scored: DataFrame, by: str, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Mean predicted over true list length (samples with positives), and mean predicted length (all)."""
    rows = scored.withColumn("t", F.explode(F.array(*map(F.lit, thresholds))))
    per = rows.groupBy("t", by).agg(F.count_if(F.col("prob") > F.col("t")).alias("pred"), F.count_if("label").alias("pos"))
    ratio = F.avg(F.when(F.col("pos") > 0, F.col("pred") / F.col("pos")))
    return per.groupBy("t").agg(F.coalesce(ratio, F.lit(0.0)).alias("list_ratio"), F.avg("pred").alias("mean_list_len"))


def density_stratified(ap: DataFrame, density: str = "obs_density") -> DataFrame:
    """Mean AP of the quarter of samples with the lowest and highest density, and their ratio."""
    cuts = quantiles(ap, density, {"q25": 0.25, "q75": 0.75})
    out = ap.crossJoin(F.broadcast(cuts)).agg(F.avg(F.when(F.col(density) <= F.col("q25"), F.col("ap"))).alias("map_sparse"), F.avg(F.when(F.col(density) >= F.col("q75"), F.col("ap"))).alias("map_dense"))
    return out.withColumn("map_density_ratio", F.when(F.col("map_dense") > 0, F.col("map_sparse") / F.col("map_dense")))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with mean ranks for ties; 0 for fewer than 10 rows or a constant column.

    Ranks come from counts of distinct values, so ties are one row in the
    running sums.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranked(c: str) -> DataFrame:
        n = rows.groupBy(c).agg(F.count("*").alias("n"))
        return running_total(n, c, [], "n").select(c, (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias(f"rank_{c}"))

    both = rows.join(ranked(x), x).join(ranked(y), y)
    ok = (F.count("*") >= 10) & (F.stddev_pop(x) >= 1e-12) & (F.stddev_pop(y) >= 1e-12)
    return both.agg(F.when(ok, F.corr(f"rank_{x}", f"rank_{y}")).otherwise(0.0).alias("rho"), F.count("*").alias("n"))


def composite_score(metrics: DataFrame) -> DataFrame:
    """Weighted mean of the components that a row has; 0 without any."""
    def part(name: str) -> Column:
        c = F.nanvl(F.col(name), F.lit(None).cast("double"))
        if name == "list_ratio_10":
            return symmetric_ratio(F.greatest(c, F.lit(1e-8)))
        if name == "map_density_ratio":
            return symmetric_ratio(c)
        return F.greatest(F.lit(0.0), 1 - F.abs(c)) if name == "pred_density_corr" else c

    total, weight = F.lit(0.0), F.lit(0.0)
    for name, w in SCORE_WEIGHTS.items():
        value = F.when(F.col(name).isNotNull() & ~F.isnan(name), part(name))
        total = total + F.coalesce(value * w, F.lit(0.0))
        weight = weight + F.when(value.isNotNull(), w).otherwise(0.0)
    return metrics.withColumn("score", F.when(weight > 0, total / weight).otherwise(0.0))


def strict_percentile(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Share of a group's rows strictly below, times 100; 50 where a group has one row."""
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    return df.withColumn("pct", F.when(n == 1, 50.0).otherwise((F.rank().over(w.orderBy(value)) - 1) / n * 100))
