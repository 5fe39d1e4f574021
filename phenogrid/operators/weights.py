"""Label weights from how common a species is where it is most common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.functions import geo
from phenogrid.functions.scalars import percentile_weight
from phenogrid.operators.metrics import strict_percentile


def region_counts(presence: DataFrame) -> DataFrame:
    """Observations of each species in each coarse bin."""
    return presence.withColumn("bin", geo.geo_bin(F.col("lat"), F.col("lon"))).groupBy("bin", "species").agg(F.count("*").alias("n_obs"))


def best_percentile(counts: DataFrame) -> DataFrame:
    """A species' highest percentile over the bins, each bin ranked on its own."""
    return strict_percentile(counts, ["bin"], "n_obs").groupBy("species").agg(F.max("pct").alias("pct"))


def frequency_weights(presence: DataFrame, low: float = 10.0, high: float = 90.0, least: float = 0.1) -> DataFrame:
    return best_percentile(region_counts(presence)).withColumn("weight", percentile_weight(F.col("pct"), low, high, least))
