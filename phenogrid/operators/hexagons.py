"""Hexagonal cells of polygons and of the whole globe."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.functions import hexes


def fill(rings: DataFrame, level: int, ring: str = "ring") -> DataFrame:
    """The rows of ``rings``, each once for every ``hex`` whose centre lies in its closed ring.

    Rows of cells between a ring's least and greatest latitude become rows
    first; along each, crossings with the ring's edges, straight in degrees,
    pair up into stretches, whose cells are counted off.  Work follows the
    cells found.  A ring that crosses itself holds what lies inside an odd
    number of times.  Rings may run on past the date line.
    """
    lats = F.transform(ring, lambda p: p["lat"])

    def row(lat):
        return F.sin(F.radians(lat)) * hexes.rows(level)

    low, high = F.ceil(row(F.array_min(lats))), F.floor(row(F.array_max(lats)))
    lines = rings.withColumn("_r", F.explode(F.when(low <= high, F.sequence(low, high))))
    lat = hexes.latitude(F.col("_r").cast("double"), level)
    n = F.size(ring)
    edges = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    crossing = F.filter(edges, lambda e: (e["p"]["lat"] <= F.col("_lat")) != (e["q"]["lat"] <= F.col("_lat")))
    at = F.transform(crossing, lambda e: e["p"]["lon"] + (F.col("_lat") - e["p"]["lat"]) / (e["q"]["lat"] - e["p"]["lat"]) * (e["q"]["lon"] - e["p"]["lon"]))

    def first_column(lon):
        return F.ceil((lon + 180.0) * (hexes.columns(level) / 360.0) - F.col("_r") / 2)

    pairs = F.transform(F.sequence(F.lit(1), F.size("_x"), F.lit(2)), lambda i: F.struct(first_column(F.element_at("_x", i)).alias("a"), (first_column(F.element_at("_x", i + 1)) - 1).alias("b")))
    runs = lines.withColumn("_lat", lat).withColumn("_x", F.array_sort(at)).where(F.size("_x") > 0).withColumn("_run", F.explode(pairs)).where("_run.a <= _run.b")
    found = runs.withColumn("_q", F.explode(F.sequence("_run.a", "_run.b")))
    return found.withColumn("hex", hexes.cell_of(F.col("_q"), F.col("_r"), level)).select(*rings.columns, "hex")


def globe(spark: SparkSession, level: int) -> DataFrame:
    """``hex`` of all cells of a level, made on the executors."""
    most = math.ceil(hexes.rows(level) + 2 / 3) - 1
    n = hexes.columns(level)
    cells = spark.range((2 * most + 1) * n)
    return cells.select(hexes.cell_of(F.pmod("id", F.lit(n)), F.floor(F.col("id") / n) - most, level).alias("hex"))
