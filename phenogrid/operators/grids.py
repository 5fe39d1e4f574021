"""Regular grids of prediction points, viewports and named regions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.functions import geo

#: Degrees of a cell at each zoom level of a map.
ZOOM_STEP = {2: 3, 3: 2, 4: 1}


def centres(low: float, high: float, step: float, midpoint: bool = True) -> list[float]:
    """Centres low + step/2, ... below high; the middle of an interval too short for one, or none."""
    n = math.ceil((high - (low + step / 2)) / step)
    if n > 0:
        return [low + step / 2 + i * step for i in range(n)]
    return [(low + high) / 2] if midpoint else []


def grid_points(spark: SparkSession, box: tuple[float, float, float, float], step: float, midpoint: bool = True) -> DataFrame:
    """Centres of a box's cells, row by row, made on the executors."""
    lon_min, lat_min, lon_max, lat_max = box

    def axis(low: float, high: float) -> tuple[int, float]:
        n = math.ceil((high - (low + step / 2)) / step)
        return (n, low + step / 2) if n > 0 else (int(midpoint), (low + high) / 2)

    (n_lat, lat0), (n_lon, lon0) = axis(lat_min, lat_max), axis(lon_min, lon_max)
    cells = spark.range(n_lat * n_lon)
    return cells.select((lat0 + F.floor(F.col("id") / max(n_lon, 1)) * step).cast("double").alias("lat"), (lon0 + F.pmod(F.col("id"), F.lit(max(n_lon, 1))) * step).cast("double").alias("lon"))


def points_by_region(regions: DataFrame, step: float) -> DataFrame:
    """Grid points of every region of a table; a region thinner than a cell gives its middle."""
    def axis(low: str, high: str):
        n = F.ceil((F.col(high) - (F.col(low) + step / 2)) / step).cast("int")
        line = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.col(low) + step / 2 + i * step)
        return F.when(n > 0, line).otherwise(F.array((F.col(low) + F.col(high)) / 2))

    rows = regions.withColumn("lat", F.explode(axis("lat_min", "lat_max")))
    return rows.withColumn("lon", F.explode(axis("lon_min", "lon_max"))).select("name", "lat", "lon")


def with_weeks(points: DataFrame, weeks: list[int]) -> DataFrame:
    """Each point once for each of a fixed list of weeks."""
    return points.withColumn("week", F.explode(F.array(*map(F.lit, weeks))))


def viewport(views: DataFrame) -> DataFrame:
    """Snaps south, north, west, east and zoom of a map view to whole cells; may run past the date line."""
    step = F.lit(3)
    for zoom, degrees in ZOOM_STEP.items():
        step = F.when(F.col("zoom") == zoom, degrees).otherwise(step)
    v = views.withColumn("step", step.cast("double"))
    v = v.withColumn("south", F.greatest("south", F.lit(-90.0))).withColumn("north", F.least("north", F.lit(90.0)))
    whole = F.col("east") - F.col("west") >= 360
    w, e = geo.wrap_lon(F.col("west")), geo.wrap_lon(F.col("east"))
    v = v.withColumn("w", F.when(whole, -180.0).otherwise(w)).withColumn("e", F.when(whole, 180.0).otherwise(F.when(e <= w, e + 360).otherwise(e)))
    v = v.withColumn("north", F.when(F.col("north") - F.col("south") < 0.1, F.col("south") + 0.1).otherwise(F.col("north"))).withColumn("e", F.when(F.col("e") - F.col("w") < 0.1, F.col("w") + 0.1).otherwise(F.col("e")))
    v = v.withColumn("south", F.greatest(F.floor(F.col("south") / F.col("step")) * F.col("step"), F.lit(-90.0))).withColumn("north", F.least(F.ceil(F.col("north") / F.col("step")) * F.col("step"), F.lit(90.0)))
    v = v.withColumn("west", F.floor(F.col("w") / F.col("step")) * F.col("step")).withColumn("east", F.ceil(F.col("e") / F.col("step")) * F.col("step")).drop("w", "e")
    return v.withColumn("n_lat", F.floor((F.col("north") - F.col("south")) / F.col("step") + 0.5).cast("int")).withColumn("n_lon", F.floor((F.col("east") - F.col("west")) / F.col("step") + 0.5).cast("int"))


def cell_key(lat, lon):
    """Hundredths of a degree, rounded half up, as text."""
    return F.concat_ws(",", F.floor(lat * 100 + 0.5).cast("long").cast("string"), F.floor(lon * 100 + 0.5).cast("long").cast("string"))
