"""Spreading labels from well observed samples to sparse ones with a like environment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.functions import geo
from phenogrid.operators.environment import column_stats
from phenogrid.operators.nearest import k_nearest
from phenogrid.operators.stored import passing, stored
from phenogrid.operators.totals import text_ranks

LEAST_RANGE_KM = 50.0


def species_ranges(observed: DataFrame, spread: float = 2.0, cap_km: float = 500.0, species: str = "species") -> DataFrame:
    """How far each species may spread: half the diagonal of its box, at least 50 km, times ``spread``, capped."""
    box = observed.groupBy(species).agg(F.avg("lat").alias("c_lat"), (F.max("lat") - F.min("lat")).alias("dlat"), (F.max("lon") - F.min("lon")).alias("dlon"), F.count("*").alias("n_obs"))
    dy = geo.EARTH_KM * F.radians("dlat")
    dx = geo.EARTH_KM * F.radians("dlon") * F.cos(F.radians("c_lat"))
    reach = spread * F.greatest(0.5 * F.sqrt(dy * dy + dx * dx), F.lit(LEAST_RANGE_KM))
    return box.select(species, "n_obs", (F.least(reach, F.lit(cap_km)) if cap_km > 0 else reach).alias("max_km"))


def nearest_in_environment(samples: DataFrame, env: list[str], k: int, least: int, more: DataFrame | None = None) -> DataFrame:
    """The ``k`` observed samples nearest in scaled environment to each sparse sample of the same week.

    ``more`` has further columns of the observed ones, by ``week, near``.

    Distances that agree to nine digits are ties, which go to the smaller
    cell, however the statistics were summed.
    """
    filled = samples.crossJoin(F.broadcast(column_stats(samples, env)))
    z = [f"z_{c}" for c in env]
    scaled = filled.withColumns({f"z_{c}": F.coalesce((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd"), F.lit(0.0)) for c in env}).select("cell", "week", "lat", "lon", F.size("species").alias("n"), *z)
    scaled = stored(scaled)  # numbers only; what they come from is read once
    sparse = scaled.where(F.col("n") < least).drop("n")
    seen = scaled.where(F.col("n") >= least).select("week", F.col("cell").alias("near"), F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon"), *z)
    others = []
    if more is not None:
        seen, others = seen.join(more, ["week", "near"]), [c for c in more.columns if c not in ("week", "near")]
    near = k_nearest(sparse, seen, ["week"], ["cell"], z, "near", k).withColumnRenamed("dist", "env_dist")
    near = near.select("cell", "week", "lat", "lon", "near", "env_dist", "rn", "n_lat", "n_lon", *others)
    return near.withColumn("km", geo.haversine_km(F.col("lat"), F.col("lon"), F.col("n_lat"), F.col("n_lon")))


def _squares(degrees: float) -> tuple:
    """Latitude bands of a height, and in each as many squares round the globe as are no narrower than that at its edge."""
    band = lambda lat: F.floor((lat + 90) / degrees).cast("int")

    def columns(row: Column) -> Column:
        edge = F.greatest(F.abs(row * degrees - 90), F.abs((row + 1) * degrees - 90))
        return F.greatest(F.lit(1), F.floor(F.lit(360.0 / degrees) * F.cos(F.radians(F.least(edge, F.lit(90.0)))))).cast("int")

    return band, columns


def _inner_square(lat: str, lon: str) -> dict[str, Column]:
    """Row and column of a square in degrees of which no two places are farther apart than ``max_km``."""
    degrees = F.degrees(F.col("max_km") / geo.EARTH_KM) * (0.999 / 2**0.5)
    return {"_row": F.floor((F.col(lat) + 90) / degrees), "_column": F.floor((F.col(lon) + 180) / degrees)}


def additions(samples: DataFrame, env: list[str], k: int = 20, radius_km: float = 1000.0, least: int = 12, spread: float = 1.0, env_dist_max: float = 5.0, cap_km: float = 1500.0) -> DataFrame:
    """``samples`` with the species that sparse ones get in ``added``, an array.

    A sparse sample (fewer than ``least`` species) takes the species of its
    environment neighbours within ``radius_km`` and ``env_dist_max``, unless
    it is farther from every observation of the species than that may
    spread.  Null environment values count as the mean.

    Species are numbered.  The numbers of an observed sample come along with
    it from the search, so a sparse sample's neighbours are summed up where
    they were found; neither pairs of samples nor their species are rows of a
    shuffle after that.  Reach is tested once for each species and place.  A
    candidate that shares a square no wider than its reach with an
    observation of the species passes.  The others are joined with a
    species' distinct observed places in squares about as wide as the
    farthest spread, their own and those around, and each place's own
    distance is checked.
    """
    samples = stored(samples, lasting=True)
    observed = samples.where(F.size("species") >= least)
    each = observed.select("cell", "week", "lat", "lon", F.explode("species").alias("species"))
    with passing(samples.sparkSession):
        limits = species_ranges(each, spread, cap_km).select("species", "max_km") if spread > 0 else each.select("species", F.lit(0.0).alias("max_km")).distinct()
        coded = stored(text_ranks(limits, "species", "code").withColumn("code", F.col("code").cast("int")), lasting=True)  # a row for each species
        numbers = each.join(coded.select("species", "code"), "species").groupBy("week", F.col("cell").alias("near")).agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))
        near = nearest_in_environment(samples, env, k, least, numbers).where(F.col("km") <= radius_km)
        if env_dist_max > 0:
            near = near.where(F.col("env_dist") <= env_dist_max)
        lists = F.array_join(F.collect_set("codes"), ",")
        wanted = near.groupBy("cell", "week", "lat", "lon").agg(F.array_distinct(F.split(lists, ",")).cast("array<int>").alias("codes"))
        wanted = stored(wanted, lasting=True)
    if spread > 0:
        with passing(samples.sparkSession):
            places = each.join(coded, "species").select("code", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon")).distinct()
            asked = wanted.select("lat", "lon", F.explode("codes").alias("code")).distinct()
            close = _within_reach(asked, places, coded.select("code", "max_km"), cap_km)
            held = stored(close.groupBy("lat", "lon").agg(F.collect_list("code").alias("held")), lasting=True)
        wanted = wanted.join(held, ["lat", "lon"]).select("cell", "week", F.array_intersect("codes", "held").alias("codes"))
    names = coded.agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "species"))), lambda x: x["species"]).alias("_names"))
    added = F.transform(F.col("codes"), lambda c: F.element_at("_names", c))
    out = samples.join(wanted.select("cell", "week", "codes"), ["cell", "week"], "left").crossJoin(F.broadcast(names))
    return out.withColumn("added", F.array_except(F.coalesce(added, F.array().cast("array<string>")), "species")).drop("codes", "_names")


def _within_reach(asked: DataFrame, places: DataFrame, limits: DataFrame, cap_km: float) -> DataFrame:
    """The rows ``lat, lon, code`` of ``asked`` that have an observed place of their species within its ``max_km``."""
    band_km = cap_km if cap_km > 0 else 3.2 * geo.EARTH_KM
    degrees = min(180.0, 57.2957795130823 * band_km / geo.EARTH_KM * 1.000001)
    band, columns = _squares(degrees)
    column = lambda lon, row: F.floor((lon + 180) * columns(row) / 360.0).cast("int")
    places = stored(places)
    squared = stored(asked.join(limits, "code").withColumns(_inner_square("lat", "lon")))
    held = places.join(limits, "code").withColumns(_inner_square("o_lat", "o_lon")).select("code", "_row", "_column").distinct()
    sure = squared.join(held, ["code", "_row", "_column"], "left_semi").select("lat", "lon", "code")
    tested = squared.join(held, ["code", "_row", "_column"], "left_anti").drop("_row", "_column")
    tested = tested.withColumn("band", F.explode(F.array(band(F.col("lat")) - 1, band(F.col("lat")), band(F.col("lat")) + 1)))
    # the largest difference in longitude within the spread of a latitude
    sine = F.sin(F.lit(min(1.5707963, band_km / geo.EARTH_KM * 1.000001))) / F.greatest(F.cos(F.radians("lat")), F.lit(1e-9))
    wide = F.when((F.abs(F.col("lat")) + degrees >= 90) | (sine >= 1), 180.0).otherwise(F.degrees(F.asin(F.least(sine, F.lit(1.0)))) + 1e-6)
    tested = tested.withColumn("around", F.sequence(column(F.col("lon") - wide, F.col("band")), column(F.col("lon") + wide, F.col("band"))))
    tested = tested.withColumn("square", F.explode(F.array_distinct(F.transform("around", lambda x: F.pmod(x, columns(F.col("band"))))))).drop("around")
    placed = places.withColumn("band", band(F.col("o_lat"))).withColumn("square", F.pmod(column(F.col("o_lon"), F.col("band")), columns(F.col("band"))))
    pairs = tested.join(placed, ["code", "band", "square"])
    close = pairs.where(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon")) <= F.col("max_km"))
    return sure.union(close.select("lat", "lon", "code").distinct())


def propagate(samples: DataFrame, env: list[str], k: int = 20, radius_km: float = 1000.0, least: int = 12, spread: float = 1.0, env_dist_max: float = 5.0, cap_km: float = 1500.0) -> DataFrame:
    """Samples with the ``additions`` in their species, which are sorted."""
    both = additions(samples, env, k, radius_km, least, spread, env_dist_max, cap_km)
    return both.withColumn("species", F.array_sort(F.array_union("species", "added"))).drop("added")


def summary(both: DataFrame) -> DataFrame:
    """Per week: samples, samples changed and labels added, of samples with ``additions``."""
    added = F.size("added").cast("long")
    return both.groupBy("week").agg(F.count("*").alias("n_samples"), F.count_if(added > 0).alias("n_modified"), F.sum(added).alias("n_added"))
