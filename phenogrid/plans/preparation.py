"""Queries of presence tables, environment columns, samples, splits and weights."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from phenogrid.functions import hexes
from phenogrid.operators import environment, metrics, presence, sampling, training, weights
from phenogrid.operators.losses import class_weight
from phenogrid.operators.totals import quantiles
from phenogrid.plans.hexagons import HEX, LEVEL
from phenogrid.plans.tables import Tables, sql
from phenogrid.sources import readers, writers
from phenogrid.streaming import incremental

QUERIES: dict = {}


def query(text: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = (f, text)
        return f

    return keep


def joined(c: str):
    return F.array_join(c, ",").alias(c)


@query(sql("SELECT cell, week, array_to_string(species, ',') AS species FROM sets", "sets"))
def cell_week_species(t: Tables):
    return t.sets().select("cell", "week", joined("species"))


@query(sql("SELECT o.name, o.taxon_key, t.species_code, t.com_name FROM (SELECT DISTINCT name, taxon_key FROM occurrence) o LEFT JOIN taxonomy t ON lower(t.sci_name) = lower(o.name)", "occurrence", "taxonomy"))
def join_taxonomy_left(t: Tables):
    o = t.occurrence().select("name", "taxon_key").distinct().withColumn("k", F.lower("name"))
    x = t.taxonomy().select(F.lower("sci_name").alias("k"), "species_code", "com_name")
    return o.join(x, "k", "left").select("name", "taxon_key", "species_code", "com_name")


VALID = "c_custkey % 3 <> 0"


@query(sql(f"SELECT cell, week, count(*) AS n FROM occurrence WHERE cell IN (SELECT c_custkey FROM customer WHERE {VALID}) GROUP BY ALL", "occurrence"))
def semi_cells(t: Tables):
    ok = t.read("customer").where(VALID).select(F.col("c_custkey").alias("cell"))
    return t.occurrence().join(ok, "cell", "left_semi").groupBy("cell", "week").agg(F.count("*").alias("n"))


@query(sql(f"SELECT DISTINCT cell FROM occurrence WHERE cell NOT IN (SELECT c_custkey FROM customer WHERE {VALID})", "occurrence"))
def anti_missing_cells(t: Tables):
    ok = t.read("customer").where(VALID).select(F.col("c_custkey").alias("cell"))
    return t.occurrence().select("cell").distinct().join(ok, "cell", "left_anti")


@query(sql("SELECT c_custkey AS cell, " + ", ".join(f"coalesce(max(CASE WHEN week = {w} THEN array_to_string(species, ',') END), '') AS week_{w}" for w in (1, 2, 24, 48)) + " FROM customer LEFT JOIN sets ON cell = c_custkey GROUP BY 1", "sets"))
def wide_weeks(t: Tables):
    cells = t.read("customer").select(F.col("c_custkey").alias("cell"))
    return presence.wide_weeks(t.sets(), cells).select("cell", *[joined(f"week_{w}") for w in (1, 2, 24, 48)])


@query(sql("SELECT cell, " + ", ".join(f"CAST(count(*) FILTER (WHERE week = {w}) AS BIGINT) AS week_{w}" for w in range(1, 49)) + " FROM presence GROUP BY cell", "presence"))
def pivot_weeks(t: Tables):
    return t.presence().groupBy("cell").pivot("week", list(range(1, 49))).count().select("cell", *[F.coalesce(str(w), F.lit(0)).cast("long").alias(f"week_{w}") for w in range(1, 49)])


@query(sql("SELECT c_custkey AS cell, CAST(w AS INTEGER) AS week, coalesce(array_to_string(species, ','), '') AS species FROM (SELECT c_custkey FROM customer) CROSS JOIN range(1, 49) r(w) LEFT JOIN sets ON cell = c_custkey AND week = w", "sets"))
def unpivot_weeks(t: Tables):
    wide = presence.wide_weeks(t.sets(), t.read("customer").select(F.col("c_custkey").alias("cell")))
    return presence.long_weeks(wide, ["cell"]).select("cell", "week", joined("species"))


@query(sql("SELECT cell, week, array_to_string(species, ',') AS species FROM sets UNION ALL SELECT cell, 0, array_to_string(list_sort(list(DISTINCT species)), ',') FROM presence GROUP BY cell", "sets"))
def yearly_union(t: Tables):
    return presence.with_yearly(t.sets()).select("cell", "week", joined("species"))


@query(sql("SELECT species, CAST(row_number() OVER (ORDER BY species) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT species FROM presence)", "presence"))
def vocab(t: Tables):
    return presence.vocabulary(t.presence())


@query(sql("SELECT species, count(*) AS n_obs FROM presence GROUP BY species", "presence"))
def species_counts(t: Tables):
    return t.sets().select(F.explode("species").alias("species")).groupBy("species").agg(F.count("*").alias("n_obs"))


@query(sql("SELECT species, CAST(row_number() OVER (ORDER BY species) - 1 AS INTEGER) AS idx, n_obs FROM (SELECT species, count(*) AS n_obs FROM presence GROUP BY species HAVING count(*) >= (SELECT count(*) // 64 FROM presence))", "presence"))
def min_obs_vocab(t: Tables):
    p = t.presence()
    kept = presence.frequent(p, max(1, p.count() // 64))
    return kept.withColumn("idx", (F.row_number().over(Window.orderBy("species")) - 1).cast("int")).select("species", "idx", "n_obs")


@query(sql("SELECT species FROM (SELECT DISTINCT species FROM presence) ORDER BY md5(species || '|42'), species LIMIT 20", "presence"))
def max_species(t: Tables):
    return sampling.exact_sample(t.presence().select("species").distinct(), ["species"], count=20)


@query(sql("SELECT cell, week, idx FROM presence JOIN (SELECT species, CAST(row_number() OVER (ORDER BY species) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT species FROM presence WHERE week <= 24)) USING (species)", "presence"))
def encode_species(t: Tables):
    p = t.presence()
    return presence.encode(p, presence.vocabulary(p.where("week <= 24"))).select("cell", "week", "idx")


@query(sql("SELECT cell, week, species FROM presence", "presence"))
def explode_species(t: Tables):
    return t.sets().select("cell", "week", F.explode("species").alias("species"))


@query(sql("SELECT name AS species, min(taxon_key) AS taxon_key, arg_min(class, taxon_key) AS class FROM occurrence GROUP BY name", "occurrence"))
def taxon_metadata(t: Tables):
    return presence.taxon_metadata(t.occurrence().withColumn("species", F.col("name"))).select("species", "taxon_key", "class")


@query(sql("SELECT cell, week, CAST(sum(len(species)) OVER (PARTITION BY cell) AS BIGINT) AS obs_density FROM sets", "sets"))
def obs_density(t: Tables):
    return presence.observation_density(t.sets()).select("cell", "week", "obs_density")


@query(sql("SELECT cell, week, CAST(sum(len(species)) OVER o - len(species) AS BIGINT) AS start_offset, CAST(sum(len(species)) OVER o AS BIGINT) AS end_offset FROM sets WINDOW o AS (ORDER BY cell, week)", "sets"))
def csr_offsets(t: Tables):
    return presence.csr_offsets(t.sets(), ["cell", "week"])


@query(sql("SELECT s.cell, s.week, array_to_string(list_sort(list_filter(s.species, lambda x: NOT list_contains(p.species, x))), ',') AS added, array_to_string(list_sort(list_intersect(s.species, p.species)), ',') AS kept FROM sets s JOIN sets p ON p.cell = s.cell AND p.week = s.week - 1", "sets"))
def species_diff(t: Tables):
    before = t.sets().withColumn("week", F.col("week") + 1)
    return presence.diff(before, t.sets(), ["cell", "week"]).select("cell", "week", joined("added"), joined("kept"))


VOCAB = "v AS (SELECT species, CAST(row_number() OVER (ORDER BY species) - 1 AS INTEGER) AS idx, count(*) OVER () AS size FROM (SELECT DISTINCT species FROM presence WHERE week <= 24))"


@query(sql("SELECT s.cell, s.week, coalesce((SELECT string_agg(idx, ',' ORDER BY idx) FROM presence p JOIN v USING (species) WHERE p.cell = s.cell AND p.week = s.week), '') AS indices, (SELECT count(*) FROM v) AS size FROM sets s", "sets", more=VOCAB))
def multi_hot(t: Tables):
    """The whole 0/1 matrix over the vocabulary of the first half of the year, in sparse rows."""
    rows = training.multi_hot(t.sets(), presence.vocabulary(t.presence().where("week <= 24")), ["cell", "week"])
    return rows.select("cell", "week", joined("indices"), "size")


PREPARED = """known AS (SELECT species FROM presence GROUP BY species HAVING count(*) >= 3),
v AS (SELECT species, CAST(row_number() OVER (ORDER BY species) - 1 AS INTEGER) AS idx FROM known),
kept AS (SELECT cell, week, species FROM (SELECT *, row_number() OVER (PARTITION BY species ORDER BY md5(cell || '|' || week || '|' || species || '|42'), cell, week) AS r FROM presence) WHERE r <= 40),
enc AS (SELECT cell, week, string_agg(idx, ',' ORDER BY idx) AS indices FROM kept JOIN v USING (species) GROUP BY cell, week),
dens AS (SELECT cell, count(*) AS n FROM kept GROUP BY cell),
env AS (SELECT cell, round((elevation - avg(elevation) OVER ()) / stddev_pop(elevation) OVER (), 6) AS elevation, coalesce(water, 0)::DOUBLE AS water, CASE WHEN landcover = 13 THEN 1 ELSE 0 END AS landcover_13 FROM cells)"""


@query(sql("SELECT s.cell, s.week, coalesce(e.indices, '') AS indices, (SELECT count(*) FROM v) AS size, coalesce(d.n, 0) AS obs_density, env.elevation, env.water, env.landcover_13 FROM sets s LEFT JOIN enc e ON e.cell = s.cell AND e.week = s.week LEFT JOIN dens d ON d.cell = s.cell JOIN env ON env.cell = s.cell", "sets", "cells", more=PREPARED))
def prepare_training(t: Tables):
    """Environment, then vocabulary, then the cap on observations, then encoding and density."""
    cells = t.cells().select("cell", "elevation", "water", "landcover")
    rows = training.prepare(t.sets(), cells, ["elevation"], ["water"], "landcover", list(CLASSES), least=3, most=40)
    return rows.select("cell", "week", joined("indices"), "size", "obs_density", F.round("elevation", 6).alias("elevation"), "water", "landcover_13")


@query(sql("SELECT week, count(*) FILTER (WHERE list_contains(species, (SELECT min(p_name) FROM part))) AS n_cells FROM sets GROUP BY week", "sets"))
def array_contains_presence(t: Tables):
    first = t.read("part").agg(F.min("p_name").alias("first"))
    return t.sets().crossJoin(F.broadcast(first)).groupBy("week").agg(F.count_if(F.expr("array_contains(species, first)")).alias("n_cells"))


@query(sql("SELECT cell, week, CAST(coalesce(len(CASE WHEN cell % 5 = 0 THEN NULL ELSE species END), 0) AS BIGINT) AS richness FROM sets", "sets"))
def richness_obs(t: Tables):
    return t.sets().select("cell", "week", F.coalesce(F.when(F.col("cell") % 5 != 0, F.size("species")), F.lit(0)).cast("long").alias("richness"))


@query(sql("SELECT greatest(quantile_cont(len(species)::DOUBLE, 0.99), 1.0) AS p99 FROM sets WHERE len(species) > 0", "sets"))
def p99_positive(t: Tables):
    n = t.sets().select(F.size("species").cast("double").alias("n")).where("n > 0")
    return quantiles(n, "n", {"p99": 0.99}).select(F.greatest("p99", F.lit(1.0)).alias("p99"))


@query(sql("SELECT count(DISTINCT cell) AS n_cells, count(DISTINCT week) AS n_weeks, count(DISTINCT species) AS n_species, count(*) AS n_observations FROM presence", "presence"))
def data_info(t: Tables):
    return t.presence().agg(F.countDistinct("cell").alias("n_cells"), F.countDistinct("week").alias("n_weeks"), F.countDistinct("species").alias("n_species"), F.count("*").alias("n_observations"))


@query(sql("SELECT DISTINCT class_name FROM taxonomy WHERE class_name IS NOT NULL", "taxonomy"))
def infer_classes(t: Tables):
    return t.taxonomy().where("class_name is not null").select("class_name").distinct()


@query("SELECT l_suppkey AS cell, round(avg(l_discount * 100), 6) AS mean_value, (SELECT l_linenumber FROM lineitem b WHERE b.l_suppkey = a.l_suppkey GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode_category FROM lineitem a GROUP BY 1")
def zonal_mean_mode(t: Tables):
    px = t.read("lineitem").selectExpr("l_suppkey as cell", "l_discount * 100 as value", "l_linenumber as category")
    return environment.zonal(px).withColumn("mean_value", F.round("mean_value", 6))


@query(sql("SELECT cell, coalesce(elevation, landcover, water) IS NOT NULL AS has_any FROM cells", "cells"))
def row_has_any(t: Tables):
    return t.cells().select("cell", F.coalesce("elevation", F.col("landcover").cast("double"), "water").isNotNull().alias("has_any"))


@query(sql("SELECT cell, elevation FROM cells", "cells"))
def drop_all_null(t: Tables):
    return environment.drop_all_null(t.cells().select("cell", "elevation", F.lit(None).cast("double").alias("ndvi")))


@query(sql("SELECT cell, round((elevation - avg(elevation) OVER ()) / stddev_pop(elevation) OVER (), 6) AS elevation, round((lat - avg(lat) OVER ()) / stddev_pop(lat) OVER (), 6) AS lat, 0.0::DOUBLE AS flat FROM cells", "cells"))
def zscore(t: Tables):
    cells = t.cells().select("cell", "elevation", "lat", F.lit(3.0).alias("flat"))
    return environment.zscore(cells, ["elevation", "lat", "flat"]).withColumns({c: F.round(c, 6) for c in ("elevation", "lat")})


CLASSES = range(1, 18)
ONE_HOT_SQL = ", ".join(f"CASE WHEN landcover = {c} THEN 1 ELSE 0 END AS landcover_{c}" for c in CLASSES)


@query(sql(f"SELECT cell, {ONE_HOT_SQL} FROM cells", "cells"))
def one_hot(t: Tables):
    return environment.one_hot(t.cells().select("cell", "landcover"), "landcover", list(CLASSES))


@query(sql(f"SELECT cell, round((elevation - avg(elevation) OVER ()) / stddev_pop(elevation) OVER (), 6) AS elevation, coalesce(water, 0)::DOUBLE AS water, coalesce(urban, 0)::DOUBLE AS urban, {ONE_HOT_SQL} FROM cells", "cells"))
def normalize_env(t: Tables):
    cells = t.cells().select("cell", "elevation", "water", "urban", "landcover")
    return environment.normalise(cells, ["elevation"], ["water", "urban"], "landcover", list(CLASSES)).withColumn("elevation", F.round("elevation", 6))


LOC_SQL = "loc AS (SELECT c_custkey AS cell, row_number() OVER (ORDER BY md5(c_custkey || '|42'), c_custkey) AS r, count(*) OVER () AS n FROM customer)"


@query(sql("SELECT cell FROM loc WHERE r <= greatest(1, floor(n * 0.1))", more=LOC_SQL))
def sample_fraction(t: Tables):
    return sampling.exact_sample(t.read("customer").select(F.col("c_custkey").alias("cell")), ["cell"], 0.1)


PLOC_SQL = "keyed AS (SELECT cell, row_number() OVER (ORDER BY md5(cell || '|42'), cell) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT cell FROM presence))"


@query(sql("SELECT cell, week, species FROM presence WHERE cell IN (SELECT cell FROM keyed WHERE r <= greatest(1, floor(n * 0.2)))", "presence", more=PLOC_SQL))
def subsample_by_location(t: Tables):
    return sampling.sample_by_location(t.presence(), "cell", 0.2)


@query(sql("SELECT cell, week FROM (SELECT cell, week, row_number() OVER (ORDER BY md5(cell || '|' || week || '|42'), cell, week) AS r, count(*) OVER () AS n FROM sets) WHERE r <= greatest(1, floor(n * 0.15))", "sets"))
def subsample_by_samples(t: Tables):
    return sampling.exact_sample(t.sets().select("cell", "week"), ["cell", "week"], 0.15)


@query(sql("SELECT s.cell, week, CASE WHEN r <= ceil(n * 0.2) THEN 'val' ELSE 'train' END AS part FROM sets s JOIN keyed k ON k.cell = s.cell", "sets", more=PLOC_SQL))
def split_by_location(t: Tables):
    train, val = sampling.split(t.sets().select("cell", "week"), ["cell"], 0.2)
    return train.withColumn("part", F.lit("train")).union(val.withColumn("part", F.lit("val")))


@query(sql("SELECT cell, week, CASE WHEN row_number() OVER (ORDER BY md5(cell || '|' || week || '|42'), cell, week) <= ceil(count(*) OVER () * 0.1) THEN 'val' ELSE 'train' END AS part FROM sets", "sets"))
def split_by_row(t: Tables):
    train, val = sampling.split(t.sets().select("cell", "week"), ["cell", "week"], 0.1)
    return train.withColumn("part", F.lit("train")).union(val.withColumn("part", F.lit("val")))


@query(sql("SELECT cell, CASE WHEN (lon BETWEEN -125 AND -116.5 AND lat BETWEEN 42 AND 49) OR (lon BETWEEN -124.5 AND -114.1 AND lat BETWEEN 32.5 AND 42) OR (lon BETWEEN 129.5 AND 145.8 AND lat BETWEEN 30 AND 45.5) THEN 'inside' ELSE 'outside' END AS side FROM cells", "cells"))
def mask_regions(t: Tables):
    from phenogrid.operators.regions import holdout_boxes

    outside, inside = sampling.mask_regions(t.cells(), holdout_boxes(["us_northwest", "california", "japan"]))
    return outside.select("cell", F.lit("outside").alias("side")).union(inside.select("cell", F.lit("inside").alias("side")))


@query(sql("SELECT cell, week, species FROM (SELECT *, row_number() OVER (PARTITION BY species ORDER BY md5(cell || '|' || week || '|' || species || '|42'), cell, week) AS r FROM presence) WHERE r <= 40", "presence"))
def cap_observations(t: Tables):
    return sampling.cap_observations(t.presence(), 40, ["cell", "week"])


BLOCK_ROWS, MOST_ROWS = 500, 2500


@query(f"""WITH sizes AS (SELECT (o_orderkey - 1) // {BLOCK_ROWS} AS block, count(*) AS n_rows FROM orders GROUP BY ALL), blocks AS (SELECT *, coalesce(sum(n_rows) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sizes)
 SELECT block, n_rows, CAST((SELECT least(min(seen), (SELECT count(*) FROM sizes)) FROM (VALUES (1), (3), (7), (15), (31), (63)) g(seen) WHERE seen >= (SELECT count(*) FROM blocks WHERE before < {MOST_ROWS})) AS INTEGER) AS n_looked_at FROM blocks WHERE before < {MOST_ROWS}""")
def limit_rows(t: Tables):
    """Orders in blocks of five hundred keys, read up to the block in which the limit falls; how many blocks were looked at."""
    folder = t.folder()
    writers.write_chunks(t.read("orders").withColumn("chunk", F.expr(f"(o_orderkey - 1) div {BLOCK_ROWS}")), folder, "chunk")
    rows, seen = readers.read_blocks(t.spark, folder, MOST_ROWS)
    return rows.groupBy(F.expr(f"(o_orderkey - 1) div {BLOCK_ROWS}").alias("block")).agg(F.count("*").alias("n_rows")).withColumn("n_looked_at", F.lit(seen))


PLACED = "placed AS (SELECT p.cell, week, species, lat, lon FROM presence p JOIN cells c ON c.cell = p.cell)"
BINS = PLACED + ", counts AS (SELECT CAST(least(5, greatest(0, floor((lat + 90) / 30))) * 10 + least(5, greatest(0, floor((lon + 180) / 60))) AS INTEGER) AS bin, species, count(*) AS n_obs FROM placed GROUP BY ALL)"
PCT = BINS + ", ranked AS (SELECT *, CASE WHEN count(*) OVER w = 1 THEN 50.0 ELSE (rank() OVER (PARTITION BY bin ORDER BY n_obs) - 1)::DOUBLE / count(*) OVER w * 100 END::DOUBLE AS pct FROM counts WINDOW w AS (PARTITION BY bin)), best AS (SELECT species, max(pct) AS pct FROM ranked GROUP BY species)"


def placed(t: Tables):
    return t.presence().join(t.cells().select("cell", "lat", "lon"), "cell")


@query(sql("SELECT bin, species, n_obs FROM counts", "presence", "cells", more=BINS))
def region_counts(t: Tables):
    return weights.region_counts(placed(t))


@query(sql("SELECT bin, species, round(pct, 6) AS pct FROM ranked", "presence", "cells", more=PCT))
def strict_pct_rank(t: Tables):
    return metrics.strict_percentile(weights.region_counts(placed(t)), ["bin"], "n_obs").select("bin", "species", F.round("pct", 6).alias("pct"))


@query(sql("SELECT species, round(pct, 6) AS pct FROM best", "presence", "cells", more=PCT))
def max_region_pct(t: Tables):
    return weights.best_percentile(weights.region_counts(placed(t))).withColumn("pct", F.round("pct", 6))


WEIGHT = "CASE WHEN pct >= 90 THEN 1.0 WHEN pct > 10 THEN 0.1 + (pct - 10) / 80.0 * 0.9 ELSE 0.1 END::DOUBLE"


@query(sql(f"SELECT species, round({WEIGHT}, 6) AS weight FROM best", "presence", "cells", more=PCT))
def species_freq_weights(t: Tables):
    return weights.frequency_weights(placed(t)).select("species", F.round("weight", 6).alias("weight"))


@query(sql(f"SELECT p.cell, p.week, p.species, round(CASE WHEN p.cell % 5 = 0 THEN 1.0 ELSE {WEIGHT} END, 6)::DOUBLE AS label FROM presence p JOIN best USING (species)", "presence", "cells", more=PCT))
def weighted_labels(t: Tables):
    w = weights.frequency_weights(placed(t)).select("species", "weight")
    return t.presence().join(w, "species").select("cell", "week", "species", F.round(F.when(F.col("cell") % 5 == 0, 1.0).otherwise(F.col("weight")), 6).alias("label"))


NEGPOS = "np AS (SELECT species, count(*) AS pos, (SELECT count(*) FROM sets) - count(*) AS neg FROM presence GROUP BY species)"


def positives(t: Tables):
    n = t.sets().agg(F.count("*").alias("n"))
    return t.presence().groupBy("species").agg(F.count("*").alias("pos")).crossJoin(F.broadcast(n)).withColumn("neg", F.col("n") - F.col("pos"))


@query(sql("SELECT species, round(least(50.0, (neg + 100.0) / (pos + 100.0)), 6)::DOUBLE AS weight FROM np", "sets", more=NEGPOS))
def class_weights(t: Tables):
    return positives(t).select("species", F.round(class_weight(F.col("pos"), F.col("neg"), 100.0, 50.0), 6).alias("weight"))


@query(sql("SELECT species, round((neg + 1.0)::DOUBLE / (pos + 1.0)::DOUBLE, 6) AS weight FROM np", "sets", more=NEGPOS))
def pos_weights(t: Tables):
    return positives(t).select("species", F.round(class_weight(F.col("pos"), F.col("neg"), 1.0), 6).alias("weight"))


@query(sql("""SELECT code, reason FROM (SELECT code, CASE WHEN code NOT IN (SELECT species FROM presence) THEN 'vocabulary' END AS a, CASE WHEN code IN (SELECT species FROM presence) AND code NOT IN (SELECT species FROM presence WHERE cell % 5 <> 0 AND week <= 2) THEN 'train' END AS b,
 CASE WHEN code IN (SELECT species FROM presence) AND code NOT IN (SELECT species FROM presence WHERE cell % 5 = 0 AND week = 1) THEN 'validation' END AS c FROM (SELECT DISTINCT p_name AS code FROM part UNION SELECT 'no such species')) UNPIVOT (reason FOR n IN (a, b, c))""", "presence"))
def watchlist_coverage(t: Tables):
    watch = t.read("part").select(F.col("p_name").alias("species")).distinct().union(t.spark.range(1).select(F.lit("no such species")))
    p = t.presence()
    known = watch.join(p, "species", "left_semi")
    out = watch.join(p, "species", "left_anti").withColumn("reason", F.lit("vocabulary"))
    out = out.union(known.join(p.where("cell % 5 <> 0 and week <= 2"), "species", "left_anti").withColumn("reason", F.lit("train")))
    out = out.union(known.join(p.where("cell % 5 = 0 and week = 1"), "species", "left_anti").withColumn("reason", F.lit("validation")))
    return out.withColumnRenamed("species", "code")


@query(sql(f"SELECT place, CAST(w AS INTEGER) AS week, coalesce(array_to_string(species, ','), '') AS species FROM (SELECT s_suppkey AS place, hex FROM supplier JOIN hex ON cell = s_suppkey) p CROSS JOIN range(1, 49) r(w) LEFT JOIN (SELECT hex, week AS w, list_sort(list(DISTINCT species)) AS species FROM presence JOIN hex USING (cell) GROUP BY hex, week) k USING (hex, w)", "cells", "presence", more=HEX))
def cell_ground_truth(t: Tables):
    """The 48 lists of the hexagon that holds each supplier's place; weeks without observations are empty."""
    place = lambda df, key: df.select(F.col(key).alias("place"), "hex")
    at = t.cells().select("cell", hexes.point_cell(F.col("lat"), F.col("lon"), LEVEL).alias("hex"))
    asked = place(t.read("supplier").join(at, F.col("s_suppkey") == F.col("cell")), "s_suppkey")
    held = presence.species_sets(t.presence().join(at, "cell").select("hex", "week", "species"), cell="hex")
    weeks = asked.withColumn("week", F.explode(F.sequence(F.lit(1), F.lit(48))))
    return weeks.join(held, ["hex", "week"], "left").select("place", "week", F.coalesce(F.array_join("species", ","), F.lit("")).alias("species"))


@query(sql("SELECT species, n_obs, CAST(1 AS INTEGER) AS n_built FROM (SELECT species, count(*) AS n_obs FROM presence GROUP BY species) WHERE n_obs >= 4", "presence"))
def cache_key(t: Tables):
    """Species counts read through a cache twice, and once for another parameter: each is built once."""
    folder, built = t.folder(), []
    inputs = [f"{t.sf_dir}/{name}.parquet" for name in ("orders", "lineitem", "part")]

    def counts(least: int):
        def build():
            built.append(least)
            return t.presence().groupBy("species").agg(F.count("*").alias("n_obs")).where(F.col("n_obs") >= least)

        return writers.read_through(t.spark, folder, inputs, {"min_obs": least}, build)

    for least in (4, 5, 4):
        kept = counts(least)
    return kept.withColumn("n_built", F.lit(built.count(4)))


ROWS_PER_FILE = 500_000  # of the stream's part files


@query(sql("SELECT week, count(*) AS n FROM presence GROUP BY week", "presence"))
def stream_incremental(t: Tables):
    """Presence kept up from a stream of part files, which is stopped after some batches and started again from its checkpoint."""
    files, table, checkpoint = (f"{t.folder()}/{name}" for name in ("in", "presence", "state"))
    arrived = t.occurrence().select("cell", "week", F.col("name").alias("species"))
    # all rows of a key have one file, and those that come again mostly have another
    again = F.explode(F.when(F.col("cell") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")
    n_files = max(4, -(-t.read("lineitem").count() // ROWS_PER_FILE))
    arrived.select("*", again).repartition(n_files, "cell", "week", "species", "again").drop("again").write.parquet(files)

    def stream():
        return incremental.read_presence_stream(t.spark, files, "cell bigint, week int, species string", files_per_batch=-(-n_files // 4))

    running = incremental.write_presence(stream(), table, checkpoint, once=False)
    while running.isActive and not any(p["numInputRows"] for p in running.recentProgress):
        running.awaitTermination(0.1)
    running.stop()
    incremental.write_presence(stream(), table, checkpoint).awaitTermination()
    return t.spark.read.parquet(table).groupBy("week").agg(F.count("*").alias("n"))
