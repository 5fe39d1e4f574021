"""Queries over grids of predictions, labels and regions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from phenogrid.functions.calendar import SEASON_WEEKS
from phenogrid.operators import grids, inference, ranking
from phenogrid.plans.tables import Tables, sql

QUERIES: dict = {}


def query(text: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = (f, text)
        return f

    return keep


def axis_sql(low: str, high: str, step: float) -> str:
    n = f"ceil(({high} - ({low} + {step} / 2)) / {step})"
    return f"CASE WHEN {n} > 0 THEN list_transform(range(0, CAST({n} AS BIGINT)), lambda i: ({low} + {step} / 2 + i * {step})::DOUBLE) ELSE [({low} + {high})::DOUBLE / 2] END"


GRID = f"lines AS (SELECT name, lon_min, lon_max, unnest({axis_sql('lat_min', 'lat_max', 1.0)}) AS lat FROM boxes), grid AS (SELECT name, lat, unnest({axis_sql('lon_min', 'lon_max', 1.0)}) AS lon FROM lines)"


def grid(t: Tables):
    return grids.points_by_region(t.boxes(), 1.0)


def rounded(df, *columns):
    return df.select(*[F.round(c, 6).alias(c) if c in ("lat", "lon") else F.col(c) for c in columns])


@query(sql("SELECT name, round(lat, 6) AS lat, round(lon, 6) AS lon FROM grid", "boxes", more=GRID))
def grid_centres(t: Tables):
    return rounded(grid(t), "name", "lat", "lon")


@query(sql("SELECT name, round(lat, 6) AS lat, round(lon, 6) AS lon, CAST(w AS INTEGER) AS week FROM grid CROSS JOIN range(1, 49) r(w)", "boxes", more=GRID))
def grid_x_weeks(t: Tables):
    return rounded(grids.with_weeks(grid(t), list(range(1, 49))), "name", "lat", "lon", "week")


VIEW = "views AS (SELECT c_custkey AS view, (c_custkey * 7919 % 1500)::DOUBLE / 10 - 75 - 8 AS south, (c_custkey * 7919 % 1500)::DOUBLE / 10 - 75 + 9 AS north, (c_custkey * 104729 % 4000)::DOUBLE / 10 - 200 - 15 AS west, (c_custkey * 104729 % 4000)::DOUBLE / 10 - 200 + 15 + (c_custkey % 3) * 170 AS east, CAST(c_custkey % 4 + 2 AS INTEGER) AS zoom FROM customer)"


@query(sql("""SELECT view, zoom, step, south, north, west, east, CAST(floor((north - south) / step + 0.5) AS INTEGER) AS n_lat, CAST(floor((east - west) / step + 0.5) AS INTEGER) AS n_lon FROM (
 SELECT view, zoom, step, greatest(floor(south / step) * step, -90) AS south, least(ceil(north / step) * step, 90) AS north, floor(w / step) * step AS west, ceil(e / step) * step AS east FROM (
 SELECT view, zoom, step, south, greatest(north, CASE WHEN north - south < 0.1 THEN south + 0.1 ELSE north END) AS north, w, CASE WHEN e - w < 0.1 THEN w + 0.1 ELSE e END AS e FROM (
 SELECT view, zoom, CASE zoom WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 1 ELSE 3 END::DOUBLE AS step, greatest(south, -90) AS south, least(north, 90) AS north,
 CASE WHEN east - west >= 360 THEN -180 ELSE w END AS w, CASE WHEN east - west >= 360 THEN 180 WHEN e <= w THEN e + 360 ELSE e END AS e FROM (
 SELECT *, ((west + 180) % 360 + 360) % 360 - 180 AS w, ((east + 180) % 360 + 360) % 360 - 180 AS e FROM views))))""", more=VIEW))
def viewport_grid(t: Tables):
    views = t.read("customer").selectExpr(
        "c_custkey as view", "(c_custkey * 7919 % 1500) / 10 - 75 - 8 as south", "(c_custkey * 7919 % 1500) / 10 - 75 + 9 as north",
        "(c_custkey * 104729 % 4000) / 10 - 200 - 15 as west", "(c_custkey * 104729 % 4000) / 10 - 200 + 15 + (c_custkey % 3) * 170 as east", "cast(c_custkey % 4 + 2 as int) as zoom",
    )
    return grids.viewport(views).select("view", "zoom", "step", "south", "north", "west", "east", "n_lat", "n_lon")


KEY = "CAST(CAST(floor(lat * 100 + 0.5) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor(lon * 100 + 0.5) AS BIGINT) AS VARCHAR)"


@query(sql(f"SELECT DISTINCT {KEY} AS key FROM grid WHERE {KEY} NOT IN (SELECT {KEY} FROM grid WHERE name % 3 = 0)", "boxes", more=GRID))
def cache_missing(t: Tables):
    """Points of the grid that those of every third box do not have."""
    key = grids.cell_key(F.col("lat"), F.col("lon")).alias("key")
    cached = grid(t).where("name % 3 = 0").select(key)
    return grid(t).select(key).distinct().join(cached, "key", "left_anti")


@query(sql("SELECT week, count(*) AS n, round(avg(prob), 6) AS mean_prob FROM pred WHERE week IN (1, 13, 26, 39) GROUP BY week", "predictions"))
def seasonal_slice(t: Tables):
    return t.predictions().where(F.col("week").isin(*SEASON_WEEKS)).groupBy("week").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 6).alias("mean_prob"))


@query(sql("SELECT cell, week, idx, prob FROM pred WHERE prob >= 0.15 QUALIFY row_number() OVER (PARTITION BY cell, week ORDER BY prob DESC, idx) <= 3", "predictions"))
def predict_topk(t: Tables):
    """The three most probable species of each cell and week."""
    return ranking.best_each(t.predictions(), 0.15, 3, ["cell", "week"]).select("cell", "week", "idx", "prob")


@query(sql("SELECT cell, idx, max(prob) AS prob FROM pred GROUP BY cell, idx", "predictions"))
def yearly_max(t: Tables):
    return ranking.yearly_max(t.predictions(), ["cell", "idx"])


@query(sql("SELECT cell, idx, prob FROM (SELECT cell, idx, max(prob) AS prob FROM pred GROUP BY cell, idx) WHERE prob >= 0.5 QUALIFY row_number() OVER (PARTITION BY cell ORDER BY prob DESC, idx) <= 10", "predictions"))
def species_weeks_topk(t: Tables):
    return ranking.best_each(ranking.yearly_max(t.predictions(), ["cell", "idx"]), 0.5, 10, ["cell"])


WEEKLY = "weekly AS (SELECT idx, week, max(prob) AS prob FROM pred GROUP BY idx, week)"


def weekly(t: Tables):
    """The greatest score of each species and week over all cells."""
    return t.predictions().groupBy("idx", "week").agg(F.max("prob").alias("prob"))


@query(sql("SELECT idx, round(avg(prob) + 1e-9, 6) AS avg_prob, round(greatest(max(avg(prob)) OVER (), 0.01) + 1e-9, 6) AS max_avg FROM weekly GROUP BY idx", "predictions", more=WEEKLY))
def phenology_avg(t: Tables):
    avg = weekly(t).groupBy("idx").agg(F.avg("prob").alias("avg_prob"))
    return ranking.over_maximum(avg, "avg_prob", 0.01).select("idx", F.round(F.col("avg_prob") + 1e-9, 6).alias("avg_prob"), F.round(F.col("max_value") + 1e-9, 6).alias("max_avg"))


@query(sql("SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, week, count(*) FILTER (WHERE prob >= 0.5) AS n_species FROM pred GROUP BY lat, lon, week", "predictions"))
def richness_pred(t: Tables):
    return rounded(ranking.richness(t.predictions(), 0.5, ["lat", "lon", "week"]), "lat", "lon", "week", "n_species")


@query(sql("SELECT cell, week, p.idx, coalesce(code, 'idx' || p.idx) AS code, coalesce(com, 'idx' || p.idx) AS com, prob FROM pred p LEFT JOIN labels_t l ON l.idx = p.idx", "labels", "predictions"))
def join_labels_left(t: Tables):
    none = F.concat(F.lit("idx"), F.col("idx").cast("string"))
    return t.predictions().join(t.labels(), "idx", "left").select("cell", "week", "idx", F.coalesce("code", none).alias("code"), F.coalesce("com", none).alias("com"), "prob")


@query(sql("SELECT l.idx, coalesce(lower(trim(class_name)), '') = 'aves' AS is_bird FROM labels_t l LEFT JOIN (SELECT * FROM taxonomy WHERE n % 11 <> 0) x ON x.sci_name = l.sci", "labels"))
def split_by_class(t: Tables):
    known = t.taxonomy().where("n % 11 <> 0").select(F.col("sci_name").alias("sci"), "class_name")
    return t.labels().join(known, "sci", "left").select("idx", (F.coalesce(F.lower(F.trim("class_name")), F.lit("")) == "aves").alias("is_bird"))


SCORES = "scores AS (SELECT region_id, name, idx, avg(prob) AS score FROM pred JOIN regions ON lon BETWEEN lon_min AND lon_max AND lat BETWEEN lat_min AND lat_max WHERE week % 12 < 4 GROUP BY ALL)"


def scores(t: Tables):
    """Mean scores of a region's cells in the first weeks of each season; the regions are a fixed table of twenty rows."""
    r = t.regions()
    held = t.predictions().where("week % 12 < 4").join(F.broadcast(r), F.col("lon").between(F.col("lon_min"), F.col("lon_max")) & F.col("lat").between(F.col("lat_min"), F.col("lat_max")))
    return ranking.region_scores(held)


@query(sql("SELECT name, idx, round(score + 1e-8, 6) AS score FROM scores", "regions", "predictions", more=SCORES))
def region_scores(t: Tables):
    # a hair on top, so that exact halves round alike in every engine
    return scores(t).select("name", "idx", F.round(F.col("score") + 1e-8, 6).alias("score"))


def ranked(t: Tables):
    # equal means must rank alike in every engine
    s = scores(t).withColumn("score", F.round("score", 9)).withColumn("is_bird", F.col("idx") % 3 != 0)
    return ranking.region_ranks(s)


@query(sql("SELECT name, idx, idx % 3 <> 0 AS is_bird, CAST(row_number() OVER (PARTITION BY region_id, idx % 3 <> 0 ORDER BY round(score, 9) DESC, idx) AS INTEGER) AS rank FROM scores", "regions", "predictions", more=SCORES))
def region_ranks(t: Tables):
    return ranked(t).select("name", "idx", "is_bird", "rank")


# one step of the recursion tries the queue whose turn it is; 4 birds, then 1 other, region by region
PICKS = SCORES + """, queue AS (SELECT region_id, is_bird, list(idx ORDER BY rank) AS species FROM (SELECT region_id, idx, idx % 3 <> 0 AS is_bird, row_number() OVER (PARTITION BY region_id, idx % 3 <> 0 ORDER BY round(score, 9) DESC, idx) AS rank FROM scores) GROUP BY region_id, is_bird),
slot AS (SELECT CAST(row_number() OVER (ORDER BY region_id, is_bird DESC) - 1 AS INTEGER) AS i, region_id, CASE WHEN is_bird THEN 4 ELSE 1 END AS quota, species FROM queue), size AS (SELECT CAST(count(*) AS INTEGER) AS n FROM slot),
step AS (SELECT 0 AS i, 0 AS used, 0 AS idle, []::INTEGER[] AS taken, []::INTEGER[] AS places
 UNION ALL SELECT CASE WHEN next IS NULL OR used + 1 = quota THEN (i + 1) % n ELSE i END, CASE WHEN next IS NULL OR used + 1 = quota THEN 0 ELSE used + 1 END, CASE WHEN next IS NULL THEN idle + 1 ELSE 0 END,
  CASE WHEN next IS NULL THEN taken ELSE list_append(taken, next) END, CASE WHEN next IS NULL THEN places ELSE list_append(places, region_id) END
 FROM (SELECT s.i, s.used, s.idle, s.taken, s.places, q.quota, q.region_id, z.n, list_filter(q.species, lambda x: NOT list_contains(s.taken, x))[1] AS next FROM step s JOIN slot q ON q.i = s.i CROSS JOIN size z WHERE len(s.taken) < 40 AND s.idle < z.n)),
last_step AS (SELECT taken, places FROM step ORDER BY len(taken) DESC LIMIT 1), picks AS (SELECT CAST(unnest(range(1, len(taken) + 1)) AS INTEGER) AS pick, unnest(places) AS region_id, unnest(taken) AS idx FROM last_step)"""


@query(sql("SELECT pick, region_id, idx FROM picks", "regions", "predictions", more=PICKS, recursive=True))
def round_robin_select(t: Tables):
    return ranking.round_robin(ranked(t), 40)


@query(sql("SELECT pick, p.idx, coalesce(code, 'idx' || p.idx) AS code, sci, com FROM picks p LEFT JOIN labels_t l ON l.idx = p.idx", "regions", "predictions", "labels", more=PICKS, recursive=True))
def common_species(t: Tables):
    """The list that stands for all regions, with labels."""
    picks = ranking.round_robin(ranked(t), 40)
    return picks.join(t.labels(), "idx", "left").select("pick", "idx", F.coalesce("code", F.concat(F.lit("idx"), "idx")).alias("code"), "sci", "com")


CHOSEN = "idx IN (SELECT p_partkey % 64 FROM part WHERE p_size <= 2)"


@query(sql(f"SELECT name, count(*) AS n_present, count(*) FILTER (WHERE {CHOSEN}) AS n_selected, round(100.0 * count(*) FILTER (WHERE {CHOSEN}) / count(*), 6)::DOUBLE AS pct FROM scores WHERE score > 0.5 GROUP BY name", "regions", "predictions", more=SCORES))
def region_coverage(t: Tables):
    chosen = t.read("part").where("p_size <= 2").selectExpr("cast(p_partkey % 64 as int) as idx")
    return ranking.region_coverage(scores(t), chosen, 0.5).withColumn("pct", F.round("pct", 6))


WORD = "SELECT substr(min(p_name), 1, 4) FROM part"


@query(sql(f"SELECT idx, code FROM labels_t WHERE contains(code, lower(({WORD}))) OR contains(lower(sci), lower(({WORD}))) OR contains(lower(com), lower(({WORD}))) ORDER BY idx LIMIT 30", "labels"))
def species_search(t: Tables):
    word = t.read("part").agg(F.min("p_name")).first()[0][:4]
    return ranking.search(t.labels(), word).select("idx", "code")


ASKED = "asked AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS query FROM part UNION SELECT 'sp0002')"
HIT = "contains(lower(code), lower(query)) OR contains(lower(sci), lower(query)) OR contains(lower(com), lower(query))"


def asked(t: Tables):
    """Queries of a user: first words of names, and a code."""
    return t.read("part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("query")).distinct().union(t.spark.range(1).select(F.lit("sp0002")))


@query(sql(f"SELECT query, min(idx) AS idx, arg_min(code, idx) AS code FROM asked JOIN labels_t ON {HIT} GROUP BY query", "labels", more=ASKED))
def resolve_first_match(t: Tables):
    return ranking.resolve(t.labels(), asked(t), exact_first=False)


@query(sql(f"SELECT query, idx, code FROM asked JOIN labels_t ON {HIT} QUALIFY row_number() OVER (PARTITION BY query ORDER BY CASE WHEN lower(code) = lower(query) OR lower(sci) = lower(query) OR lower(com) = lower(query) THEN 0 ELSE 1 END, idx) = 1", "labels", more=ASKED))
def resolve_exact_then_sub(t: Tables):
    return ranking.resolve(t.labels(), asked(t), exact_first=True)


# every word is asked for three times; a turn takes the first match that is not taken
TURNS = "turns AS (SELECT query, CAST(row_number() OVER (ORDER BY k, query) AS INTEGER) AS turn FROM asked CROSS JOIN range(0, 3) r(k))"
TAKEN = ASKED + ", " + TURNS + f""", step AS (SELECT 0 AS turn, []::INTEGER[] AS taken, CAST(NULL AS INTEGER) AS idx
 UNION ALL SELECT turn + 1, CASE WHEN next IS NULL THEN taken ELSE list_append(taken, next) END, next
 FROM (SELECT s.turn, s.taken, (SELECT min(idx) FROM turns q JOIN labels_t ON {HIT} WHERE q.turn = s.turn + 1 AND NOT list_contains(s.taken, idx)) AS next FROM step s WHERE s.turn < (SELECT max(turn) FROM turns)))"""


@query(sql("SELECT turn, query, idx, code FROM step JOIN turns USING (turn) JOIN labels_t USING (idx)", "labels", more=TAKEN, recursive=True))
def resolve_each(t: Tables):
    """Words asked for in turn, three times each: equal ones get the next match."""
    turns = asked(t).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    turns = turns.select("query", F.row_number().over(Window.orderBy("k", "query")).alias("turn"))
    return ranking.resolve_each(t.labels(), turns)


LINE = "'\"' || code || '\",\"' || replace(com, '\"', '\"\"') || '\",\"' || replace(sci, '\"', '\"\"') || '\"'"


def quoted(c: str):
    return F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))


@query(sql(f"SELECT cell, CAST(row_number() OVER w AS INTEGER) AS rank, row_number() OVER w || ',' || {LINE} || ',' || printf('%.6f', prob) AS line FROM (SELECT cell, idx, max(prob) AS prob FROM pred GROUP BY cell, idx) JOIN labels_t USING (idx) WHERE prob >= 0.5 WINDOW w AS (PARTITION BY cell ORDER BY prob DESC, idx)", "labels", "predictions"))
def csv_species_list(t: Tables):
    """Lines of each cell's species list; a list is as short as the vocabulary."""
    rows = ranking.yearly_max(t.predictions(), ["cell", "idx"]).where("prob >= 0.5").join(t.labels(), "idx")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("prob"), "idx")))
    return rows.select("cell", "rank", F.concat_ws(",", F.col("rank").cast("string"), quoted("code"), quoted("com"), quoted("sci"), F.format_string("%.6f", "prob")).alias("line"))


@query(sql(f"SELECT idx, {LINE} || ',' || string_agg(printf('%.6f', coalesce(prob, 0)), ',' ORDER BY w) || ',' || printf('%.6f', sum(coalesce(prob, 0)) / 48 + 1e-8) AS line FROM (SELECT DISTINCT idx FROM weekly) CROSS JOIN range(1, 49) r(w) LEFT JOIN (SELECT idx, week AS w, prob FROM weekly) USING (idx, w) JOIN labels_t USING (idx) GROUP BY idx, code, com, sci", "labels", "predictions", more=WEEKLY))
def csv_phenology_wide(t: Tables):
    """A line for each species: its 48 weeks and their average; 0 where it has no score."""
    wide = weekly(t).groupBy("idx").pivot("week", list(range(1, 49))).agg(F.first("prob")).fillna(0.0)
    weeks = [F.col(f"`{w}`") for w in range(1, 49)]
    average = sum(weeks[1:], weeks[0]) / 48 + 1e-8  # a hair on top, so that exact halves round alike in every engine
    return wide.join(t.labels(), "idx").select("idx", F.concat_ws(",", quoted("code"), quoted("com"), quoted("sci"), *[F.format_string("%.6f", w) for w in weeks], F.format_string("%.6f", average)).alias("line"))


@query(sql("SELECT idx, printf('%.4f', round(lat, 6)) || ',' || printf('%.4f', round(lon, 6)) || ',' || printf('%.6f', max(prob)) AS line FROM pred WHERE prob > 0.001 GROUP BY cell, lat, lon, idx", "predictions"))
def csv_range(t: Tables):
    """Lines of every species' range: its cells and their greatest score."""
    rows = t.predictions().where("prob > 0.001").groupBy("cell", "lat", "lon", "idx").agg(F.max("prob").alias("prob"))
    return rows.select("idx", F.concat_ws(",", F.format_string("%.4f", F.round("lat", 6)), F.format_string("%.4f", F.round("lon", 6)), F.format_string("%.6f", "prob")).alias("line"))


@query(sql("SELECT week, printf('%.4f', round(lat, 6)) || ',' || printf('%.4f', round(lon, 6)) || ',' || count(*) FILTER (WHERE prob >= 0.05) AS line FROM pred GROUP BY cell, week, lat, lon", "predictions"))
def csv_richness(t: Tables):
    rows = ranking.richness(t.predictions(), 0.05, ["cell", "week", "lat", "lon"])
    return rows.select("week", F.concat_ws(",", F.format_string("%.4f", F.round("lat", 6)), F.format_string("%.4f", F.round("lon", 6)), F.col("n_species").cast("string")).alias("line"))


@query(sql("SELECT week, idx, round(max(prob), 6) AS max_prob, count(*) FILTER (WHERE prob >= 0.5) AS n_cells FROM pred WHERE week IN (1, 13, 26, 39) GROUP BY week, idx", "predictions"))
def range_product(t: Tables):
    return t.predictions().where(F.col("week").isin(*SEASON_WEEKS)).groupBy("week", "idx").agg(F.round(F.max("prob"), 6).alias("max_prob"), F.count_if(F.col("prob") >= 0.5).alias("n_cells"))


@query()
def predict_udf(t: Tables):
    """A small untrained network with all its heads over all cells in four weeks: species' scores, and the first feature of the environment."""
    points = grids.with_weeks(t.cells().select("cell", "lat", "lon"), list(SEASON_WEEKS))
    found = inference.predict(points, inference.random_weights(16, n_env=5, habitat=True))
    return found.select("lat", "lon", "week", F.col("env")[0].alias("env_0"), F.posexplode("probs").alias("idx", "prob"))
