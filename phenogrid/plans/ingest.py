"""Queries of reading, cleaning, names and scalar columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from phenogrid.functions import calendar, geo, names, scalars
from phenogrid.operators import cleaning
from phenogrid.operators.regions import SAMPLING_REGIONS
from phenogrid.operators.sampling import in_boxes
from phenogrid.plans.tables import WEEK_SQL, Tables, sql
from phenogrid.sources import archive, readers, writers

QUERIES: dict = {}


def query(text: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = (f, text)
        return f

    return keep


RAW = ["decimalLatitude", "decimalLongitude", "day", "month", "taxonKey", "verbatimScientificName", "class"]


def raw_lines(t: Tables):
    """Tab-separated lines with bad numbers, blanks, short and long rows, as an archive has them."""
    return t.read("part").selectExpr(
        "p_partkey",
        """concat_ws('\t', case when p_partkey % 19 = 0 then 'abc' else cast((p_partkey * 7919 % 18001) / 100 - 90 as string) end,
        case when p_partkey % 23 = 0 then '' else cast((p_partkey * 104729 % 36001) / 100 - 180 as string) end, cast(p_partkey % 28 + 1 as string),
        case when p_partkey % 29 = 0 then 'NA' else cast(p_partkey % 12 + 1 as string) end, cast(p_partkey as string), p_name,
        case when p_partkey % 2 = 0 then 'AVES' else 'Mammalia' end, case when p_partkey % 31 = 0 then 'extra' end) as line""",
    ).selectExpr("p_partkey", "case when p_partkey % 37 = 0 then substring_index(line, '\t', 4) else line end as line")


def tsv_file(t: Tables) -> str:
    """The lines as tab-separated text files, each under a header."""
    path = f"{t.folder()}/occurrence"
    lines = raw_lines(t).select(F.col("line").alias("\t".join(RAW)))
    lines.write.csv(path, header=True, sep="\u0001", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def archives(t: Tables) -> str:
    """Zip archives of the lines, in members of some thousand lines with a header each."""
    folder = t.folder()
    archive.write_archives(raw_lines(t).repartition(3, "p_partkey").select("line"), folder, header="\t".join(RAW), lines_per_member=2000)
    return folder


RAW_SQL = """raw AS (SELECT p_partkey, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE (p_partkey * 7919 % 18001)::DOUBLE / 100 - 90 END AS lat,
 CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE (p_partkey * 104729 % 36001)::DOUBLE / 100 - 180 END AS lon, p_partkey % 28 + 1 AS day,
 CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE p_partkey % 12 + 1 END AS month, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'AVES' ELSE 'Mammalia' END AS class FROM part WHERE p_partkey % 37 <> 0)"""
RAW_WEEK = "CAST((month - 1) * 4 + CASE WHEN day <= 7 THEN 1 WHEN day <= 14 THEN 2 WHEN day <= 21 THEN 3 ELSE 4 END AS INTEGER)"


@query(sql(f"SELECT p_partkey AS \"taxonKey\", round(lat, 3) AS latitude, round(lon, 3) AS longitude, {RAW_WEEK} AS week, class FROM raw WHERE lat IS NOT NULL AND lon IS NOT NULL AND month IS NOT NULL", more=RAW_SQL))
def scan_tsv(t: Tables):
    """Members of archives, each unpacked by a task of its own, without their headers."""
    lines = archive.read_archive(t.spark, archives(t), "occurrence-*.txt").where("line_no > 0")
    rows = cleaning.drop_incomplete(readers.parse_tsv(lines, RAW, RAW))
    return rows.select(F.expr("try_cast(taxonKey as bigint)").alias("taxonKey"), F.round(F.expr("try_cast(decimalLatitude as double)"), 3).alias("latitude"), F.round(F.expr("try_cast(decimalLongitude as double)"), 3).alias("longitude"), calendar.week_of(F.col("day").cast("int"), F.col("month").cast("int")).alias("week"), "class").where("latitude is not null and longitude is not null")


@query("SELECT count(*) AS n_rows, count(*) - count(*) FILTER (WHERE p_partkey % 37 = 0) AS n_complete, count(*) FILTER (WHERE p_partkey % 31 = 0 AND p_partkey % 37 <> 0) AS n_long FROM part")
def scan_tsv_permissive(t: Tables):
    """A file with short and long rows: none is dropped, long ones are cut."""
    path = tsv_file(t)
    rows = readers.read_tsv(t.spark, path, RAW)
    long_ = t.spark.read.text(path).agg(F.count_if(F.size(F.split("value", "\t")) > len(RAW)).alias("n_long"))
    return rows.agg(F.count("*").alias("n_rows"), F.count("class").alias("n_complete")).crossJoin(F.broadcast(long_))


@query("SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS price, o_orderpriority AS priority FROM orders")
def scan_csv_project(t: Tables):
    """Gzipped CSV files, written and read back: some columns of each."""
    path = f"{t.folder()}/orders"
    t.read("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority").write.csv(path, header=True, compression="gzip")
    rows = t.spark.read.csv(path, header=True, schema="o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string")
    return rows.select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))


PART_ROWS = 100


def part_files(t: Tables) -> str:
    """Part files of customers, of suppliers, which lack a column, and one that is broken."""
    folder = t.folder()
    rows = t.read("customer").selectExpr("c_custkey as k", "c_name as name", "c_acctbal as bal", "c_mktsegment as segment")
    writers.write_chunks(rows.withColumn("chunk", F.expr(f"(k - 1) div {10 * PART_ROWS}")), folder, "chunk")
    rows = t.read("supplier").selectExpr("s_suppkey as k", "s_name as name", "s_acctbal as bal")
    writers.write_chunks(rows.withColumn("chunk", F.expr(f"5000 + (k - 1) div {PART_ROWS}")), folder, "chunk")
    place = t.spark._jvm.org.apache.hadoop.fs.Path
    broken = place(folder).getFileSystem(t.spark._jsc.hadoopConfiguration()).create(place(folder, "grid_5km_chunk_9999.parquet"))
    broken.writeBytes("PAR1 and no more")
    broken.close()
    return folder


@query("SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier")
def union_parts(t: Tables):
    """Rows of all part files of a folder that can be read, under one schema."""
    return readers.read_parts(t.spark, part_files(t)).select("k", "name", "bal", "segment")


@query(f"""SELECT printf('grid_5km_chunk_%04d.parquet', chunk) AS file, n_rows, false AS skipped FROM (
 SELECT (c_custkey - 1) // {10 * PART_ROWS} AS chunk, count(*) AS n_rows FROM customer GROUP BY ALL UNION ALL SELECT 5000 + (s_suppkey - 1) // {PART_ROWS}, count(*) FROM supplier GROUP BY ALL)
 UNION ALL SELECT 'grid_5km_chunk_9999.parquet', 0, true""")
def scan_parts(t: Tables):
    """What was taken from each part file, and which was skipped."""
    return readers.parts_report(t.spark, part_files(t))


@query("SELECT n_name AS name, n_regionkey AS region, CAST(NULL AS INTEGER) AS nation FROM nation UNION ALL SELECT r_name, NULL, r_regionkey FROM region")
def union_by_name(t: Tables):
    a = t.read("nation").selectExpr("n_name as name", "n_regionkey as region")
    return a.unionByName(t.read("region").selectExpr("r_name as name", "r_regionkey as nation"), allowMissingColumns=True)


@query("SELECT lower(trim(p_name)) AS name_key, max(p_partkey) AS line_no, arg_max(p_brand, p_partkey) AS brand FROM part GROUP BY ALL")
def taxonomy_dedupe_last(t: Tables):
    rows = t.read("part").selectExpr("case when p_partkey % 2 = 0 then upper(p_name) else p_name end as sci_name", "p_partkey as line_no", "p_brand as brand")
    return cleaning.dedupe_taxonomy(rows).select("name_key", "line_no", "brand")


@query(sql("SELECT idx, code, CASE WHEN idx % 3 = 0 THEN code ELSE sci END AS sci, CASE WHEN idx % 3 = 0 THEN code WHEN idx % 3 = 1 THEN sci ELSE com END AS com FROM labels_t", "labels"))
def labels_fallback(t: Tables):
    line = t.labels().selectExpr("idx", "case idx % 3 when 0 then code when 1 then concat_ws('\t', code, sci) else concat_ws('\t', code, sci, com) end as line")
    return line.select("idx", *readers.label_fields(F.col("line")))


@query("SELECT c_custkey AS cell, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END, nullif((c_custkey % 5)::DOUBLE, 0)) AS elevation FROM customer")
def coalesce_sources(t: Tables):
    rows = t.read("customer").selectExpr("c_custkey as cell", "case when c_custkey % 3 = 0 then null else c_acctbal end as fine", "cast(c_custkey % 5 as double) as coarse")
    return rows.select("cell", F.coalesce("fine", F.nullif(F.col("coarse"), F.lit(0.0))).alias("elevation"))


@query("SELECT c_custkey AS cell, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 3 = 0 THEN c_name END, 'none') AS prop FROM customer")
def coalesce_props(t: Tables):
    return t.read("customer").select(F.col("c_custkey").alias("cell"), F.coalesce(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")), F.lit("none")).alias("prop"))


@query(f"SELECT o_orderkey, {WEEK_SQL} AS week FROM orders")
def week_of_date(t: Tables):
    return t.read("orders").select("o_orderkey", calendar.week_of_date(F.col("o_orderdate")).alias("week"))


@query(sql("""SELECT p_partkey, TRY_CAST(CASE p_partkey % 4 WHEN 0 THEN 'abc' WHEN 1 THEN '' WHEN 2 THEN '1e2' ELSE CAST(p_partkey AS VARCHAR) END AS DOUBLE) AS x FROM part"""))
def try_cast_coords(t: Tables):
    rows = t.read("part").selectExpr("p_partkey", "case p_partkey % 4 when 0 then 'abc' when 1 then '' when 2 then '1e2' else cast(p_partkey as string) end as s")
    return rows.selectExpr("p_partkey", "try_cast(s as double) as x")


@query("SELECT p_partkey, round(p_retailprice / 7, 3) AS x FROM part")
def round_coords(t: Tables):
    return t.read("part").select("p_partkey", F.round(F.col("p_retailprice") / 7, 3).alias("x"))


@query(sql("SELECT taxon_key, name, coalesce(nullif(com_name, ''), name) AS common FROM (SELECT p_partkey AS taxon_key, p_name AS name FROM part) p LEFT JOIN taxonomy ON sci_name = name", "taxonomy"))
def name_default(t: Tables):
    parts = t.read("part").selectExpr("p_partkey as taxon_key", "p_name as name")
    return parts.join(t.taxonomy().withColumnRenamed("sci_name", "name"), "name", "left").select("taxon_key", "name", names.or_self(F.col("com_name"), F.col("name")).alias("common"))


@query(sql("SELECT p_partkey AS k, coalesce(nullif(trim(species_code), ''), CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) END, lower(trim(p_name))) AS species FROM part LEFT JOIN taxonomy ON lower(sci_name) = lower(trim(p_name))", "taxonomy"))
def primary_id(t: Tables):
    parts = t.read("part").withColumn("name_key", names.key(F.col("p_name")))
    joined = parts.join(t.taxonomy().withColumn("name_key", F.lower("sci_name")), "name_key", "left")
    return joined.select(F.col("p_partkey").alias("k"), names.primary_id(F.col("species_code"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")), F.col("p_name")).alias("species"))


@query(sql("SELECT n, species_code || chr(9) || sci_name || chr(9) || coalesce(nullif(com_name, ''), sci_name) AS line FROM taxonomy", "taxonomy"))
def label_line(t: Tables):
    return t.taxonomy().select("n", names.label_line(F.col("species_code"), F.col("sci_name"), F.col("com_name")).alias("line"))


@query(sql("SELECT n, CASE WHEN com_name <> sci_name THEN com_name || ' (' || sci_name || ')' ELSE sci_name END AS display FROM (SELECT n, sci_name, nullif(com_name, '') AS com_name FROM taxonomy)", "taxonomy"))
def display_name(t: Tables):
    return t.taxonomy().select("n", names.display_name(F.nullif(F.col("com_name"), F.lit("")), F.col("sci_name"), F.col("species_code")).alias("display"))


@query("SELECT c_custkey AS cell, (c_custkey % 101)::DOUBLE / 100 AS occurrence, c_acctbal / 10 AS temperature FROM customer")
def unit_rescale(t: Tables):
    return t.read("customer").select(F.col("c_custkey").alias("cell"), (F.col("c_custkey") % 101 / 100).alias("occurrence"), (F.col("c_acctbal") / 10).alias("temperature"))


@query(sql("SELECT cell, CASE WHEN urban > 0.5 THEN 13 ELSE landcover END AS landcover FROM cells", "cells"))
def class_override(t: Tables):
    return t.cells().select("cell", F.when(F.col("urban") > 0.5, 13).otherwise(F.col("landcover")).alias("landcover"))


@query("SELECT l_suppkey AS cell, round(avg(CASE WHEN l_partkey % 17 + 1 IN (13, 14) THEN 1.0 ELSE 0.0 END), 6) AS built_fraction FROM lineitem GROUP BY 1")
def built_fraction(t: Tables):
    built = (F.col("l_partkey") % 17 + 1).isin(*names.BUILT_CODES).cast("int")
    return t.read("lineitem").groupBy(F.col("l_suppkey").alias("cell")).agg(F.round(F.avg(built), 6).alias("built_fraction"))


@query("SELECT c_custkey AS cell, round(((c_custkey * 37 % 2000 - 1000 + 180.0)::DOUBLE % 360 + 360) % 360 - 180, 6) AS lon FROM customer")
def wrap_lon(t: Tables):
    return t.read("customer").select(F.col("c_custkey").alias("cell"), F.round(geo.wrap_lon((F.col("c_custkey") * 37 % 2000 - 1000).cast("double")), 6).alias("lon"))


HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))))"


@query(sql(f"SELECT a.cell AS a, b.cell AS b, round({HAVERSINE.format(a='a.', b='b.')}, 6) AS km FROM cells a JOIN cells b ON b.cell = a.cell + 1", "cells"))
def haversine(t: Tables):
    a = t.cells().select("cell", "lat", "lon")
    b = a.select((F.col("cell") - 1).alias("cell"), F.col("cell").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return a.join(b, "cell").select(F.col("cell").alias("a"), "b", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 6).alias("km"))


@query("SELECT c_custkey AS cell, round(2 * 6371.0 * sin(least(1.0, greatest(0.0, (c_custkey * 17 % 20000)::DOUBLE / (2 * 6371.0)))), 6) AS chord FROM customer")
def chord_distance(t: Tables):
    return t.read("customer").select(F.col("c_custkey").alias("cell"), F.round(geo.chord_km((F.col("c_custkey") * 17 % 20000).cast("double")), 6).alias("chord"))


@query(sql("""SELECT cell, CAST(i AS INTEGER) AS i, round(CASE WHEN i < 8 THEN sin((i + 1) * radians(lat)) ELSE cos((i - 7) * radians(lat)) END, 6) + 0.0 AS x
FROM cells CROSS JOIN range(0, 16) b(i)""", "cells"))
def circular_encoding(t: Tables):
    encoded = scalars.circular_encoding(F.radians("lat"), 8)
    return t.cells().select("cell", F.posexplode(encoded).alias("i", "x")).select("cell", "i", (F.round("x", 6) + 0.0).alias("x"))


@query(sql("SELECT tie, round(1 / (1 + exp(-least(30.0, greatest(-30.0, logit * 6)))), 6) AS p FROM evaluation", "evaluation"))
def sigmoid(t: Tables):
    return t.evaluation().select("tie", F.round(scalars.sigmoid(F.col("logit") * 6), 6).alias("p"))


@query(sql("SELECT tie, round(CASE WHEN (SELECT max(prob) FROM evaluation) > 0 THEN sqrt(prob / (SELECT max(prob) FROM evaluation)) ELSE 0 END, 6) AS p FROM evaluation", "evaluation"))
def perceptual_norm(t: Tables):
    from phenogrid.operators.ranking import over_maximum

    m = F.col("max_value")
    return over_maximum(t.evaluation(), "prob").select("tie", F.round(F.when(m > 0, F.pow(F.col("prob") / m, F.lit(0.5))).otherwise(0.0), 6).alias("p"))


@query(f"""SELECT o_orderkey, week, 'Week ' || week || ' (' || ['early', 'mid', 'late', 'late'][CAST((week - 1) % 4 + 1 AS INTEGER)] || ' ' || ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'][CAST((week - 1) // 4 + 1 AS INTEGER)] || ')' AS label FROM (SELECT o_orderkey, {WEEK_SQL} AS week FROM orders)""")
def week_text(t: Tables):
    weeks = t.read("orders").select("o_orderkey", calendar.week_of_date(F.col("o_orderdate")).alias("week"))
    return weeks.select("o_orderkey", "week", calendar.week_text(F.col("week")).alias("label"))


@query("SELECT DISTINCT event_type AS name, array_to_string(list_transform(string_split(replace(event_type, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS pretty FROM events")
def prettify(t: Tables):
    return t.read("events").select(F.col("event_type").alias("name")).distinct().select("name", names.prettify(F.col("name")).alias("pretty"))


@query(sql("SELECT cell, CASE WHEN code IN (0, 17, 254, 255) THEN 'Water' ELSE v END AS name FROM (SELECT cell, cell % 20 AS code FROM cells) LEFT JOIN names ON k = code", "cells", more="names(k, v) AS (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in names.LANDCOVER_NAMES.items()) + ")"))
def landcover_name(t: Tables):
    return t.cells().select("cell", names.landcover_name((F.col("cell") % 20).cast("int")).alias("name"))


@query("SELECT c_custkey AS cell, round(CASE WHEN p >= 90 THEN 1.0 WHEN p > 10 THEN 0.1 + (p - 10) / 80.0 * 0.9 ELSE 0.1 END, 6)::DOUBLE AS weight FROM (SELECT c_custkey, (c_custkey % 101)::DOUBLE AS p FROM customer)")
def freq_weight_map(t: Tables):
    return t.read("customer").select(F.col("c_custkey").alias("cell"), F.round(scalars.percentile_weight((F.col("c_custkey") % 101).cast("double"), 10, 90, 0.1), 6).alias("weight"))


@query()
def jitter(t: Tables):
    """Coordinates moved at random by about 0.4 of a cell's edge, latitude held to the globe, longitude wrapped."""
    sd = 0.4 * 25.0 / 111.0
    return t.cells().select("cell", F.least(F.lit(90.0), F.greatest(F.lit(-90.0), F.col("lat") + F.randn(42) * sd)).alias("lat"), geo.wrap_lon(F.col("lon") + F.randn(43) * sd).alias("lon"))


VARIABLES = ["urban_fraction", "LC: Grasslands", "elevation_m", "latitude", "ndvi", "precipitation_mm", "longitude", "canopy_height_m", "temperature_c", "water_fraction"]
VARIABLE = "element_at(array(" + ", ".join(f"'{v}'" for v in VARIABLES) + "), cast(event_id % 10 as int) + 1)"


@query("SELECT user_id, array_to_string(list(name ORDER BY g, event_id), ',') AS names FROM (SELECT user_id, event_id, name, CASE WHEN name LIKE 'latitude%' OR name LIKE 'longitude%' THEN 0 WHEN name LIKE 'temperature%' OR name LIKE 'precipitation%' THEN 1 WHEN name LIKE 'elevation%' OR name LIKE 'canopy%' THEN 2 WHEN name LIKE 'water_fraction%' OR name LIKE 'urban_fraction%' THEN 3 WHEN name LIKE 'LC:%' THEN 4 ELSE 5 END AS g FROM (SELECT user_id, event_id, " + str(VARIABLES) + "[CAST(event_id % 10 AS INTEGER) + 1] AS name FROM events)) GROUP BY user_id")
def group_order(t: Tables):
    """Variables that each user's events name, group by group, in the order of the events."""
    rows = t.read("events").selectExpr("user_id", "event_id", f"{VARIABLE} as name")
    place = F.struct(names.group_order(F.col("name")).alias("g"), "event_id", "name")
    return rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["name"]), ",").alias("names"))


@query(sql("SELECT cell, CAST(least(5, greatest(0, floor((lat + 90) / 30))) * 10 + least(5, greatest(0, floor((lon + 180) / 60))) AS INTEGER) AS bin FROM cells", "cells"))
def geo_bin(t: Tables):
    return t.cells().select("cell", geo.geo_bin(F.col("lat"), F.col("lon")).alias("bin"))


@query(sql("SELECT cell, CAST(CAST(floor(lat * 100 + 0.5) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor(lon * 100 + 0.5) AS BIGINT) AS VARCHAR) AS key FROM cells", "cells"))
def cell_rounding_id(t: Tables):
    from phenogrid.operators.grids import cell_key

    return t.cells().select("cell", cell_key(F.col("lat"), F.col("lon")).alias("key"))


@query(sql("SELECT p_partkey AS k, name FROM raw WHERE lon IS NOT NULL AND month IS NOT NULL", more=RAW_SQL))
def drop_incomplete(t: Tables):
    rows = cleaning.drop_incomplete(readers.parse_tsv(raw_lines(t), RAW, RAW, "line"))
    return rows.select(F.col("taxonKey").cast("long").alias("k"), F.col("verbatimScientificName").alias("name"))


@query(sql("SELECT p_partkey FROM part WHERE p_name IN (SELECT sci_name FROM taxonomy)", "taxonomy"))
def semi_taxonomy(t: Tables):
    return t.read("part").join(t.taxonomy(), F.col("p_name") == F.col("sci_name"), "left_semi").select("p_partkey")


@query("SELECT p_partkey, p_type FROM part WHERE lower(p_type) IN ('small', 'economy', 'promo')")
def class_filter(t: Tables):
    return t.read("part").where(F.lower("p_type").isin("small", "economy", "promo")).select("p_partkey", "p_type")


@query("SELECT p_partkey, name FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' x' WHEN 1 THEN replace(p_name, ' ', '') ELSE p_name END AS name FROM part) WHERE length(name) - length(replace(name, ' ', '')) = 1")
def binomial_filter(t: Tables):
    rows = t.read("part").selectExpr("p_partkey", "case p_partkey % 4 when 0 then concat(p_name, ' x') when 1 then replace(p_name, ' ', '') else p_name end as name")
    return rows.where(names.is_binomial(F.col("name")))


@query(sql("SELECT taxon_key, latitude, longitude, coalesce(nullif(com_name, ''), name) AS common, week FROM (SELECT p_partkey AS taxon_key, round(lat, 3) AS latitude, round(lon, 3) AS longitude, name, " + RAW_WEEK + " AS week FROM raw WHERE lat IS NOT NULL AND lon IS NOT NULL AND month IS NOT NULL AND class = 'AVES' AND length(name) - length(replace(name, ' ', '')) = 1) JOIN taxonomy ON sci_name = name", "taxonomy", more=RAW_SQL))
def clean_occurrences(t: Tables):
    rows = cleaning.clean(readers.parse_tsv(raw_lines(t), RAW, RAW, "line"), t.taxonomy(), ["Aves"])
    return rows.select(F.col("taxonKey").alias("taxon_key"), "latitude", "longitude", F.col("commonName").alias("common"), "week")


EUROPE_AFRICA = [SAMPLING_REGIONS["europe_west"], SAMPLING_REGIONS["africa_south"]]


@query(sql("SELECT cell FROM cells WHERE (lon BETWEEN -12 AND 15 AND lat BETWEEN 36 AND 62) OR (lon BETWEEN -18 AND 52 AND lat BETWEEN -35 AND -5)", "cells"))
def bbox_filter(t: Tables):
    return t.cells().where(in_boxes(F.col("lat"), F.col("lon"), EUROPE_AFRICA)).select("cell")


@query(sql("SELECT count(*) FILTER (WHERE prob >= 0.25) AS n_at_least, count(*) FILTER (WHERE prob > 0.25) AS n_above FROM evaluation", "evaluation"))
def prob_threshold(t: Tables):
    return t.evaluation().agg(F.count_if(F.col("prob") >= 0.25).alias("n_at_least"), F.count_if(F.col("prob") > 0.25).alias("n_above"))


@query(sql("SELECT cell FROM cells WHERE coalesce(water, 0) <= 0.9 OR CAST('0x' || substr(md5(CAST(cell AS VARCHAR) || '|42'), 1, 8) AS BIGINT)::DOUBLE / 4294967296 < 0.25", "cells"))
def ocean_downsample(t: Tables):
    return t.cells().where((F.coalesce("water", F.lit(0.0)) <= 0.9) | (scalars.draw_uniform(F.col("cell")) < 0.25)).select("cell")


@query(sql("SELECT quantile_cont(x, 0.02) AS vmin, quantile_cont(x, 0.98) AS vmax FROM (SELECT CASE WHEN cell % 3 <> 0 THEN 0.0::DOUBLE ELSE lat END AS x FROM cells) WHERE x <> 0", "cells"))
def robust_minmax(t: Tables):
    from phenogrid.operators.environment import robust_range

    return robust_range(t.cells().select(F.when(F.col("cell") % 3 != 0, 0.0).otherwise(F.col("lat")).alias("x")), "x")
