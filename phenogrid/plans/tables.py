"""The engine's tables, derived from the driver's by integer arithmetic.

Each method of ``Tables`` has a common table expression of the same name in
``CTE``, so that queries and their SQL start from equal rows.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.functions import calendar
from phenogrid.operators.regions import SAMPLING_REGIONS, region_table
from phenogrid.operators.totals import text_ranks

N_SPECIES = 64  # of the predictions


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def folder(self) -> str:
        """A new folder in the shared store that the cluster names; in local mode a temporary one where it names none."""
        shared = self.spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not self.spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return f"{shared or tempfile.mkdtemp(prefix='files-')}/files-{uuid.uuid4().hex}"

    def cells(self) -> DataFrame:
        """Cells over the whole globe, with some values missing."""
        return self.read("customer").selectExpr(
            "c_custkey as cell", "(c_custkey * 7919 % 18001) / 100 - 90 as lat", "(c_custkey * 104729 % 36001) / 100 - 180 as lon",
            "case when c_custkey % 13 = 0 then null else c_acctbal end as elevation",
            "case when c_custkey % 11 = 0 then null else c_nationkey % 17 + 1 end as landcover",
            "case when c_custkey % 17 = 0 then null else (c_custkey % 101) / 100 end as water",
            "(c_custkey % 97) / 96 as urban",
        )

    def compact(self) -> DataFrame:
        """Cells within 30 degrees of the origin."""
        return self.read("customer").selectExpr("c_custkey as cell", "(c_custkey * 7919 % 6001) / 100 - 30 as lat", "(c_custkey * 104729 % 6001) / 100 - 30 as lon", "case when c_custkey % 13 = 0 then null else c_acctbal end as elevation", "cast(c_nationkey as double) as landcover")

    def taxonomy(self) -> DataFrame:
        """Species codes and names; every seventh name is missing, some common names are empty."""
        names = self.read("part").select(F.col("p_name").alias("sci_name")).distinct()
        coded = text_ranks(names, "sci_name", "n")
        return coded.where("n % 7 <> 0").selectExpr(
            "cast(n as int) as n", "case when n % 10 = 3 then '' else concat('sp', lpad(cast(n as string), 4, '0')) end as species_code", "sci_name",
            "case when n % 5 = 0 then '' when n % 5 = 1 then sci_name else concat('the ', sci_name) end as com_name", "case when n % 3 = 0 then 'Mammalia' else 'Aves' end as class_name",
        )

    def occurrence(self) -> DataFrame:
        """Observations: cell, week, name, class and key of a line item's part."""
        o = self.read("orders").select("o_orderkey", F.col("o_custkey").alias("cell"), calendar.week_of_date(F.col("o_orderdate")).alias("week"))
        line = self.read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("taxon_key"))
        p = self.read("part").select(F.col("p_partkey").alias("taxon_key"), F.col("p_name").alias("name"), F.col("p_type").alias("class"))
        return line.join(o, "o_orderkey").join(p, "taxon_key").select("cell", "week", "name", "class", "taxon_key")

    def presence(self) -> DataFrame:
        """Distinct (cell, week, species), species by name."""
        return self.occurrence().select("cell", "week", F.col("name").alias("species")).distinct()

    def sets(self) -> DataFrame:
        """Sorted species of each cell and week."""
        from phenogrid.operators.presence import species_sets

        return species_sets(self.presence())

    def evaluation(self) -> DataFrame:
        """Scored labels: sample, species, prob, label, tie, logit, target."""
        return self.read("events").selectExpr(
            "user_id as sample", "event_type as species", "event_id as tie", "(event_id * 7919 % 1000) / 1000 as prob", "value > 100 as label",
            "cast(event_id * 31 % 161 as double) / 10 - 8 as logit", "case when value > 100 then 1.0D else 0.0D end as target", "user_id % 50 as density",
        )

    def labels(self) -> DataFrame:
        """Model labels of the taxonomy: idx, code, sci, com."""
        return self.taxonomy().selectExpr("n - 1 as idx", "concat('sp', lpad(cast(n as string), 4, '0')) as code", "sci_name as sci", "case when com_name = '' then sci_name else com_name end as com")

    def boxes(self) -> DataFrame:
        """A box of some degrees for each supplier."""
        low = self.read("supplier").selectExpr("s_suppkey as name", "(s_suppkey * 104729 % 3400) / 10 - 170 as lon_min", "(s_suppkey * 7919 % 1600) / 10 - 80 as lat_min")
        return low.selectExpr("name", "lon_min", "lat_min", "lon_min + 3 + name % 5 as lon_max", "lat_min + 2 + name % 4 as lat_max")

    def predictions(self) -> DataFrame:
        """Scores of species at cells and weeks: a whole number of thousandths from the quantities ordered there."""
        o = self.read("orders").select("o_orderkey", F.col("o_custkey").alias("cell"), calendar.week_of_date(F.col("o_orderdate")).alias("week"))
        line = self.read("lineitem").selectExpr("l_orderkey as o_orderkey", f"cast(l_partkey % {N_SPECIES} as int) as idx", "cast(l_quantity as bigint) as q")
        sums = line.join(o, "o_orderkey").groupBy("cell", "week", "idx").agg(F.sum("q").alias("q"))
        return sums.join(self.cells().select("cell", "lat", "lon"), "cell").selectExpr("cell", "lat", "lon", "week", "idx", "(q * 37 + week * 7 + idx * 13) % 1000 / 1000 as prob")

    def regions(self) -> DataFrame:
        return region_table(self.spark, SAMPLING_REGIONS)


WEEK_SQL = "CAST((month(o_orderdate) - 1) * 4 + CASE WHEN day(o_orderdate) <= 7 THEN 1 WHEN day(o_orderdate) <= 14 THEN 2 WHEN day(o_orderdate) <= 21 THEN 3 ELSE 4 END AS INTEGER)"

CTE = {
    "cells": """cells AS (SELECT c_custkey AS cell, (c_custkey * 7919 % 18001)::DOUBLE / 100 - 90 AS lat, (c_custkey * 104729 % 36001)::DOUBLE / 100 - 180 AS lon,
 CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS elevation, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey % 17 + 1 END AS landcover,
 CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE (c_custkey % 101)::DOUBLE / 100 END AS water, (c_custkey % 97)::DOUBLE / 96 AS urban FROM customer)""",
    "compact": "compact AS (SELECT c_custkey AS cell, (c_custkey * 7919 % 6001)::DOUBLE / 100 - 30 AS lat, (c_custkey * 104729 % 6001)::DOUBLE / 100 - 30 AS lon, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS elevation, c_nationkey::DOUBLE AS landcover FROM customer)",
    "taxonomy": """taxonomy AS (SELECT CAST(n AS INTEGER) AS n, CASE WHEN n % 10 = 3 THEN '' ELSE 'sp' || lpad(CAST(n AS VARCHAR), 4, '0') END AS species_code, sci_name,
 CASE WHEN n % 5 = 0 THEN '' WHEN n % 5 = 1 THEN sci_name ELSE 'the ' || sci_name END AS com_name, CASE WHEN n % 3 = 0 THEN 'Mammalia' ELSE 'Aves' END AS class_name
 FROM (SELECT sci_name, dense_rank() OVER (ORDER BY sci_name) AS n FROM (SELECT DISTINCT p_name AS sci_name FROM part)) WHERE n % 7 <> 0)""",
    "occurrence": f"occurrence AS (SELECT o_custkey AS cell, {WEEK_SQL} AS week, p_name AS name, p_type AS class, p_partkey AS taxon_key FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)",
    "presence": "presence AS (SELECT DISTINCT cell, week, name AS species FROM occurrence)",
    "sets": "sets AS (SELECT cell, week, list_sort(list(species)) AS species FROM presence GROUP BY cell, week)",
    "evaluation": "evaluation AS (SELECT user_id AS sample, event_type AS species, event_id AS tie, (event_id * 7919 % 1000)::DOUBLE / 1000 AS prob, value > 100 AS label, (event_id * 31 % 161)::DOUBLE / 10 - 8 AS logit, CASE WHEN value > 100 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target, user_id % 50 AS density FROM events)",
    "labels": "labels_t AS (SELECT n - 1 AS idx, 'sp' || lpad(CAST(n AS VARCHAR), 4, '0') AS code, sci_name AS sci, CASE WHEN com_name = '' THEN sci_name ELSE com_name END AS com FROM taxonomy)",
    "boxes": "boxes AS (SELECT *, lon_min + 3 + name % 5 AS lon_max, lat_min + 2 + name % 4 AS lat_max FROM (SELECT s_suppkey AS name, (s_suppkey * 104729 % 3400)::DOUBLE / 10 - 170 AS lon_min, (s_suppkey * 7919 % 1600)::DOUBLE / 10 - 80 AS lat_min FROM supplier))",
    "predictions": f"pred AS (SELECT cell, lat, lon, week, idx, CAST((q * 37 + week * 7 + idx * 13) % 1000 AS DOUBLE) / 1000 AS prob FROM (SELECT o_custkey AS cell, {WEEK_SQL} AS week, CAST(l_partkey % {N_SPECIES} AS INTEGER) AS idx, sum(CAST(l_quantity AS BIGINT)) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) JOIN cells USING (cell))",
    "regions": "regions(region_id, name, lon_min, lat_min, lon_max, lat_max) AS (VALUES " + ", ".join(f"({i}, '{n}', {b[0]}::DOUBLE, {b[1]}::DOUBLE, {b[2]}::DOUBLE, {b[3]}::DOUBLE)" for i, (n, b) in enumerate(SAMPLING_REGIONS.items())) + ")",
}
NEEDS = {"presence": ["occurrence"], "sets": ["presence"], "labels": ["taxonomy"], "predictions": ["cells"]}


def sql(body: str, *ctes: str, more: str = "", recursive: bool = False) -> str:
    """``body`` after the named table expressions and what they need; ``more`` has further ones."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in ctes:
        add(name)
    parts = [CTE[n] for n in order] + ([more] if more else [])
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else "") + body
