"""The hexagonal index against brute force."""

import math
import random

from pyspark.sql import functions as F

from phenogrid.functions import hexes
from phenogrid.operators import hexagons

LEVEL = 3
N, ROWS = hexes.columns(LEVEL), hexes.rows(LEVEL)


def centres():
    """Places on the map of all cells, by id."""
    most = math.ceil(ROWS + 2 / 3) - 1
    return {(LEVEL << 58) + (r + (1 << 28)) * (1 << 29) + q: ((q + r / 2) % N, r) for r in range(-most, most + 1) for q in range(N)}


def test_globe_lists_every_cell_once(spark):
    found = [r["hex"] for r in hexagons.globe(spark, LEVEL).collect()]
    assert len(found) == len(set(found)) and set(found) == set(centres())


def test_points_go_to_the_nearest_centre(spark):
    rng = random.Random(1)
    points = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(400)] + [(0.0, -180.0), (0.0, 180.0), (89.9, 0.0), (-90.0, 12.0)]
    rows = spark.createDataFrame(points, "lat double, lon double").withColumn("hex", hexes.point_cell(F.col("lat"), F.col("lon"), LEVEL)).collect()
    places = centres()
    # on the map of rows and columns a row is sqrt(3) / 2 of a column
    def apart(place, lat, lon):
        du = abs(place[0] - (lon + 180) * N / 360) % N
        return math.hypot(min(du, N - du), (place[1] - math.sin(math.radians(lat)) * ROWS) * math.sqrt(3) / 2)
    for r in rows:
        least = min(apart(p, r["lat"], r["lon"]) for p in places.values())
        assert apart(places[r["hex"]], r["lat"], r["lon"]) < least + 1e-9


def test_areas_are_equal_by_sampling(spark):
    """Points spread evenly over the sphere: cells that no pole cuts get equal shares."""
    rng = random.Random(2)
    points = [(math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for _ in range(200_000)]
    cells = spark.createDataFrame(points, "lat double, lon double").select(hexes.point_cell(F.col("lat"), F.col("lon"), 1).alias("hex")).where(hexes.whole(F.col("hex"), 1))
    counts = [r["count"] for r in cells.groupBy("hex").count().collect()]
    want = 200_000 * hexes.area_km2(1) / (4 * math.pi * 6371.0**2)
    assert all(abs(c - want) < 5 * math.sqrt(want) for c in counts)
    assert sum((c - want) ** 2 / want for c in counts) < 2 * len(counts)


def test_parents_and_children(spark):
    cells = hexagons.globe(spark, LEVEL).withColumn("up", hexes.parent(F.col("hex"), LEVEL))
    assert cells.where(~F.array_contains(hexes.children(F.col("up"), LEVEL - 1), F.col("hex"))).count() == 0
    inner = cells.where(F.abs(hexes.row_of(F.col("hex"))) < ROWS - 3).groupBy("up").count()
    assert {r["count"] for r in inner.join(cells.where(F.abs(hexes.row_of(F.col("hex"))) < ROWS - 6).select("up").distinct(), "up").collect()} == {4}
    # a cell's centre lies in its parent, or on its edge
    lat, lon = hexes.centre(F.col("hex"), LEVEL)
    at = cells.where(hexes.whole(F.col("hex"), LEVEL)).withColumn("near", hexes.point_cell(lat, lon, LEVEL - 1))
    assert at.where(hexes.distance(F.col("near"), F.col("up"), LEVEL - 1) > 1).count() == 0
    assert at.where("near = up").count() > 0.5 * at.count()


def test_neighbours(spark):
    cells = hexagons.globe(spark, LEVEL).withColumn("n", F.explode(hexes.neighbours(F.col("hex"), LEVEL)))
    back = cells.select(F.col("n").alias("hex"), F.col("hex").alias("n"))
    assert cells.exceptAll(back).count() == 0 and cells.where("hex = n").count() == 0
    assert cells.where(hexes.distance(F.col("hex"), F.col("n"), LEVEL) != 1).count() == 0
    sides = cells.groupBy("hex").count().groupBy("count").count().collect()
    assert {r[0] for r in sides} <= {4, 6} and {r[0]: r[1] for r in sides}[6] > 10 * N


def test_boundaries_meet(spark):
    """Every side of a cell is a side of one neighbour."""
    cells = hexagons.globe(spark, LEVEL).where(F.abs(hexes.row_of(F.col("hex"))) < ROWS - 2)
    lat, lon = hexes.centre(F.col("hex"), LEVEL)
    rows = cells.select("hex", hexes.boundary(F.col("hex"), LEVEL).alias("ring"), lat.alias("lat"), lon.alias("lon")).collect()
    sides = {}
    for r in rows:
        ring = [(round(p["lon"] % 360, 6) % 360, round(p["lat"], 6)) for p in r["ring"]]
        assert ring[0] == ring[-1] and len(set(ring)) == 6
        for a, b in zip(ring, ring[1:]):
            sides.setdefault(tuple(sorted((a, b))), []).append(r["hex"])
    assert {len(v) for v in sides.values()} <= {1, 2}
    assert sum(len(v) == 1 for v in sides.values()) == 4 * N  # zigzag of the two outer rows


def test_fill_against_every_centre(spark):
    rings = [
        (1, [(-20.0, -10.0), (35.0, 5.0), (10.0, 40.0), (-20.0, -10.0)]),
        (2, [(170.0, -20.0), (200.0, -20.0), (200.0, 30.0), (170.0, 30.0), (170.0, -20.0)]),
        (3, [(0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (20.0, 5.0), (0.0, 40.0), (0.0, 0.0)]),
        (4, [(0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.0)]),
    ]
    df = spark.createDataFrame([(i, [{"lon": x, "lat": y} for x, y in ring]) for i, ring in rings], "id int, ring array<struct<lon:double,lat:double>>")
    found = {(r["id"], r["hex"]) for r in hexagons.fill(df, LEVEL).collect()}

    def inside(ring, x, y):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 <= y) != (y2 <= y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
                odd = not odd
        return odd

    want = set()
    for cell, (u, v) in centres().items():
        if abs(v) <= ROWS:
            lat, lon = math.degrees(math.asin(v / ROWS)), u * 360 / N - 180
            want |= {(i, cell) for i, ring in rings if inside(ring, lon, lat) or inside(ring, lon + 360, lat)}
    assert found == want and len({i for i, _ in want}) >= 3


def test_points_halfway_between_centres_go_where_the_sql_puts_them(spark):
    """At every hundredth of a degree of latitude, on meridians through the middle and the edge of columns."""
    import duckdb

    from phenogrid.plans.hexagons import HEX, LEVEL as level

    places = spark.range(18001 * 48).selectExpr("id as cell", "id % 18001 / 100 - 90 as lat", "floor(id / 18001) * 7.5D - 180 as lon")
    found = places.select("cell", hexes.point_cell(F.col("lat"), F.col("lon"), level).alias("hex")).toPandas().sort_values("cell")["hex"]
    cells = "cells AS (SELECT i AS cell, (i % 18001)::DOUBLE / 100 - 90 AS lat, (i // 18001) * 7.5::DOUBLE - 180 AS lon FROM range(18001 * 48) r(i))"
    wanted = duckdb.sql(f"WITH {cells}, {HEX} SELECT hex FROM hex ORDER BY cell").fetchnumpy()["hex"]
    assert (found.to_numpy() == wanted).all()


def test_places_without_a_key_have_a_row_of_the_globe(spark, tmp_path):
    import duckdb

    from phenogrid.plans.hexagons import QUERIES
    from phenogrid.plans.tables import Tables

    duckdb.sql(f"COPY (SELECT CASE WHEN i % 5 > 0 THEN i END::BIGINT AS c_custkey, i::DOUBLE AS c_acctbal, i % 25 AS c_nationkey FROM range(100) r(i)) TO '{tmp_path}/customer.parquet'")
    query, text = QUERIES["hex_globe_rows"]
    found = [tuple(r) for r in query(Tables(spark, str(tmp_path))).collect()]
    wanted = duckdb.connect()
    wanted.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    assert (None, 0, 384) in found and set(found) == set(wanted.execute(text).fetchall()) and len(found) == len(set(found))
