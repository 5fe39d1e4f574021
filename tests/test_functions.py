import datetime
import math

import pytest
from pyspark.sql import functions as F

from phenogrid.functions import calendar, geo, names, scalars
from phenogrid.operators import cleaning, grids, metrics, regions


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_weeks(spark):
    days = [1, 7, 8, 14, 15, 21, 22, 28, 29, 30, 31]
    rows = [(m, d) for m in (1, 2, 12) for d in days]
    got = values(spark, rows, "m int, d int", "m", "d", calendar.week_of(F.col("d"), F.col("m")))
    for m, d, w in got:
        assert w == (m - 1) * 4 + min(4, -(-d // 7))
    assert values(spark, [(0, 1), (13, 1), (1, 0), (None, 3)], "m int, d int", calendar.week_of(F.col("d"), F.col("m"))) == [(None,)] * 4
    assert values(spark, [(datetime.date(2024, 12, 31),)], "x date", calendar.week_of_date(F.col("x"))) == [(48,)]


def test_longitudes(spark):
    got = values(spark, [(x,) for x in (181.0, -181.0, 540.0, 180.0, -180.0, 0.0)], "x double", geo.wrap_lon(F.col("x")))
    assert [g[0] for g in got] == [-179.0, 179.0, -180.0, -180.0, -180.0, 0.0]
    again = values(spark, got, "x double", geo.wrap_lon(F.col("x")))
    assert again == got


def test_distances(spark):
    (km,) = values(spark, [(0.0, 0.0, 0.0, 180.0)], "a double, b double, c double, d double", geo.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")))[0]
    assert abs(km - math.pi * geo.EARTH_KM) < 1e-6
    (chord,) = values(spark, [(1e6,)], "x double", geo.chord_km(F.col("x")))[0]
    assert abs(chord - 2 * geo.EARTH_KM * math.sin(1)) < 1e-9


def test_rings(spark):
    ring = geo.bbox_ring(F.col("x") - 1, F.lit(0.0), F.col("x") + 1, F.lit(2.0))
    out = spark.createDataFrame([(10.0,)], "x double").select(ring.alias("r")).select(*[c.alias(f"c{i}") for i, c in enumerate(geo.ring_centroid(F.col("r")))], geo.ring_span(F.col("r")).alias("s")).first()
    assert abs(out["c0"] - 10) < 1e-9 and abs(out["c1"] - 1) < 1e-9 and out["s"] == 2


def test_names(spark):
    rows = [("Parus major",), ("Parus",), ("Parus major minor",), ("Parus  major",), ("Parus ",)]
    assert [r[0] for r in values(spark, rows, "n string", names.is_binomial(F.col("n")))] == [True, False, False, False, True]
    ids = [("c1", 5, "A b"), ("", 5, "A b"), (None, None, " A B ")]
    assert [r[0] for r in values(spark, ids, "c string, k bigint, n string", names.primary_id(F.col("c"), F.col("k"), F.col("n")))] == ["c1", "5", "a b"]
    shown = [("Great tit", "Parus major", "x"), ("Parus major", "Parus major", "x"), (None, None, "x")]
    assert [r[0] for r in values(spark, shown, "c string, s string, k string", names.display_name(F.col("c"), F.col("s"), F.col("k")))] == ["Great tit (Parus major)", "Parus major", "x"]


def test_weights_at_the_ends(spark):
    assert [r[0] for r in values(spark, [(5.0,), (10.0,), (50.0,), (90.0,), (None,)], "p double", scalars.percentile_weight(F.col("p"), 10, 90, 0.1))] == [0.1, 0.1, 0.55, 1.0, None]
    assert values(spark, [(5.0,)], "p double", scalars.percentile_weight(F.col("p"), 9, 9, 0.2)) == [(0.2,)]


def test_cleaning(spark):
    raw = [("1.0005", "2", "8", "1", "7", "Parus major", "AVES"), ("abc", "2", "8", "1", "7", "Parus major", "Aves"), ("1", "2", "8", "NA", "7", "Parus major", "Aves"), ("1", "2", "8", "1", "7", "parus major", "Aves"), ("1", "2", "8", "1", "7", "Parus major", None), ("1", "2", "40", "1", "7", "Parus major", "Aves")]
    df = spark.createDataFrame(raw, ", ".join(f"`{c}` string" for c in cleaning.RAW_COLUMNS))
    tax = spark.createDataFrame([("Parus major", "")], "sci_name string, com_name string")
    assert [tuple(r) for r in cleaning.clean(df, tax, ["aves"]).collect()] == [(1.001, 2.0, 7, "Parus major", "Parus major", 2, "AVES")]


def test_grids(spark):
    assert grids.centres(0, 1, 5) == [0.5] and grids.centres(0, 1, 5, midpoint=False) == [] and grids.centres(0, 10, 5) == [2.5, 7.5]
    assert sorted(tuple(r) for r in grids.grid_points(spark, (0.0, 0.0, 10.0, 1.0), 5.0).collect()) == [(0.5, 2.5), (0.5, 7.5)]
    assert grids.grid_points(spark, (0.0, 0.0, 10.0, 1.0), 5.0, midpoint=False).count() == 0


def test_regions():
    assert regions.resolve(None) is None and regions.resolve(["Europe"]) == (-25.0, 34.0, 45.0, 72.0) and regions.resolve(["nowhere"]) is None
    assert regions.resolve(["1", "2", "3", "4"]) == (1.0, 2.0, 3.0, 4.0) and regions.resolve(["1", "b", "3", "4"]) is None and regions.resolve(["1", "2"]) is None
    with pytest.warns(UserWarning):
        assert regions.holdout_boxes(["UK", "atlantis"]) == [(-8.2, 49.9, 1.8, 58.7)]


def test_composite_score(spark):
    schema = ", ".join(f"{n} double" for n in metrics.SCORE_WEIGHTS)
    none = [None] * 7
    rows = [none, [0.5] + none[1:], none[:5] + [4.0, None], none[:6] + [-1.0], [float("nan")] + [0.5] + none[2:]]
    got = [r["score"] for r in metrics.composite_score(spark.createDataFrame(rows, schema)).collect()]
    assert got == [0.0, 0.5, 0.25, 0.0, 0.5]


def test_percentile_and_precision(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("b", 1), ("c", 1), ("c", 2)], "g string, v int")
    got = sorted((r["g"], r["v"], r["pct"]) for r in metrics.strict_percentile(df, ["g"], "v").collect())
    assert got == [("a", 1, 50.0), ("b", 1, 0.0), ("b", 1, 0.0), ("c", 1, 0.0), ("c", 2, 50.0)]
    scored = spark.createDataFrame([(1, 0.5, 1, False), (1, 0.5, 0, True), (2, 0.1, 0, False), (3, 0.2, 0, True), (3, 0.1, 1, True)], "s int, prob double, tie int, label boolean")
    assert {r["s"]: r["ap"] for r in metrics.average_precision(scored, "s", "tie").collect()} == {1: 1.0, 3: 1.0}
