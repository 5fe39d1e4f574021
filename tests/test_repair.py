"""Repaired rings against winding numbers on a raster."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from phenogrid.operators import repair
from phenogrid.sources import readers, writers


def winding(ring, x, y):
    total = 0
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay <= y) != (by <= y) and ax + (y - ay) / (by - ay) * (bx - ax) > x:
            total += 1 if by > ay else -1
    return total


def crossings(rings):
    """Pairs of sides that cross inside both."""
    sides = [(a, b) for r in rings for a, b in zip(r, r[1:])]

    def side(a, b, p):
        v = (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        return 0 if abs(v) < 1e-7 else 1 if v > 0 else -1

    return sum(side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0 for i, (a, b) in enumerate(sides) for c, d in sides[:i])


def drawn(rng, kind):
    n = rng.randint(3, 12)
    if kind == "lattice":
        return [(rng.randint(0, 6), rng.randint(0, 6)) for _ in range(n)]
    ring = [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(n)]
    return ring + ring if kind == "twice" else ring + ring[::-1][1:-1] if kind == "to and fro" else ring


@pytest.mark.parametrize("kind", ["free", "lattice", "twice", "to and fro"])
def test_rings_bound_what_was_wound_round(kind):
    rng = random.Random(kind)
    for _ in range(250):
        ring = drawn(rng, kind)
        rings = repair.valid_rings(ring)
        assert all(r[0] == r[-1] and len(set(r)) == len(r) - 1 and len(r) > 3 for r in rings), ring
        assert not crossings(rings), ring
        for _ in range(60):
            x, y = rng.uniform(-0.5, 10.5), rng.uniform(-0.5, 10.5)
            # an outer ring adds one and a hole takes one: never but 0 or 1
            assert sum(winding(r[:-1], x, y) for r in rings) == (winding(ring, x, y) != 0), (ring, x, y)


def test_areas_against_a_raster():
    rng = random.Random(9)
    for _ in range(10):
        ring = drawn(rng, "free")
        step = 0.05
        cells = sum(winding(ring, (i + 0.5) * step, (j + 0.5) * step) != 0 for i in range(200) for j in range(200))
        area = sum(map(repair.signed_area, repair.valid_rings(ring)))
        assert abs(cells * step * step - area) < 0.05 * max(area, 4)


def test_known_faults():
    assert repair.valid_rings([(0, 0), (0, 0), (4, 0), (4, 3), (4, 3), (0, 3), (0, 0)]) == [[(0, 0), (4, 0), (4, 3), (0, 3), (0, 0)]]
    bow = repair.valid_rings([(0, 0), (4, 3), (4, 0), (0, 3)])
    assert [repair.signed_area(r) for r in bow] == [3.0, 3.0]
    assert repair.valid_rings([(0, 0), (4, 0), (4, 3), (7, 3), (4, 3), (0, 3)]) == [[(0, 0), (4, 0), (4, 3), (0, 3), (0, 0)]]
    assert repair.valid_rings([(0, 0), (1, 1)]) == repair.valid_rings([]) == repair.valid_rings([(2, 2)] * 5) == []
    keyhole = repair.valid_rings([(0, 0), (6, 0), (6, 6), (0, 6), (0, 0), (2, 2), (2, 4), (4, 4), (4, 2), (2, 2)])
    assert [repair.signed_area(r) for r in keyhole] == [36.0, -4.0]


def test_columns_and_odd_rows(spark):
    rows = [(1, [{"lon": 0.0, "lat": 0.0}, {"lon": 4.0, "lat": 3.0}, {"lon": 4.0, "lat": 0.0}, {"lon": 0.0, "lat": 3.0}]), (2, None), (3, []), (4, [{"lon": float("nan"), "lat": 0.0}] * 4), (5, [{"lon": None, "lat": 0.0}] * 4)]
    df = spark.createDataFrame(rows, "id int, ring array<struct<lon:double,lat:double>>")
    assert {r["id"]: r["n"] for r in repair.repair_rings(df).select("id", F.when(F.col("rings").isNotNull(), F.size("rings")).alias("n")).collect()} == {1: 2, 2: None, 3: 0, 4: None, 5: None}


def test_written_cells_are_repaired(spark, tmp_path):
    corner = lambda *xy: [{"lon": float(x), "lat": float(y)} for x, y in xy]
    rows = [
        (1, corner((0, 0), (4, 3), (4, 0), (0, 3), (0, 0))), (2, corner((0, 0), (6, 0), (6, 6), (0, 6), (0, 0), (2, 2), (2, 4), (4, 4), (4, 2), (2, 2), (0, 0))),
        (3, corner((0, 0), (1, 0), (1, 1), (0, 0))), (4, corner((0, 0), (1, 1), (0, 0), (0, 0))), (5, corner((-170, 0), (170, 0), (170, 5), (-170, 0))), (6, None),
    ]
    writers.write_cells(spark.createDataFrame(rows, "cell int, ring array<struct<lon:double,lat:double>>"), str(tmp_path / "cells"))
    back = readers.parse_wkb(spark.read.parquet(str(tmp_path / "cells")), "geometry", rings="rings").collect()
    assert {r["cell"]: len(r["rings"]) for r in back} == {1: 2, 2: 2, 3: 1}
    kinds = {r["cell"]: struct.unpack_from("<BII", bytes(r["geometry"])) for r in back}
    assert kinds == {1: (1, 6, 2), 2: (1, 3, 2), 3: (1, 3, 1)}
    areas = {r["cell"]: sum(repair.signed_area([(p["lon"], p["lat"]) for p in x]) for x in r["rings"]) for r in back}
    assert all(math.isclose(areas[k], v) for k, v in {1: 6.0, 2: 32.0, 3: 0.5}.items())
