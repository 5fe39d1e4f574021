import random

import pytest

from phenogrid.llm import knn


def brute(rows, k, every, scale=1024):
    import math

    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in sorted({i for i, _ in ok if i % every == 0}):
        v = next(v for i, v in ok if i == q)
        best = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in ok if i != q and len(w) == len(v))[:k]
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("shard_rows", [64, 100000])
def test_equal_to_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(knn, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    monkeypatch.setattr(knn, "LEAF", 8)
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 1.0]) for _ in range(5)]) for i in range(300)]  # many ties
    rows += [(1000, None), (1001, [0.1, None, 0.2, 0.3, 0.4]), (1002, [float("nan")] * 5), (1003, [float("inf")] * 5), (1100, [0.5, 0.5]), (1005, [1.0, 1.0]), (1200, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {tuple(r) for r in knn.top_k(df, 10, 20).collect()}
    assert got == brute(rows, 10, 20)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (None, [3.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in knn.top_k(df, 10, 1).orderBy("query_id").collect()] == [(0, 1, 1, 1024 * 2048), (1, 1, 0, 1024 * 2048)]
    assert knn.top_k(df.limit(0)).count() == 0


def test_large_components_are_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([200000.0, -3e6, 4.5e5, 1.0, 1e-4, 7e4]) for _ in range(6)]) for i in range(200)] + [(200, [1e12] * 6), (201, [-1e12, 1.0, 1.0, 0.5, 0.25, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert {tuple(r) for r in knn.top_k(df, 10, 20).collect()} == brute(rows, 10, 20)
    two = spark.createDataFrame([(0, [200000.0, 1.0]), (1, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert {r["score"] for r in knn.top_k(two, 10, 100).collect()} == {209715200000}


def test_queries_go_where_a_bound_reaches(spark, monkeypatch):
    """Far-apart clusters of one norm: a query is sent to few leaves, and what it finds is exact; copies of one vector are spread."""
    import numpy as np

    monkeypatch.setattr(knn, "SHARD_ROWS", 50)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(i, (centres[i % 20] + rng.normal(0, 0.01, 8)).tolist()) for i in range(1200)] + [(5000 + i, centres[3].tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    sent = []
    reached = knn._reached
    monkeypatch.setattr(knn, "_reached", lambda asked, boxes: sent.append((reached(asked, boxes).count(), asked.count() * sum(map(len, boxes.values())))) or reached(asked, boxes))
    assert {tuple(r) for r in knn.top_k(df, 10, 20).collect()} == brute(rows, 10, 20)
    pairs, every = sent[0]
    assert pairs < 0.4 * every, sent


def test_dealer_takes_every_row(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    points = rng.integers(-50, 50, (1000, 4))
    dealer = knn.Dealer(points[:200], 16)
    leaf = dealer.leaf(points)
    assert set(leaf.tolist()) == set(range(dealer.leaves)) and dealer.leaves == 16
    assert knn.Dealer(np.ones((50, 3), dtype=np.int64), 8).leaves == 1
