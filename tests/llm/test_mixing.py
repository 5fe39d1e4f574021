import math
from collections import defaultdict

import pytest

from phenogrid.llm import mixing


def shares(spark, tokens):
    return spark.createDataFrame([(f"s{i}", t, 1) for i, t in enumerate(tokens)], "source string, tokens bigint, rows bigint")


def test_exponent_meets_the_target(spark):
    tokens = [8000, 1000, 500, 10]
    a = mixing.find_exponent(shares(spark, tokens), entropy=1.2)
    w = [t**a for t in tokens]
    assert abs(-sum(x / sum(w) * math.log(x / sum(w)) for x in w) - 1.2) < 1e-4
    a = mixing.find_exponent(shares(spark, tokens), max_repeats=3.0)
    assert abs((8000 / 10) ** (1 - a) - 3) < 1e-4
    assert mixing.find_exponent(shares(spark, [5, 5]), max_repeats=3.0) == 1.0
    assert mixing.find_exponent(shares(spark, tokens), entropy=99.0) == 0.0


def docs(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 else ("mid" if i % 20 else "small")) for i in range(5000)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)


def test_budgets_and_epochs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BLOCK", 64)
    out = mixing.mix(docs(spark), max_repeats=2.5).collect()
    by = defaultdict(lambda: defaultdict(list))
    for r in out:
        by[r["source"]][r["epoch"]].append(r)
    assert {r["doc_id"] for r in out} == set(range(5000))
    total = sum(r["tokens"] for r in out)
    for epochs in by.values():
        whole = {r["doc_id"] for r in epochs[0]}
        assert all({r["doc_id"] for r in epochs[e]} == whole for e in range(max(epochs)))
        assert all(len({r["doc_id"] for r in e}) == len(e) for e in epochs.values())
        rows = sorted((r for e in epochs.values() for r in e), key=lambda r: r["place"])
        at = 0
        for r in rows:
            assert r["place"] == at
            at += r["tokens"]
        assert abs(at / total - rows[0]["weight"]) < 0.01
    repeats = {s: sum(r["tokens"] for e in ep.values() for r in e) / sum(r["tokens"] for r in ep[0]) for s, ep in by.items()}
    assert abs(max(repeats.values()) - 2.5) < 0.05 and min(repeats.values()) == 1
    first, second = ([r["doc_id"] for r in sorted(by["small"][e], key=lambda r: r["place"])] for e in (0, 1))
    assert sorted(first) == sorted(second) and first != second


@pytest.mark.parametrize("budget", [1, 3000])
def test_given_budget(spark, budget):
    out = mixing.mix(docs(spark), entropy=0.9, max_repeats=None, budget=budget).collect()
    assert budget <= sum(r["tokens"] for r in out) + 1e-6 and sum(r["tokens"] for r in out) <= budget + 3 * 8


def test_odd_rows(odd_documents, no_documents):
    out = mixing.mix(odd_documents).collect()
    assert {r["doc_id"] for r in out} == set(range(11)) and sum(r["doc_id"] == 2 for r in out) == 1
    assert mixing.mix(no_documents).count() == 0


def test_weights_and_places_by_definition(spark):
    """Exponent, weights, budget and running places of a whole table computed again."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokens = {r["doc_id"]: len([w for w in (r["text"] or "").split(" ") if w]) or int(bool(r["text"])) for r in table.collect()}
    source = {r["doc_id"]: r["source"] for r in table.collect()}
    whole = defaultdict(int)
    for d, n in tokens.items():
        whole[source[d]] += n
    live = {s: n for s, n in whole.items() if n}
    a = max(0.0, 1 - math.log(2.0) / math.log(max(live.values()) / min(live.values())))
    total = sum(live.values())
    z = sum((n / total) ** a for n in live.values())
    weight = {s: (n / total) ** a / z for s, n in live.items()}
    budget = max(n / weight[s] for s, n in live.items())
    out = mixing.mix(table, max_repeats=2.0).collect()
    assert all(r["tokens"] == tokens[r["doc_id"]] and abs(r["weight"] - weight.get(r["source"], 0)) < 1e-4 for r in out)
    by = defaultdict(list)
    for r in out:
        by[r["source"]].append(r)
    for s, n in live.items():
        rows = sorted((r for r in by[s] if r["tokens"]), key=lambda r: r["place"])
        at = 0
        for r in rows:
            assert r["place"] == at
            at += r["tokens"]
        longest = max(r["tokens"] for r in rows)
        assert weight[s] * budget * 0.999 - 1 <= at <= weight[s] * budget * 1.001 + longest
