import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from phenogrid.llm import simhash
from phenogrid.llm.common import Scratch
from phenogrid.llm.queries import op12_simhash


def slow_fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, most):
    """Smallest index that links of each pair at most ``most`` bits apart reach."""
    least = list(range(len(fps)))

    def find(a):
        while least[a] != a:
            a = least[a]
        return a

    x = np.array(fps, dtype=np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= most):
            a, b = find(i), find(i + 1 + int(j))
            least[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(x))]


def near_fingerprints(rng, centres, each, flips):
    """Fingerprints a few bits from some centres, and as many of their own."""
    out = rng.integers(0, 1 << 64, 4 * centres, dtype=np.uint64).tolist()
    for c in rng.integers(0, 1 << 64, centres, dtype=np.uint64).tolist():
        for _ in range(each):
            for b in rng.choice(64, rng.integers(0, flips + 1), replace=False).tolist():
                c ^= 1 << b
            out.append(c)
    return sorted(set(out))


def joined(spark, fps, most):
    found = simhash.links(spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long"), Scratch(spark), most).collect()
    at = {f: i for i, f in enumerate(fps)}
    edges = [(at[int(np.int64(r[0]).view(np.uint64))], at[int(np.int64(r[1]).view(np.uint64))]) for r in found]
    assert all(bin(fps[a] ^ fps[b]).count("1") <= most and a != b for a, b in edges)
    least = list(range(len(fps)))

    def find(a):
        while least[a] != a:
            a = least[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))], len(edges)


@pytest.mark.parametrize("most", [0, 1, 2, 3, 5])
@pytest.mark.parametrize("width", [1, 2, 4])
def test_links_meet_in_a_cell(most, width):
    """Every pair of a link shares a cell, and the points' distance is a lower bound."""
    rng = np.random.default_rng(most * 10 + width)
    a = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, most, replace=False).tolist():
            b[i] ^= np.uint64(1 << bit)
    assert (np.bitwise_count(simhash.points(a, width) ^ simhash.points(b, width)) <= np.bitwise_count(a ^ b)).all()
    with np.errstate(over="ignore"):
        for x, y in zip(a, b):
            assert set(simhash.cells(np.array([x]), width, most)[0]) & set(simhash.cells(np.array([y]), width, most)[0])


def test_points_by_definition():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 64, 50, dtype=np.uint64)
    for width in (1, 2, 4):
        for v, p in zip(x.tolist(), simhash.points(x, width).tolist()):
            assert p == sum(((1 << bin(v >> i & (1 << width) - 1).count("1")) - 1) << i for i in range(0, 64, width))


@pytest.mark.parametrize("most", [1, 3, 4])
@pytest.mark.parametrize("width", [1, 2, 4])
def test_groups_of_fingerprints(spark, monkeypatch, most, width):
    monkeypatch.setattr(simhash, "WIDTHS", (width,))
    fps = near_fingerprints(np.random.default_rng(width + most), 6, 40, 2)
    assert joined(spark, fps, most)[0] == components(fps, most)


def test_cell_in_blocks(spark, monkeypatch):
    """Some two thousand unlike fingerprints within a few bits: cells are cut, pairs come out as forests."""
    monkeypatch.setattr(simhash, "BLOCK", 64)
    monkeypatch.setattr(simhash, "ENTRIES_PER_BUCKET", 1 << 11)
    rng = np.random.default_rng(8)
    soft = rng.choice(64, 11, replace=False).tolist()
    centre = int(rng.integers(0, 1 << 63))
    fps = sorted({centre ^ sum(1 << b for j, b in enumerate(soft) if i >> j & 1) for i in range(2048)} | set(near_fingerprints(rng, 3, 9, 3)))
    groups, edges = joined(spark, fps, 3)
    assert groups == components(fps, 3)
    assert edges < 400_000  # of 1.4 million links


def test_text_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "WORDS_AT_ONCE", 5)
    for text in ("", " \t\n", "One", "one TWO", "a b c", "a b a b a b a b a b c d e f g h i", "É école ÉCOLE x", "same " * 100, "\x0bw\x0cx\ry z"):
        assert int(simhash.fingerprint(text.encode())) == slow_fingerprint(text), text


def test_odd_rows(odd_documents, no_documents):
    docs = odd_documents.withColumn("fp", F.lit(1)).withColumn("id", F.lit(2)).withColumn("component_id", F.lit("x"))
    rows = simhash.simhash_groups(docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 12
    assert by[1]["component_id"] == 0 and by[2]["component_id"] == by[3]["component_id"] == by[4]["component_id"] == 2
    assert all(np.int64(r["fingerprint"]).view(np.uint64) == slow_fingerprint(t) for r, t in ((by[d["doc_id"]], d["text"]) for d in odd_documents.collect()))
    assert simhash.simhash_groups(no_documents).count() == 0
    null = docs.where("doc_id < 2").withColumn("doc_id", F.lit(None).cast("long"))
    assert [r["component_id"] for r in simhash.simhash_groups(null.union(docs.where("doc_id = 8"))).collect()].count(None) == 2


def test_query_against_brute_force(spark):
    rows = {r["doc_id"]: r for r in op12_simhash(spark, "/root/testdata/sf0.01").collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    ids = sorted(docs)
    fps = [slow_fingerprint(docs[i]) for i in ids]
    assert [rows[i]["fingerprint"] for i in ids] == [f"{f:016x}" for f in fps]
    least = components(fps, 3)
    assert [rows[i]["component_id"] for i in ids] == [ids[k] for k in least] and len(set(least)) < len(ids)
