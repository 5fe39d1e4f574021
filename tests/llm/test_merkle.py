import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from phenogrid.llm import merkle
from phenogrid.llm.queries import op13_manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def whole_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        low = i // 8 * 8
        out.append(("".join(nodes[low:i]), "".join(nodes[i + 1 : low + 8])))
        i //= 8
    return out


def by_definition(rows):
    """Of rows (key, group, leaf): key, leaf, subroot, root, path."""
    groups = {}
    for key, group, leaf in rows:
        groups.setdefault(group, []).append((key, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ordered = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[1])) for g in names}
    trees = {g: whole_tree([leaf for _, leaf in ordered[g]]) for g in names}
    crown = whole_tree([trees[g][-1][0] for g in names]) if names else [[]]
    return [
        (key, leaf, trees[g][-1][0], crown[-1][0], siblings(trees[g], i) + siblings(crown, at))
        for at, g in enumerate(names) for i, (key, leaf) in enumerate(ordered[g])
    ]


def found(df, key):
    return [(r[key], r["leaf"], r["subroot"], r["root"], [tuple(p) for p in r["path"]]) for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], str(r[4])))


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 100, 511, 513, 600, 4096])
def test_traversal_of_a_block(n):
    nodes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    levels = whole_tree(nodes)
    depth = merkle.height(n)
    assert depth == len(levels) - 1
    assert [[(b.decode(), a.decode()) for b, a in path] for path in merkle.paths([x.encode() for x in nodes], depth)] == [siblings(levels, i) for i in range(n)]


def test_last_block_of_one_node(spark, monkeypatch):
    """Blocks of 64: a group of three tiers whose last runs hold one node at every level, beside groups of one block and one row."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 2)
    monkeypatch.setattr(merkle, "STACK_LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 64)
    rows = [(i, "a", sha(str(i))) for i in range(4097)] + [(i, "b", sha("b", str(i))) for i in range(70)] + [(5, "c", sha("c"))] + [(i, None, sha("n", str(i))) for i in range(9)]
    df = merkle.manifest(spark.createDataFrame(rows, "k long, g string, leaf string"), "k", "g")
    assert ordered(found(df, "k")) == ordered(by_definition(rows))


def test_more_groups_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(merkle, "STACK_LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(i, f"g{i % 70}é", sha(str(i))) for i in range(150)]
    df = merkle.manifest(spark.createDataFrame(rows, "k long, g string, leaf string"), "k", "g")
    assert ordered(found(df, "k")) == ordered(by_definition(rows))


def test_fold_finds_what_was_changed(spark):
    rows = [(i, "ab"[i % 2], sha(str(i))) for i in range(300)]
    df = merkle.manifest(spark.createDataFrame(rows, "k long, g string, leaf string"), "k", "g")
    good = df.where(merkle.folded("leaf", "path") == F.col("root")).count()
    bad = df.where(merkle.folded("sha2(leaf, 256)", "path") == F.col("root")).count()
    assert (good, bad) == (300, 0)


def test_odd_rows(spark, odd_documents, no_documents):
    """Nulls, repeated rows and clashing columns; equal keys go by leaf."""
    docs = odd_documents.withColumn("leaf", merkle.leaf(["doc_id", "source", "lang", "n_chars", "text"])).withColumn("path", F.lit(1)).withColumn("root", F.lit(2)).withColumn("g", F.lit(3)).withColumn("with_score", F.lit(4))
    rows = [(r["doc_id"], r["lang"], sha(*["-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")])) for r in odd_documents.collect()]
    df = merkle.manifest(docs, "doc_id", "lang", carry=("score",))
    assert ordered(found(df, "doc_id")) == ordered(by_definition(rows))
    assert {(r["doc_id"], r["score"]) for r in df.collect()} == {(r["doc_id"], r["score"]) for r in odd_documents.collect()}
    assert merkle.manifest(docs.limit(0), "doc_id", "lang").count() == 0
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert merkle.manifest(nulls, "doc_id", "lang").where(merkle.folded("leaf", "path") == F.col("root")).count() == 12


def test_query_by_definition(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    upper = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

    def leaf(r, text):
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])

    harmed = {r["doc_id"]: leaf(r, r["text"] if zlib.crc32(str(r["doc_id"]).encode()) % 3 or r["text"] is None else "".join(upper.get(c, c) for c in r["text"])) for r in docs}
    want = {}
    for key, node, subroot, root, path in by_definition([(r["doc_id"], r["lang"], leaf(r, r["text"])) for r in docs]):
        at = harmed[key]
        for before, after in path:
            at = sha(before, at, after)
        want[key] = node, subroot, root, sha(*[b + a for b, a in path]), at, at == root
    got = {r[0]: tuple(r)[1:] for r in op13_manifest(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and 0 < sum(not w[-1] for w in want.values()) < len(want)
