import hashlib

from pyspark.sql import functions as F

from phenogrid.llm import syncmers

DOCS = "/root/testdata/sf0.001/documents.parquet"


def brute_anchors(spark, words, k=syncmers.K, s=syncmers.S):
    """By the definition: which runs of k words have their smallest inner run at an edge."""
    if len(words) < k:
        return None
    inner = [tuple(words[i : i + s]) for i in range(len(words) - s + 1)]
    table = spark.createDataFrame([(list(x),) for x in set(inner)], "w array<string>").select("w", F.xxhash64(F.xxhash64(F.col("w")[0]), *[F.xxhash64(F.col("w")[j]) for j in range(1, s)]).alias("h"))
    h = {tuple(r["w"]): r["h"] for r in table.collect()}
    out = []
    for i in range(len(words) - k + 1):
        run = [h[x] for x in inner[i : i + k - s + 1]]
        if min(run) in (run[0], run[-1]):
            out.append(i)
    return out


def test_anchors_are_closed_syncmers(spark):
    text = spark.read.parquet(DOCS).where("n_chars between 400 and 900").orderBy("doc_id").first()["text"]
    words = text.split()
    want = brute_anchors(spark, words)
    got = spark.createDataFrame([(text,)], "text string").select(F.expr(syncmers.word_anchors("text")).alias("a")).first()["a"]
    assert len(got) == len(want) > 10
    # context-free: the same run in another text is an anchor again
    part = " ".join(words[want[3] : want[3] + syncmers.K])
    alone = spark.createDataFrame([("some other words come first and then " + part + " follows",)], "text string").select(F.expr(syncmers.word_anchors("text")).alias("a")).first()["a"]
    assert got[3] in alone


def test_edits_and_next(spark):
    rows = syncmers.fingerprints(spark.read.parquet(DOCS)).collect()
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(DOCS).collect())
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs)
    near, far = [], []
    for i, (d, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        m = len(t) // 2
        edited = t[: len(t) - m] + after[:m]
        r = by[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        if t == after:
            assert r["near_next"] == 1
        near.append(r["near_edited"]), far.append(r["near_next"])
        assert r["fingerprint"] == next(by[e]["fingerprint"] for e, u in docs if u == t)
    assert sum(near) / len(near) > 0.4 and sum(far) / len(far) < 0.15


def test_ranges(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "ROWS_PER_BUCKET", 7)
    df = spark.range(100).selectExpr("id * id as doc_id", "concat('text number ', id) as text").repartition(5)
    got = {r["doc_id"]: r for r in syncmers.fingerprints(df).collect()}
    for i in range(100):
        text, after = f"text number {i}", f"text number {(i + 1) % 100}"
        m = len(text) // 2
        assert got[i * i]["edited_sha256"] == hashlib.sha256((text[: len(text) - m] + after[:m]).encode()).hexdigest()


def test_odd_rows(spark, odd_documents, no_documents):
    rows = syncmers.fingerprints(odd_documents).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 12 and by[2]["fingerprint"] == "" and by[2]["near_next"] == 1.0 and by[0]["near_next"] == 1.0
    assert by[10]["n_chars"] == len('token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" and 日本語のテキスト \U0001f600')
    assert syncmers.fingerprints(no_documents).count() == 0
    one = syncmers.fingerprints(odd_documents.where("doc_id = 9")).first()
    assert one["near_next"] == 1.0


def test_half_of_any_text_is_found_again(spark):
    """Short texts, texts without blanks and mixed ones: more like their edited text than like the next one."""
    rng = __import__("random").Random(2)
    texts = []
    for i in range(60):
        kind, n = i % 4, rng.randrange(6, 40)
        letters = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n)) if kind == 0 else " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(n // (1 + 4 * (kind == 1)) + 1))
        texts.append(letters)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = syncmers.fingerprints(df).collect()
    assert len(rows) == 60 and all(r["near_edited"] > r["near_next"] for r in rows)
    named = spark.createDataFrame([(f"id'{i}" if i % 3 else None, t) for i, t in enumerate(texts)], "doc_id string, text string")
    assert syncmers.fingerprints(named).count() == 60


def test_equal_ids_are_split(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "ROWS_PER_BUCKET", 10)
    df = spark.range(200).selectExpr("cast(null as bigint) as doc_id", "concat('text number ', id) as text")
    held = syncmers.with_next(df, "doc_id", "text").groupBy("bucket").count().collect()
    assert len(held) > 10 and max(r["count"] for r in held) < 60
    assert syncmers.fingerprints(df).count() == 200


def pieces(text):
    """Letters of a text as the module has them."""
    words = text.split()
    return [x for w in words for x in (w if len(w) > syncmers.LONG_WORD else [w])]


def runs_at_edges(letters, k, s, h):
    """Runs of k letters whose least inner run of s, by the hash h, stands first or last; in order."""
    inner = [h(tuple(letters[i : i + s])) for i in range(len(letters) - s + 1)]
    found = [tuple(letters[i : i + k]) for i in range(len(letters) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]
    return found if len(letters) >= k else []


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def letter_hash(x):
    """Spark's xxhash64 of one string."""
    import xxhash

    return signed(xxhash.xxh64_intdigest(x.encode(), 42))


def chain_hash(values):
    """Spark's xxhash64 of several longs."""
    import struct

    import xxhash

    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def kinds(text):
    """Anchors of a text by kind, as sets of runs, by the definition."""
    small = lambda run: chain_hash([letter_hash(x) for x in run])
    letters = pieces(text)
    few = [("few", *letters)] if 0 < len(letters) < syncmers.K else []
    out = [set(few + runs_at_edges(letters, syncmers.K, syncmers.S, small))]
    chars = list(text)
    out.append(set(runs_at_edges(chars, syncmers.K, syncmers.S, small)) if len(text) < syncmers.FEW_WORDS * syncmers.LONG_WORD and len(__import__("re").split(r"\s+", text)) < syncmers.FEW_WORDS else None)
    out.append(set(runs_at_edges(chars, syncmers.SMALL_K, syncmers.SMALL_S, small)) if len(text) < syncmers.FEW_CHARS else None)
    return out


def like(a, b):
    both = [(x, y) for x, y in zip(kinds(a), kinds(b)) if x is not None and y is not None]
    every = sum(len(x) + len(y) for x, y in both)
    return 2 * sum(len(x & y) for x, y in both) / every if every else 1.0


def test_likeness_by_definition(spark):
    """Texts about both limits, edits that cross them, unspaced and empty ones: numbers of anchors and both likenesses."""
    rng = __import__("random").Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9)))
    texts = []
    for n in (3, 7, 8, 12, 20, 40, 60, 63, 64, 65, 70, 90, 110, 130, 150):
        texts += [" ".join(word() for _ in range(n)), rng.choice(["ab", "", "a b c", "".join(word() for _ in range(9))])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in syncmers.fingerprints(df).collect()}
    for i, text in enumerate(texts):
        after, m = texts[(i + 1) % len(texts)], len(text) // 2
        edited = text[: len(text) - m] + after[:m]
        assert abs(rows[i]["near_edited"] - like(text, edited)) < 1e-9, (i, text, edited)
        assert abs(rows[i]["near_next"] - like(text, after)) < 1e-9, (i, text, after)


def test_edits_that_cross_the_limits(spark):
    """Texts of 50 to 199 words, half of which is cut away: as like their edited texts at every length."""
    rng = __import__("random").Random(3)
    texts = []
    for i in range(240):
        texts += [" ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(50 + i * 150 // 240)), "ab"]
    rows = syncmers.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    by = {}
    for r in rows:
        if r["doc_id"] % 2 == 0:
            n = 50 + r["doc_id"] // 2 * 150 // 240
            by.setdefault("below" if n < 64 else "across" if n < 128 else "above", []).append(r["near_edited"])
    means = {k: sum(v) / len(v) for k, v in by.items()}
    assert all(m > 0.55 for m in means.values()), means
