import random

import numpy as np
from pyspark.sql import functions as F

from phenogrid.llm import lines

WORDS = [f"w{i}" for i in range(400)]


def words_of(line):
    return [w for w in lines.line_words(line) if w]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_word_edits():
    rng = random.Random(1)
    for _ in range(200):
        a, b = [rng.choices("abc", k=rng.randrange(9)) for _ in range(2)]
        assert lines.word_edits(a, b) == levenshtein(a, b)


def made(rng, n=160):
    base = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 40))) for _ in range(40)]
    docs = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(5)):
            line = rng.choice(base).split() if rng.random() < 0.7 else rng.choices(WORDS, k=12)
            if rng.random() < 0.4:
                line[rng.randrange(len(line))] = rng.choice(WORDS)
            text.append(("  " if rng.random() < 0.2 else " ").join(line).title() if rng.random() < 0.2 else " ".join(line))
            if rng.random() < 0.1:
                text.append(" - ")
        docs.append((i, "\n".join(text)))
    return docs


def brute(docs, table):
    """First occurrences by all pairs of lines, with the operator's own hashes."""
    rows = sorted((r["doc_id"], r["line"], r["sim"]) for r in table.collect())
    text = {(d, i): x for d, t in docs for i, x in enumerate(t.split("\n"))}
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (d, n, s) in enumerate(rows):
        for j in range(i):
            e, m, u = rows[j]
            x, y = words_of(text[d, n]), words_of(text[e, m])
            close = bin((s ^ u) & (1 << 64) - 1).count("1") <= lines.MAX_BITS
            if x == y or close and levenshtein(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {rows[i][:2] for i in range(len(rows)) if find(i) == i}


def test_equal_to_all_pairs(spark):
    docs = made(random.Random(5))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = brute(docs, lines.line_table(df, "doc_id", "text"))
    got = {(r["doc_id"], r["line"]) for r in lines.kept_lines(df).collect()}
    assert got == want and len(got) < lines.line_table(df, "doc_id", "text").count()
    out = {r["doc_id"]: r for r in lines.dedup_lines(df).collect()}
    for d, t in docs:
        stay = [x for i, x in enumerate(t.split("\n")) if (d, i) in want or not words_of(x)]
        assert out[d]["text"] == "\n".join(stay) and out[d]["n_lines"] - out[d]["n_dropped"] == len(stay)


def test_sim_hash_of_long_and_short_lines():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    starts = np.array([0, 1, 5, 700, 990])
    want = []
    for a, b in zip(starts, [*starts[1:], 1000]):
        bits = np.unpackbits(words[a:b].view(np.uint8).reshape(-1, 8), axis=1)
        want.append(np.packbits(2 * bits.sum(axis=0, dtype=int) > b - a).view(np.uint64)[0])
    assert lines.sim_hashes(words, starts).tolist() == lines.sim_hashes(words, starts, step=64).tolist() == [int(w) for w in want]


def test_odd_rows(odd_documents, no_documents):
    rows = {r["doc_id"]: r for r in lines.dedup_lines(odd_documents).collect()}
    assert rows[2]["text"] is None and rows[2]["n_lines"] == 0 and rows[3]["text"] == "" and rows[4]["text"] == "\n\n \t"
    assert rows[0]["text"] and rows[1]["text"] == "" and rows[7]["n_dropped"] == 1 and rows[7]["component"] == "w"
    assert lines.dedup_lines(odd_documents).count() == 12 and lines.dedup_lines(no_documents).count() == 0


def edited_lines(rng, words, n, edits, count):
    """Lines that are one line after so many edits, drawn anew for each."""
    base = rng.choice(words, n)
    for _ in range(count):
        line = base.copy()
        line[rng.choice(n, edits, replace=False)] = rng.choice(words, edits)
        yield line


def test_word_counts_never_part_linked_lines_and_bound_both_sides():
    """Counts of lines on either side of the lengths at which they become finer, with words repeated more than 255 times."""
    rng = np.random.default_rng(4)
    vocabulary = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
    pairs = []
    for n in (41, 60, 299, 300, 301, 330, 900):
        for line in edited_lines(rng, vocabulary[: 60 if n != 300 else 1], n, int(0.1 * n), 6):
            a, b = line.tolist(), line.tolist()
            for _ in range(int(0.1 * n)):
                b.insert(int(rng.integers(0, len(b) + 1)), int(rng.choice(vocabulary)))
            pairs.append((a, b))
            pairs.append((a, rng.choice(vocabulary[30:], n).tolist()))
    flat = np.array([w for pair in pairs for line in pair for w in line], dtype=np.uint64)
    n = np.array([len(line) for pair in pairs for line in pair])
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    counts = lines.word_counts(flat, first, n).to_pylist()
    assert {len(c) for c in counts} == {kinds for _, kinds in lines.FINER}
    for i, (a, b) in enumerate(pairs):
        both = counts[2 * i : 2 * i + 2]
        kinds = min(len(c) for c in both)
        for c, line in zip(both, (a, b)):
            at = np.array(line, dtype=np.uint64) >> np.uint64(65 - kinds.bit_length())
            assert lines.coarser([c], kinds)[0].tolist() == np.minimum(np.bincount(at.astype(np.int64), minlength=kinds), 255).tolist()
        near = lines.near_counts(*(lines.coarser([c], kinds) for c in both), lines.edits_allowed([max(len(a), len(b))], 0.8))[0]
        assert near == (i % 2 == 0)


def test_edits_are_bounded_on_each_side(spark):
    """Near copies of one line, half of them with words of their own at the end: too many words come in, though few go."""
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(4000)])
    texts = [" ".join([*line, *rng.choice(words, 14 * (i % 2))]) for i, line in enumerate(edited_lines(rng, words, 70, 4, 120))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = lines.line_table(docs, "doc_id", "text", sketches=True).where("counts is null").select("h1", "words", *lines.SKETCH)
    a, b = (table.toDF(*[f"{x}_{c}" for c in table.columns]) for x in "ab")
    found = a.join(b, F.expr("a_h1 < b_h1")).where(lines.close_sql(0.8)).count()
    true = sum(lines.similar(x, y, 0.8) for i, x in enumerate(texts) for y in texts[i + 1 :])
    assert 60 * 59 // 2 <= true <= found <= true + 60
