import random

import numpy as np
import pytest

from phenogrid.llm import ngram_join


def sets_of(text, width):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if 0 < len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(docs, width, percent):
    s = {d: sets_of(t, width) for d, t in docs}
    parent = {d: d for d in s}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(s[a] & s[b])
            if s[a] and s[b] and 100 * n >= percent * (len(s[a]) + len(s[b]) - n):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {(d, len(s[d]), find(d)) for d in ids}


def made(seed, n=260):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.65:
            words = rng.choice(docs)[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                if words:
                    at = rng.randrange(len(words))
                    words[at : at + rng.randrange(2)] = [rng.choice(vocab)] * rng.randrange(2)
            text = " ".join(words)
        else:
            text = " ".join(rng.choices(vocab, k=rng.choice([0, 1, 2, 3, 5, 9, 20, 45, 90, 200])))
        docs.append((i, text.upper() if rng.random() < 0.1 else text.replace(" ", "\t", 1) if rng.random() < 0.1 else text))
    return docs


@pytest.mark.parametrize("width,percent,seed", [(3, 90, 1), (5, 80, 2)])
def test_equal_to_all_pairs(spark, width, percent, seed):
    docs = made(seed)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_groups(df, width, percent).collect()}
    want = brute(docs, width, percent)
    assert got == want and len({c for _, _, c in want}) < 220


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("rows", [100, 10**6, 10**10])
def test_linked_sets_share_a_key(percent, rows):
    """At the most differences that a link allows, for the plans of small and large inputs."""
    rng = np.random.default_rng(percent)
    signer = ngram_join.Signer(1, percent, rows)
    for n in [5, 8, 10, 11, 19, 20, 30, 64, 100, 257, 600]:
        for _ in range(12):
            words = [f"t{x}" for x in rng.choice(10**9, n, replace=False)]
            lost = int(rng.integers(0, n + 1))
            while 100 * (n - lost) < percent * n:
                lost -= 1
            added = int(rng.integers(0, n))
            while 100 * (n - lost) < percent * (n + added):
                added -= 1
            other = words[lost:] + [f"u{x}" for x in rng.choice(10**9, max(added, 0), replace=False)]
            with np.errstate(over="ignore"):
                texts = [" ".join(words).encode(), " ".join(other).encode()]
                keys, of, _ = signer.keys(texts)
                a, b = [set(keys[of == x].tolist()) for x in signer.names(*signer.sets(texts))[0]]
            assert a & b or (lost == 0 and added <= 0), (n, lost, added)


def test_large_groups_take_few_rounds(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r["component_id"] for r in ngram_join.jaccard_groups(df, 3, 90).collect()}
    assert got == {c for _, _, c in brute(docs, 3, 90)}


def test_odd_rows(odd_documents, no_documents):
    rows = {r["doc_id"]: r for r in ngram_join.jaccard_groups(odd_documents, 3, 80).collect()}
    assert rows[1]["component_id"] == 0 and rows[8]["component_id"] == 0 and rows[2]["n_shingles"] == 0 and rows[2]["component_id"] == 2
    assert rows[4]["component_id"] == 4 and rows[3]["n_shingles"] == 0
    assert ngram_join.jaccard_groups(odd_documents, 3, 80).count() == 12 and ngram_join.jaccard_groups(no_documents).count() == 0
