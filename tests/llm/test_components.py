import random

from phenogrid.llm import common


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {(x, find(x)) for x in parent}


def test_components(spark):
    rng = random.Random(3)
    for edges in ([(rng.randrange(300), rng.randrange(300)) for _ in range(180)], [(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 50)], []):
        df = spark.createDataFrame(edges, "src bigint, dst bigint")
        got = {tuple(r) for r in common.connected_components(df).collect()}
        assert got == brute([e for e in edges if e[0] != e[1]])


def test_words_are_hashed_alike_in_any_slice():
    hasher = common.WordHasher(b" \n")
    text = b" alpha Beta  gamma\nalpha delta" + b"x" * 300 + b" alpha "
    starts, hashes = hasher(text)
    words = [text[s:].split()[0] for s in starts.tolist()]
    assert words == text.split() and len({h for w, h in zip(words, hashes.tolist()) if w == b"alpha"}) == 1
    for step in (1, 7, 64):
        a, b = hasher(text, step)
        assert a.tolist() == starts.tolist() and b.tolist() == hashes.tolist()
    assert len(hasher(b"")[0]) == 0
