import random

from test_lines import WORDS, levenshtein

from phenogrid.llm import lines

MANY = WORDS + [f"v{i}" for i in range(3000)]


def test_all_pairs_within_the_edits_are_linked(spark):
    """Brute force on edit similarity alone, without any hash."""
    rng = random.Random(11)
    texts = []
    for n in [*range(1, 31), 37, 44, 60, 90, 330] * 2:
        base = rng.choices(MANY if n % 3 else WORDS[:3], k=n)
        texts.append(base)
        for _ in range(3):
            other = list(base)
            for _ in range(rng.choice((max(1, n // 5), max(1, n // 5), n // 4, n // 5 + 1))):
                at, kind = rng.randrange(len(other) + 1), rng.randrange(3)
                other[at : at + (kind < 2)] = [rng.choice(MANY)] if kind else []
            texts.append(other or base)
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(texts):
        for j, y in enumerate(texts[:i]):
            if abs(len(x) - len(y)) <= 0.2 * max(len(x), len(y)) and levenshtein(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert {r["doc_id"] for r in lines.kept_lines(df).collect()} == {i for i in range(len(texts)) if find(i) == i}


def test_pairs_together_as_one_by_one():
    rng = random.Random(3)
    left, right = [], []
    for _ in range(600):
        n = rng.choice([1, 2, 5, 8, 20, 57, 130, 390, 420])
        a = rng.choices("abcdefghij" if n % 2 else WORDS, k=n)
        b = list(a)
        for _ in range(rng.randrange(0, n // 4 + 2)):
            at, kind = rng.randrange(len(b) + 1), rng.randrange(3)
            b[at : at + (kind < 2)] = [rng.choice(WORDS)] if kind else []
        left.append(" ".join(a)), right.append(" ".join(b or a))
    want = [lines.similar(a, b, 0.8) for a, b in zip(left, right)]
    assert lines.similar_pairs(left, right, 0.8).tolist() == want and 100 < sum(want) < 600
    brute = [levenshtein(a.split(), b.split()) <= 0.2 * max(len(a.split()), len(b.split())) + 1e-9 for a, b in zip(left[:200], right[:200])]
    assert brute == want[:200]
