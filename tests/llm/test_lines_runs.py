import random

import numpy as np
from test_lines import levenshtein

from phenogrid.llm import lines


def keys(text, rarity, common=None):
    splitter = lines.LineSplitter()
    with np.errstate(over="ignore"):
        (g,) = splitter(lines.pa.array([text]))
        _, key, _ = lines.run_keys(g["words"], g["first"], g["n"], rarity, 0.8, common)
    return set(key.tolist())


def test_like_lines_share_a_key():
    """However the runs are ordered and the edits are placed, for plain lines and for those that repeat themselves."""
    rng = random.Random(5)
    ranks = np.random.default_rng(1).integers(0, 60, lines.WORD_BUCKETS).astype(np.uint8)
    for i in range(900):
        n, kinds = rng.choice([5, 6, 7, 8, 9, 10, 11, 14, 15, 19, 24, 41, 50, 52, 60, 90, 130, 300]), rng.choice([2, 6, 20, 50, 5000])
        base = [f"w{rng.randrange(kinds)}" for _ in range(n)] if i % 2 else [f"w{j * kinds // n}" for j in range(n)]
        other = list(base)
        # edits at even distances break the most runs
        kind, many = rng.randrange(4), n // 5 + rng.randrange(2)
        for j in range(many):
            at, what = min(len(other) - 1, (j + 1) * n // (many + 1)) if i % 3 else rng.randrange(len(other)), kind if kind < 3 else rng.randrange(3)
            other[at : at + (what < 2)] = [f"x{j}"] if what else []
        if levenshtein(base, other) <= 0.2 * max(len(base), len(other)) + 1e-9:
            assert base == other or keys(" ".join(base), ranks) & keys(" ".join(other), ranks), (n, kinds, base, other)


def test_runs_that_unlike_lines_share_are_no_keys():
    """Long lines with common words met under runs of two of them, and repeats of one common word under its run."""
    rng = random.Random(7)
    rarity = np.zeros(lines.WORD_BUCKETS, dtype=np.uint8)
    common = [f"c{i}" for i in range(40)]
    hashes = next(iter(lines.LineSplitter()(lines.pa.array([" ".join(common) + " passage " * 9]))))["words"]
    rarity[(hashes & np.uint64(lines.WORD_BUCKETS - 1)).astype(int)] = 60
    a, b = (" ".join(rng.choice(common) if i % 4 else f"{name}{i}" for i in range(600)) for name in "ab")
    assert not keys(a, rarity) & keys(b, rarity)
    a, b = (" ".join(f"{name}{i // 20}" for i in range(140)) + " passage" * 40 for name in "ab")
    assert not keys(a, rarity) & keys(b, rarity)


def test_passages_come_last():
    """A passage of rare words in unlike lines is found by its own count."""
    passage = " ".join(f"p{i}" for i in range(30))
    (g,) = lines.LineSplitter()(lines.pa.array([passage]))
    with np.errstate(over="ignore"):
        slots = lines.run_hashes(g["words"], np.arange(28), 3) & np.uint64(lines.RUN_BUCKETS - 1)
    common = np.zeros(lines.RUN_BUCKETS, dtype=np.uint8)
    common[slots.astype(int)] = 200
    rarity = np.full(lines.WORD_BUCKETS, 30, dtype=np.uint8)
    a, b = (" ".join(f"{name}{i}" for i in range(70)) + " " + passage for name in "ab")
    rarity[(g["words"] & np.uint64(lines.WORD_BUCKETS - 1)).astype(int)] = 0
    assert keys(a, rarity) & keys(b, rarity) and not keys(a, rarity, common) & keys(b, rarity, common)
