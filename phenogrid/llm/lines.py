"""Fuzzy line deduplication.

Lines are normalised to lower-cased words without ASCII punctuation.  Equal
lines are one class.  Two classes are linked if the edit similarity of their
word sequences is high enough; no hash limits the relation.  An edit changes
at most q of a line's runs of q words, so linked lines share a run among the
first few of each in one order of all runs, rare words first.  Classes meet
under these runs; candidates whose lengths, places of the run and word
counts differ by more than the edits allow are dropped, the others are
verified.  Of each connected group of lines only the first occurrence stays.

Lines go by a 64-bit hash of their words until the end: two unlike lines
that share it, 1 in 10**7 among 10**12, and have a like line each may count
as one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.llm.common import PLACED_SCHEMA, Scratch, WordHasher, bucket_components, byte_groups, code_span, entry_buckets, free_name, mix64, near_ids, pack_entries, place_codes, shared_rows, size_codes, small_batches

MAX_BITS = 64  # of the SimHash: any distance may be linked
LONG_RUNS, RUNS = (3,), (2, 1)  # words of a run, the longest first; short lines go by ``RUNS``
KEYS_PER_WORD = 0.6
PLAIN_WORDS, FEW_KINDS = 40, 0.1  # longer lines of so few unlike words for their length go by words and not by runs
WORD_BITS = np.uint64((1 << 44) - 1)  # of a word's hash, in word keys
BLOCK_WORDS = 128  # long lines are cut into blocks where the edits that break runs are counted
LEVELS, KINDS = 3, 256  # of word counts
SKETCH = [f"c{i}_{j}" for i in range(LEVELS) for j in range(KINDS // 64)]
FINER = ((40, 128), (300, 1024))  # words above which lines have a finer count of words, and of how many kinds
WORD_BUCKETS, RUN_BUCKETS, SLICES = 1 << 18, 1 << 21, 16  # for the order of runs alone
LINE_BUCKETS = 1 << 25  # of hashes, of which a bit is kept
COMMON, OCTAVE = 190, 8  # least rank of runs that stand out by their own count, and ranks for each doubling
WORDED = re.compile(r"[A-Za-z0-9]|[^\x00-\x7f]")
SPACES = bytes(b for b in range(128) if not chr(b).isalnum() and b != 10)


def sim_hashes(words: np.ndarray, starts: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """SimHash of each run of word hashes; runs begin at ``starts`` and cover all."""
    counts = np.diff(np.concatenate((starts, [len(words)])))
    out = np.zeros(len(starts), dtype=np.uint64)
    low = 0
    while low < len(starts):
        # several short lines together, or one line of any length in pieces
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + step, side="right")) - 1)
        a, b = int(starts[low]), int(starts[high]) if high < len(starts) else len(words)
        total = np.zeros((high - low, 64), dtype=np.int64)
        for c in range(a, b, step):
            bits = np.unpackbits(words[c : min(b, c + step)].view(np.uint8).reshape(-1, 8), axis=1)
            total += np.add.reduceat(bits, starts[low:high] - a if high - low > 1 else [0], axis=0, dtype=np.int32)
        out[low:high] = np.packbits(2 * total > counts[low:high, None], axis=1).view(np.uint64).ravel()
        low = high
    return out


def edits_allowed(n, least: float):
    """Most word edits between lines of which the longer has ``n`` words."""
    return np.floor((1 - least) * np.asarray(n) + 1e-9).astype(np.int64)


def least_cost(chosen: np.ndarray, active: np.ndarray, q: int, least: float) -> np.ndarray:
    """Least cost of breaking the ``chosen`` runs of ``q`` words of some blocks: a word changed or lost costs 1, one put in ``least``.

    ``chosen`` has a row for each place of a run and a column for each block;
    of the columns only the first ``active`` reach a row.  The first unbroken
    run is best broken at its end: there a changed word breaks all runs that
    begin at its q places, a new one before its last word those at q - 1.
    """
    cost = np.zeros((len(chosen) + q, chosen.shape[1]))
    for i in range(len(chosen) - 1, -1, -1):
        n = active[i]
        cost[i, :n] = np.where(chosen[i, :n], np.minimum(1 + cost[i + q, :n], least + cost[i + q - 1, :n]), cost[i + 1, :n])
    return cost[0]


KNOWN: dict = {}  # what ``withstands`` has found in a task


def most_broken(q: int, least: float) -> float:
    """How many runs of ``q`` words a cost of 1 breaks at most."""
    return max(q, (q - 1) / least)


def withstands(n: int, q: int, least: float) -> bool:
    """Whether any edits that lead to a like line leave a run of ``q`` words of a line of ``n``."""
    runs, budget = max(0, n - q + 1), (1 - least) * n + 1e-6
    if runs > most_broken(q, least) * budget:
        return True
    if (n, q, least) not in KNOWN:
        KNOWN[n, q, least] = runs > 0 and bool(least_cost(np.ones((runs, 1), dtype=bool), np.ones(runs, dtype=int), q, least)[0] > budget)
    return KNOWN[n, q, least]


def run_lengths(n: int, least: float) -> tuple[int, ...]:
    """Lengths of runs by which a line of ``n`` words meets like lines: for each other length the longest that both withstand.

    0 stands for the lengths that none of ``LONG_RUNS`` serves.
    """
    if n * least > 2 and int(n * least) - LONG_RUNS[0] > most_broken(LONG_RUNS[0], least) * ((1 - least) * int(n * least) + 1e-6):
        return LONG_RUNS[:1]  # longer lines withstand more
    used = set()
    for m in range(int(np.ceil(n * least - 1e-9)), int((n + 1) / least) + 2):
        d = int(edits_allowed(max(n, m), least))
        if d > 0 and abs(m - n) <= d:
            used.add(next((q for q in LONG_RUNS if withstands(n, q, least) and withstands(m, q, least)), 0))
    return tuple(sorted(used))


def run_counts(n: int, least: float) -> list[int]:
    """How many runs of each length in ``RUNS`` a line of ``n`` words is found by, among lines that ``LONG_RUNS`` do not serve.

    A pair whose longer line has m words, d = ``edits_allowed(m)``, uses the
    longest runs of which one must be left: m - q + 1 > q d.  Of the n words'
    runs at most q d - (m - n) are not shared, as an insertion breaks only
    q - 1 of the shorter line's runs; the first q d - (m - n) + 1 of both
    lines in one order then have one in common.
    """
    if 0 not in run_lengths(n, least):
        return [0] * len(RUNS)
    m = np.arange(n, int((n + 1) / least) + 2)
    d = edits_allowed(m, least)
    m, d = m[(d > 0) & (m - n <= d)], d[(d > 0) & (m - n <= d)]
    counts, free = [], np.ones(len(m), dtype=bool)
    for q in RUNS:
        use = free & (m - q + 1 > q * d)
        counts.append(int((q * d - (m - n))[use].max()) + 1 if use.any() else 0)
        free &= ~use
    return counts


def held_runs(of: np.ndarray, place: np.ndarray, rank: np.ndarray, n: np.ndarray, q: int, least: float) -> np.ndarray:
    """How many of its unlike runs of ``q`` words, in their order, each line of ``n`` words needs until no edits that lead to a like line break all.

    Each run of a line ``of`` comes with its place and its rank among the
    line's unlike runs, from 0.  From a line of n words to one like it,
    whichever is longer, lead c changed or lost and p new words with
    c + least p <= (1 - least) n.  So where breaking the first runs costs
    more, one of them is left; lines of which all runs cost less need all.
    """
    counts = np.zeros(len(n), dtype=np.int64)
    np.maximum.at(counts, of, rank + 1)
    budget = (1 - least) * n + 1e-6
    # blocks in order of length; a run counts in the block in which it lies whole
    blocks = -(-n // BLOCK_WORDS)
    line = np.repeat(np.arange(len(n)), blocks)
    base = np.cumsum(blocks) - blocks
    length = np.minimum(n[line] - (np.arange(len(line)) - base[line]) * BLOCK_WORDS, BLOCK_WORDS)
    order = np.argsort(-length, kind="stable")
    column = np.empty(len(order), dtype=np.int64)
    column[order] = np.arange(len(order))
    rows = int(length.max()) if len(length) else 0
    active = np.searchsorted(-length[order], -np.arange(rows), side="left")
    inside = place % BLOCK_WORDS + q <= BLOCK_WORDS
    row, at = place[inside] % BLOCK_WORDS, column[base[of[inside]] + place[inside] // BLOCK_WORDS]
    rank, whose = rank[inside], of[inside]
    # a new word breaks q - 1 runs, a changed one q
    low = np.minimum(counts, np.where(np.bincount(of, minlength=len(n)) > counts, 1, (budget / least).astype(np.int64)))
    high = np.minimum(counts, (budget * most_broken(q, least)).astype(np.int64) + 1 + (blocks - 1) * (q - 1))
    while (low < high).any():
        middle = (low + high) // 2
        chosen = np.zeros((rows, len(line)), dtype=bool)
        some = rank < middle[whose]
        chosen[row[some], at[some]] = True
        cost = np.bincount(line, least_cost(chosen, active, q, least)[column], len(n))
        enough = cost > budget
        high, low = np.where(enough, middle, high), np.where(enough, low, np.minimum(middle + 1, high))
    return high


def run_hashes(words: np.ndarray, at: np.ndarray, q: int) -> np.ndarray:
    """Hashes of the runs of ``q`` words that begin at some places."""
    h = np.full(len(at), q, dtype=np.uint64)
    for j in range(q):
        h = mix64(h + words[at + j])
    return h


def word_tokens(words: np.ndarray, line: np.ndarray, n: np.ndarray, rarity: np.ndarray, least: float) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Line, hash and rank of the words, each with the count of its kind so far, of lines of few kinds; and which lines go by runs.

    Runs of a line that says the same again and again are few and, where its
    words are common, in many unlike lines.  An edit takes one of these
    tokens at most, so like lines share one of the first edits + 1 in an
    order in which repeats of rare words come first.  The kinds of like
    lines differ by the edits at most: one that goes by words alone is only
    like lines that go by words as well.
    """
    long_ = n > PLAIN_WORDS
    codes = np.sort((line.astype(np.uint64) << np.uint64(44) | words & WORD_BITS)[long_[line]])
    new = np.ones(len(codes), dtype=bool)
    new[1:] = codes[1:] != codes[:-1]
    of = (codes >> np.uint64(44)).astype(np.int64)
    kinds = np.bincount(of[new], minlength=len(n))
    by_words = long_ & (kinds <= (FEW_KINDS + 1 - least) / least * n + 1)
    by_runs = (n <= PLAIN_WORDS / least + 1) | (kinds > FEW_KINDS * n)
    begin = np.flatnonzero(new)
    again = np.arange(len(codes)) - begin[np.cumsum(new) - 1] if len(codes) else np.zeros(0, np.int64)
    some = by_words[of]
    codes, of, again = codes[some] & WORD_BITS, of[some], again[some]
    rank = 3 * rarity[(codes & np.uint64(len(rarity) - 1)).astype(np.int64)].astype(np.int64) - (6 * np.log2(again + 1)).astype(np.int64)
    hashes = mix64(mix64(codes) + again.astype(np.uint64))
    return (of.astype(np.uint64), hashes, np.maximum(rank, 0).astype(np.uint64)), by_runs


def run_keys(words: np.ndarray, first: np.ndarray, n: np.ndarray, rarity: np.ndarray, least: float, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line number, key and ``place_codes`` of the runs that each line is found by, ordered by line.

    Their order is by ``rarity`` of their words, but that of the longest runs
    by their own ``common`` rank where that is higher: passages that unlike
    lines share come last, even those of rare words.  The first of all runs, in their order, that the edits leave alone is
    among both lines' keys; if neither line repeats it, its places tell.
    """
    sizes, which = np.unique(n, return_inverse=True)
    wanted = np.array([run_counts(int(x), least) for x in sizes], dtype=np.int64).reshape(-1, len(RUNS))[which]
    lengths = [run_lengths(int(x), least) for x in sizes]
    line = np.repeat(np.arange(len(n)), n)
    left = np.repeat(first + n, n) - np.arange(len(words))
    ranks = rarity[(words & np.uint64(len(rarity) - 1)).astype(np.int64)].astype(np.uint64)
    tokens, by_runs = word_tokens(words, line, n, rarity, least)
    made = []
    for q in (0, *LONG_RUNS, *RUNS):
        if q:
            some = np.array([q in x for x in lengths], dtype=bool)[which] & by_runs if q in LONG_RUNS else wanted[:, RUNS.index(q)] > 0
            at = np.flatnonzero((left >= q) & some[line])
            h, rank = run_hashes(words, at, q), np.zeros(len(at), dtype=np.uint64)
            for j in range(q):
                rank += ranks[at + j]
            if q == LONG_RUNS[0] and common is not None:
                rank = np.maximum(rank, common[(h & np.uint64(len(common) - 1)).astype(np.int64)])
            of = line[at].astype(np.uint64)
        else:
            of, h, rank = tokens
            at = np.zeros(len(of), dtype=np.int64)
        # runs whose 36 bits agree count as one, in every line alike
        order = np.argsort(of << np.uint64(44) | rank << np.uint64(36) | h >> np.uint64(28))
        h, rank, of, at = h[order], rank[order], of[order], at[order]
        name = h >> np.uint64(28) | rank << np.uint64(36)
        new = np.ones(len(of) + 1, dtype=bool)
        new[1:-1] = (name[1:] != name[:-1]) | (of[1:] != of[:-1])
        new, alone = new[:-1], new[:-1] & new[1:] & (q > 0)
        of = of.astype(np.int64)
        if q in LONG_RUNS:
            unlike = np.cumsum(new)
            many = held_runs(of, at - first[of], unlike - unlike[np.searchsorted(of, of)], n, q, least)
        else:
            many = wanted[:, RUNS.index(q)] if q else edits_allowed(n, least) + 1
        h, of, at, alone = h[new], of[new], at[new], alone[new]
        keep = np.arange(len(of)) - np.searchsorted(of, of) < many[of]
        h, of, at, alone = h[keep], of[keep], at[keep], alone[keep]
        made.append((of, h, place_codes(n[of], at - first[of], alone)))
    of, key, places = (np.concatenate(x) for x in zip(*made))
    order = np.argsort(of, kind="stable")
    return of[order], key[order], places[order]


def word_levels(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each line, bits that tell of which of ``KINDS`` of words it has at least 1, 2, ... ``LEVELS``; an edit changes two at most."""
    line = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words))))
    counts = np.bincount(line * KINDS + (words >> np.uint64(56)).astype(np.int64), minlength=len(first) * KINDS).reshape(len(first), KINDS)
    return np.concatenate([np.packbits(counts > level, axis=1).view(np.int64) for level in range(LEVELS)], axis=1)


def word_counts(words: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.Array:
    """For each line, how many words it has of each of the kinds that ``FINER`` gives its length, 255 at most, as bytes; null for short lines."""
    out = np.full(len(n), None, dtype=object)
    for (above, kinds), most in zip(FINER, [*[above for above, _ in FINER[1:]], np.inf]):
        at = np.flatnonzero((n > above) & (n <= most))
        step = max(1, (1 << 20) // kinds)
        for low in range(0, len(at), step):
            part = at[low : low + step]
            place = np.arange(n[part].sum()) + np.repeat(first[part] - np.cumsum(n[part]) + n[part], n[part])
            of = np.repeat(np.arange(len(part)), n[part]) * kinds + (words[place] >> np.uint64(65 - kinds.bit_length())).astype(np.int64)
            data = np.minimum(np.bincount(of, minlength=len(part) * kinds), 255).astype(np.uint8).tobytes()
            out[part] = [data[i : i + kinds] for i in range(0, len(data), kinds)]
    return pa.array(out, type=pa.binary())


def coarser(counts: list[bytes], kinds: int) -> np.ndarray:
    """Word counts, a row each, of so many kinds, 255 at most: counts of more kinds are added up."""
    out = np.zeros((len(counts), kinds), dtype=np.uint8)
    sizes = np.array([len(c) for c in counts])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        finer = np.frombuffer(b"".join(counts[i] for i in at.tolist()), dtype=np.uint8).reshape(len(at), kinds, size // kinds)
        out[at] = np.minimum(finer.sum(axis=2, dtype=np.int64), 255)
    return out


def near_counts(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether rows of word counts allow ``most`` edits, each of which takes one word at most from either side."""
    change = a.astype(np.int16) - b.astype(np.int16)
    return (np.maximum(change, 0).sum(axis=1, dtype=np.int64) <= most) & (np.maximum(-change, 0).sum(axis=1, dtype=np.int64) <= most)


class LineSplitter:
    """Lines with a word, in groups of texts."""

    def __init__(self):
        self.hasher = WordHasher(SPACES + b"\n", fold=False)

    def __call__(self, column: pa.Array):
        """For each group: texts' bytes, hashes of words, each line's first word, words, h1, h2, text and place there."""
        texts = [(t or "").lower().encode() for t in column.to_pylist()]
        for low, high in byte_groups(texts):
            data = b"\n".join(texts[low:high])
            starts, words = self.hasher(data)
            if not len(starts):
                continue
            breaks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
            of_line = np.searchsorted(breaks, starts)
            first = np.flatnonzero(np.concatenate(([True], of_line[1:] != of_line[:-1])))
            n = np.diff(np.concatenate((first, [len(words)])))
            place = np.arange(len(words)) - np.repeat(first, n)
            with np.errstate(over="ignore"):
                ordered = mix64(words + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                h1 = np.add.reduceat(ordered, first)
                h2 = np.add.reduceat(mix64(ordered), first)
            doc_starts = np.cumsum([0] + [len(t) + 1 for t in texts[low:high]])
            doc = np.searchsorted(doc_starts, starts[first], side="right") - 1
            edges = np.concatenate(([-1], breaks, [len(data)]))
            yield {"data": data, "words": words, "first": first, "n": n, "h1": h1, "h2": h2, "doc": doc + low, "line": of_line[first] - np.searchsorted(breaks, doc_starts[doc]), "span": (edges[of_line[first]] + 1, edges[of_line[first] + 1])}


def id_bits(ids: DataFrame) -> np.ndarray:
    """A bit for each of ``LINE_BUCKETS`` values of the low bits of the column ``id``, packed: whether some id has it."""
    part = LINE_BUCKETS // SLICES

    def pack(table: pa.Table) -> pa.Table:
        at = table.column("bucket").to_numpy()
        bits = np.zeros(part, dtype=np.uint8)
        bits[at % part] = 1
        return pa.table({"slice": pa.array([int(at[0]) // part], type=pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], type=pa.binary())})

    buckets = ids.select(F.col("id").bitwiseAND(LINE_BUCKETS - 1).cast("int").alias("bucket")).distinct()
    found = {r["slice"]: r["bits"] for r in buckets.groupBy(F.floor(F.col("bucket") / part).alias("slice")).applyInArrow(pack, "slice int, bits binary").collect()}
    return np.concatenate([np.frombuffer(found.get(i, bytes(part // 8)), dtype=np.uint8) for i in range(SLICES)])


def line_table(docs: DataFrame, id_col: str, text_col: str, sketches: bool = False, tally: bool = False, among: np.ndarray | None = None) -> DataFrame:
    """One narrow row per line with a word: doc_id, line, h1, h2 (of the words in order), words, and sim.

    With ``sketches``, instead of sim: the columns ``SKETCH``, ``finer`` and
    ``said``, the line's words, of the lines whose h1 is ``among`` some
    ``id_bits``.  With ``tally``, instead of sim: each task
    adds rows that have only ``slice`` and ``counts``, of all words by their
    hash.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def split(batches):
        splitter, names = LineSplitter(), None
        counts, runs = np.zeros(WORD_BUCKETS, np.int64), np.zeros(RUN_BUCKETS if tally else 0, np.uint32)
        for batch in small_batches(batches):
            for g in splitter(batch.column(1)):
                if among is not None:
                    at = (g["h1"] & np.uint64(LINE_BUCKETS - 1)).astype(np.int64)
                    keep = among[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 > 0
                    words, n = g["words"][np.repeat(keep, g["n"])], g["n"][keep]
                    g |= {c: g[c][keep] for c in ("h1", "h2", "doc", "line")} | {"words": words, "n": n, "first": np.cumsum(n) - n, "span": tuple(x[keep] for x in g["span"])}
                    if not len(n):
                        continue
                columns = {"doc_id": batch.column(0).take(pa.array(g["doc"])), "line": pa.array(g["line"].astype(np.int32)), "h1": pa.array(g["h1"].view(np.int64)), "h2": pa.array(g["h2"].view(np.int64)), "words": pa.array(g["n"].astype(np.int32))}
                if sketches:
                    data, low, high = g["data"], *(x.tolist() for x in g["span"])
                    columns |= {c: pa.array(x) for c, x in zip(SKETCH, np.ascontiguousarray(word_levels(g["words"], g["first"]).T))}
                    columns["finer"] = word_counts(g["words"], g["first"], g["n"])
                    columns["said"] = pa.array([data[a:b].translate(WORD_TABLE) for a, b in zip(low, high)], type=pa.binary()).cast(pa.string())
                elif tally:
                    counts += np.bincount((g["words"] & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), minlength=WORD_BUCKETS)
                    q, words = LONG_RUNS[0], g["words"]
                    with np.errstate(over="ignore"):
                        h = run_hashes(words, np.flatnonzero(np.repeat(g["first"] + g["n"], g["n"]) - np.arange(len(words)) >= q), q)
                    slot, times = np.unique((h & np.uint64(RUN_BUCKETS - 1)).astype(np.int64), return_counts=True)
                    runs[slot] += times.astype(np.uint32)
                else:
                    columns["sim"] = pa.array(sim_hashes(g["words"], g["first"]).view(np.int64))
                if sketches or tally:
                    columns |= {"slice": pa.nulls(len(g["n"]), pa.int32()), "counts": pa.nulls(len(g["n"]), pa.binary())}
                done = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                names = done.schema
                yield done
        if tally and names is not None:
            # after the words' counts those of runs, of which a task has less than 2 ** 16 at one place or as good as that
            parts = [x.tobytes() for x in np.split(counts, SLICES)] + [x.tobytes() for x in np.split(np.minimum(runs, 65535).astype(np.uint16), SLICES)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(2 * SLICES, f.type) for f in names][:-2], pa.array(range(2 * SLICES), type=pa.int32()), pa.array(parts, type=pa.binary())], schema=names)

    more = "".join(f", {c} long" for c in SKETCH) + ", finer binary, said string" if sketches else "" if tally else ", sim long"
    more += ", slice int, counts binary" if sketches or tally else ""
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(split, f"doc_id {id_type}, line int, h1 long, h2 long, words int{more}")


def rarities(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ranks, rare ones low, of all words and of the longest runs by their hash, a byte for each hash, from rows of ``slice, counts``.

    Runs have a rank only where many more are counted than the mean of all
    hashes, which is what unlike runs that share a hash come to.
    """

    def rank(table: pa.Table) -> pa.Table:
        of_words = table.column("slice")[0].as_py() < SLICES
        total = np.zeros((WORD_BUCKETS if of_words else RUN_BUCKETS) // SLICES, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), dtype=np.int64 if of_words else np.uint16)
        ranks = np.minimum(2 * np.log2(total + 1), COMMON // max(LONG_RUNS + RUNS)) if of_words else np.minimum(OCTAVE * np.log2(total + 1), 255)
        return pa.table({"slice": table.column("slice")[:1], "ranks": pa.array([ranks.astype(np.uint8).tobytes()], type=pa.binary()), "total": pa.array([int(total.sum())])})

    rows = counts.select("slice", "counts").groupBy("slice").applyInArrow(rank, "slice int, ranks binary, total long").collect()
    slices = {r["slice"]: r["ranks"] for r in rows}
    words, runs = (np.concatenate([np.frombuffer(slices.get(i, bytes(size // SLICES)), dtype=np.uint8) for i in of]) for size, of in ((WORD_BUCKETS, range(SLICES)), (RUN_BUCKETS, range(SLICES, 2 * SLICES))))
    above = OCTAVE * np.log2(1.5 * sum(r["total"] for r in rows if r["slice"] >= SLICES) / RUN_BUCKETS + 8)
    return words, np.where(runs > above, np.minimum(COMMON + runs - above, 255), 0).astype(np.uint8)


def line_keys(docs: DataFrame, text_col: str, rarity: np.ndarray, common: np.ndarray, least: float, buckets: int) -> DataFrame:
    """Packed entries of the runs that each line, by its h1, is found by."""

    def pack(batches):
        splitter = LineSplitter()
        for batch in small_batches(batches):
            made = []
            for g in splitter(batch.column(0)):
                with np.errstate(over="ignore"):
                    _, at = np.unique(g["h1"], return_index=True)  # copies within a group have one set of keys
                    at.sort()
                    keep = np.zeros(len(g["n"]), dtype=bool)
                    keep[at] = True
                    n = g["n"][keep]
                    of, key, places = run_keys(g["words"][np.repeat(keep, g["n"])], np.concatenate(([0], np.cumsum(n)[:-1])), n, rarity, least, common)
                made.append((key, g["h1"][keep][of], size_codes(n)[of], places))
            if made:
                keys, ids, sizes, places = (np.concatenate(x) for x in zip(*made))
                with np.errstate(over="ignore"):
                    yield from pack_entries(keys, ids, sizes, buckets, places)

    return docs.select(docs[text_col].alias("text")).mapInArrow(pack, PLACED_SCHEMA)


def known_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id``, words, sketches and ``said`` of the ``wanted`` lines (id, doc_id, line: where they occur first)."""
    every = line_table(near_ids(docs, wanted, "doc_id"), "doc_id", "text", sketches=True, among=id_bits(wanted)).drop("doc_id", "h2", "slice", "counts").withColumnRenamed("h1", "id")
    # rows that share a document's id may show a line twice
    return every.join(wanted.select("id", "line"), ["id", "line"]).drop("line").dropDuplicates(["id"])


def close_sql(least: float) -> str:
    """What the lengths and word counts of linked lines a and b meet: an edit takes one word at most from either."""
    edits = f"floor({1 - least!r}D * greatest(a_words, b_words) + 1e-9D)"
    gone, come = (" + ".join(f"bit_count({x}_{c} & ~{y}_{c})" for c in SKETCH) for x, y in ("ab", "ba"))
    return f"abs(a_words - b_words) <= {edits} and {gone} <= {edits} and {come} <= {edits}"


def word_edits(a: list[str], b: list[str]) -> int:
    """Edit distance of two word sequences, a bit of one integer for each word of ``a``."""
    if not a or not b:
        return max(len(a), len(b))
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for w in b:
        eq = at.get(w, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(horizontal | plus) & full
        down = plus & horizontal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = (down | ~(vertical | up)) & full, up & vertical
    return score


def line_words(line: str) -> list[str]:
    return line.lower().encode().translate(WORD_TABLE).decode().split(" ")


WORD_TABLE = bytes(32 if b in SPACES or b == 10 else b for b in range(256))


def similar(a: str, b: str, least: float) -> bool:
    """Whether the word edits of two lines are at most 1 - ``least`` of the longer one's words."""
    x, y = [w for w in line_words(a) if w], [w for w in line_words(b) if w]
    low = 0
    while low < min(len(x), len(y)) and x[low] == y[low]:
        low += 1
    most, x, y = max(len(x), len(y)), x[low:], y[low:]
    while x and y and x[-1] == y[-1]:
        x.pop(), y.pop()
    return abs(len(x) - len(y)) <= (1 - least) * most + 1e-9 and word_edits(x, y) <= (1 - least) * most + 1e-9


BAND_WORDS = 400  # lines up to here are compared many at a time


def within_edits(words: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], edits: np.ndarray) -> np.ndarray:
    """Whether pairs of word runs, as (first, length) in ``words``, are at most ``edits`` apart.

    One table of distances is filled for all pairs together, a row at a
    time, in a band as wide as the largest number of edits on either side.
    """
    order = np.argsort(a[1])
    (a_first, a_n), (b_first, b_n) = (a[0][order], a[1][order]), (b[0][order], b[1][order])
    top = int(edits.max())
    wide, rows = 2 * top + 1, int(a_n[-1])

    def padded(begin: np.ndarray, n: np.ndarray, front: int, size: int, none: int) -> np.ndarray:
        at = np.arange(size) - front
        return np.where((at >= 0) & (at < n[:, None]), words[np.clip(begin[:, None] + at, 0, len(words) - 1)], none)

    left, right = padded(a_first, a_n, 0, rows, -1), padded(b_first, b_n, top, rows + wide, -2)
    place = np.arange(wide, dtype=np.int16)
    far = np.int16(1 << 13)
    row = np.repeat(np.where(place >= top, place - top, far).astype(np.int16)[None], len(edits), axis=0)
    result = np.full(len(edits), far)
    ends = np.clip(b_n - a_n + top, 0, wide - 1)
    done = np.searchsorted(a_n, np.arange(rows + 2))  # pairs are in order of their first length
    for i in range(rows + 1):
        low, high = done[i], done[i + 1]
        if i:
            step = row + (left[low:, i - 1 : i] != right[low:, i - 1 : i - 1 + wide])
            np.minimum(step[:, :-1], row[:, 1:] + np.int16(1), out=step[:, :-1])
            if i <= top:
                step[:, : top - i] = far
                step[:, top - i] = i
            step -= place
            np.minimum.accumulate(step, axis=1, out=step)
            step += place
            row = step
        if high > low:
            result[low:high] = row[np.arange(high - low), ends[low:high]]
            row = row[high - low :]
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.arange(len(order))
    return (np.abs(b[1] - a[1]) <= edits) & (result[back] <= edits)


def similar_pairs(left: list[str], right: list[str], least: float) -> np.ndarray:
    """``similar`` for pairs of lines."""
    hasher = WordHasher(SPACES + b"\n", fold=False)
    data = "\n".join(x for pair in zip(left, right) for x in pair).encode()
    with np.errstate(over="ignore"):
        starts, words = hasher(data)
    words = np.unique(words, return_inverse=True)[1].astype(np.int32)
    breaks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)
    cuts = np.searchsorted(starts, np.concatenate(([0], breaks, [len(data)])))
    first, n = cuts[:-1], np.diff(cuts)
    most = np.maximum(n[::2], n[1::2])
    edits = edits_allowed(most, least)
    # an edit takes one word at most from what either line has beyond the other
    pair = np.repeat(np.arange(len(n)) // 2, n)
    worth = np.where(np.repeat(np.arange(len(n)) % 2 == 0, n), 1, -1)
    order = np.lexsort((words, pair))
    pair, kind, worth = pair[order], words[order], worth[order]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(pair)), bool), (pair[1:] != pair[:-1]) | (kind[1:] != kind[:-1]))))
    beyond = np.add.reduceat(worth, start) if len(start) else worth
    more = [np.bincount(pair[start], np.maximum(sign * beyond, 0), len(left)) for sign in (1, -1)]
    open_ = np.maximum(*more) <= edits
    out = np.zeros(len(left), dtype=bool)
    for i in np.flatnonzero(open_ & (most > BAND_WORDS)).tolist():
        out[i] = similar(left[i], right[i], least)
    # most like lines differ in little more than these words: a narrow band shows it
    open_ &= most <= BAND_WORDS
    for allowed in (np.minimum(edits, np.maximum(*more).astype(np.int64) + 2), edits):
        order = np.argsort(allowed)
        order = order[open_[order]]
        low = 0
        while low < len(order):
            # pairs of about as many edits, as many as keep a row of the table small
            step = max(1, (1 << 16) // (2 * int(allowed[order[low]]) + 1))
            part = order[low : low + step]
            part = part[allowed[part] <= 8 + allowed[part[0]] * 2]
            out[part] |= within_edits(words, (first[2 * part], n[2 * part]), (first[2 * part + 1], n[2 * part + 1]), allowed[part])
            low += len(part)
        open_ &= ~out & (allowed < edits)
    return out


def _near_long_lines(known: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """``pairs`` without those of longer lines whose finer word counts are too far apart."""
    finer = known.where("finer is not null").select("id", "words", "finer")
    left, right = (near_ids(finer, pairs.select(F.col(c).alias("id")), "id").toDF(c, f"{x}_words", x) for c, x in (("src", "a"), ("dst", "b")))
    both = pairs.join(left, "src", "left").join(right, "dst", "left").select("src", "dst", "a", "b", F.greatest("a_words", "b_words").alias("words"))

    def test(batches):
        for batch in small_batches(batches):
            a, b = batch.column(2), batch.column(3)
            at = np.flatnonzero(a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False))
            keep = np.ones(batch.num_rows, dtype=bool)
            if len(at):
                counts = [x.take(pa.array(at)).to_pylist() for x in (a, b)]
                kinds = np.minimum(*([len(c) for c in x] for x in counts))
                most = edits_allowed(batch.column(4).take(pa.array(at)).to_numpy(), least)
                for k in np.unique(kinds).tolist():
                    of = np.flatnonzero(kinds == k)
                    keep[at[of]] = near_counts(*(coarser([x[i] for i in of.tolist()], k) for x in counts), most[of])
            yield batch.select([0, 1]).filter(pa.array(keep))

    return both.mapInArrow(test, "src long, dst long")


def _verified(scratch: Scratch, known: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs whose lines are similar."""
    pairs = scratch.keep(_near_long_lines(known, pairs, least))
    texts = known.select("id", "said")
    both = pairs.join(texts.toDF("src", "a"), "src").join(texts.toDF("dst", "b"), "dst")

    def test(batches):
        for batch in small_batches(batches):
            keep = similar_pairs(batch.column(2).to_pylist(), batch.column(3).to_pylist(), least)
            yield batch.select([0, 1]).filter(pa.array(keep))

    found = scratch.keep(both.select("src", "dst", "a", "b").mapInArrow(test, "src long, dst long"))
    scratch.drop(pairs)
    return found


def kept_lines(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line`` of the lines that stay: the first of each group, by doc_id and line, a null id before others.

    Blank lines belong to no group and are not listed.
    """
    scratch = Scratch(docs.sparkSession)
    lines = scratch.keep(line_table(docs, id_col, text_col, tally=True))
    ranks = rarities(lines.where("counts is not null"))
    classes = scratch.keep(lines.where("counts is null").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.min("words").alias("words")))
    scratch.drop(lines)
    words = classes.agg(F.sum("words")).first()[0] or 0
    rows = scratch.keep(shared_rows(line_keys(docs, text_col, *ranks, least, entry_buckets(words * KEYS_PER_WORD)), code_span(least), 1 - least))
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    wanted = scratch.keep(rows.select("id").distinct().join(classes.select(F.col("h1").alias("id"), "first.*"), "id"))
    known = scratch.keep(known_lines(source, wanted))
    scratch.drop(wanted)
    groups = bucket_components(scratch, rows, known.select("id", "words", *SKETCH), close_sql(least), lambda pairs: _verified(scratch, known, pairs, least))
    scratch.drop(known)
    named = classes.select("h1", "h2", "first").join(groups.withColumnRenamed("node", "h1"), "h1", "left")
    group = [F.coalesce("component", "h1").alias("g"), F.when(F.col("component").isNull(), F.col("h2")).alias("h")]
    return named.groupBy(*group).agg(F.min("first").alias("first")).select("first.*")


def dedup_lines(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with later occurrences of like lines taken out of their texts.

    Adds ``n_lines`` and ``n_dropped`` (columns of these names are replaced).
    Blank lines stay.  A null text stays null with no lines; an empty text
    has one blank line.  A text that loses all its words keeps its blank
    lines.  Texts may be of any length; a line is compared whole.  Rows that
    share an id are taken as copies of one document: each keeps the lines
    that the document keeps.  Rows with a null id are one such document,
    which comes before all others.  Other columns pass, whatever their
    names.  An empty table gives an empty one.
    """
    held, doc = free_name(docs, "_kept"), free_name(docs, "_doc")
    kept = kept_lines(docs, least, id_col, text_col).groupBy("doc_id").agg(F.collect_list("line").alias(held)).withColumnRenamed("doc_id", doc)
    added = ("n_lines", "n_dropped")
    names = [c for c in docs.columns if c not in added]
    joined = docs.join(kept, docs[id_col].eqNullSafe(kept[doc]), "left").select(*[docs[c] for c in names], kept[held])
    at = names.index(text_col)
    schema = docs.select(*names).schema.add("n_lines", "long").add("n_dropped", "long")

    def rewrite(batches):
        for batch in small_batches(batches):
            texts, lines_, dropped = [], [], []
            for text, stay in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                if text is None:
                    texts.append(None), lines_.append(0), dropped.append(0)
                    continue
                parts, stay = text.split("\n"), set(stay or ())
                left = [x for i, x in enumerate(parts) if i in stay or not WORDED.search(x)]
                texts.append("\n".join(left)), lines_.append(len(parts)), dropped.append(len(parts) - len(left))
            columns = [pa.array(texts, type=pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines_, type=pa.int64()), pa.array(dropped, type=pa.int64())], names=schema.names)

    return joined.mapInArrow(rewrite, schema)
