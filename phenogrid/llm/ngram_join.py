"""Exact Jaccard self-join of word-shingle sets by partitioning the universe.

Sets that link differ in few shingles: at most (1-t)/(1+t) of their sizes'
sum.  For each size band the universe of shingle hashes is cut into groups
of segments.  The differences of a link are too few to spoil every group: in
one of them all but a few segments, or all but one shingle, agree.  So a set
is listed under the sums of its hashes over each subset of a group's
segments that leaves these few out, or over the group less one shingle.
How many groups and segments is settled by cost.  Candidates whose parity
sketches differ too much are passed over; the rest is verified on its words.
Sets go by a 64-bit hash until then.

Before that, sets that cannot have a partner are put aside: a set that links
has few shingles that occur in no other set, and counting these over a part
of the universe a little larger than that number already shows most of them.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.llm.common import ENTRY_SCHEMA, Scratch, WordHasher, bucket_components, byte_groups, code_span, connected_components, entry_buckets, mix64, near_ids, pack_entries, shared_counts, shared_rows, size_codes, small_batches

SKETCH = 512
SPACES = b" \t\n\x0b\x0c\r"


def band_tops(percent: int, most: int) -> np.ndarray:
    """Largest size of each band; a set's partners lie in its own or a neighbouring band."""
    tops = [1]
    while tops[-1] < most:
        tops.append(max(tops[-1] + 1, tops[-1] * 100 // percent))
    return np.array(tops, dtype=np.int64)


def differences(sizes: int, percent: int) -> int:
    """Most shingles that two linked sets of together ``sizes`` can differ in."""
    return sizes * (100 - percent) // (100 + percent)


def plan(top: int, percent: int, rows: int, common: float = 0.1) -> tuple[int, int, int]:
    """Groups of a band, segments in each, and segments left out of a key.

    A link between sets of at most ``top`` shingles has at most d differences.
    With g * (e + 1) > d, one of g groups has at most e of them, so some key
    that leaves e of the group's segments out agrees.  0 segments stand for
    the one-deletion neighbourhood, which leaves out one shingle.  The
    cheapest plan counts the keys written and the strangers met under them:
    segments hold a Poisson number of shingles, each shared by chance with
    probability ``common``, and a band a sixteenth of the rows.
    """
    d = differences(2 * top, percent)
    if d == 0:
        return 0, 0, 0
    best = None
    for out, segments in ((0, 1), (1, 0), (1, 3), (1, 4), (1, 5), (2, 5), (2, 6), (2, 7)):
        groups = -(-(d + 1) // (out + 1))
        size = 0.75 * top / groups  # sets of a band and the one below it
        keys = math.comb(segments, out) if segments else size + 1
        held = size * (1 - out / segments) if segments else size - 1
        cost = groups * keys * (1 + rows / 16 * math.exp(-2 * held * (1 - common)))
        if best is None or cost < best[0]:
            best = cost, groups, segments, out
    return best[1:]


class Signer:
    """Sizes, hashes, sketches and index keys of shingle sets, many texts at once."""

    def __init__(self, width: int, percent: int, rows: int = 0):
        self.hasher = WordHasher(SPACES)
        self.width, self.percent, self.rows = width, percent, rows
        self.probe = min(1.0, 1.3 * (100 - percent) / 100)
        self.tops = band_tops(percent, 2)
        self.bands: dict[int, tuple] = {}

    def _band(self, label: int) -> tuple:
        """Edges of a band's segments, tags of its groups and of their subsets."""
        if label not in self.bands:
            groups, segments, out = plan(int(self.tops[label]), self.percent, self.rows)
            pieces = groups * max(segments, 1)
            edges = (np.arange(1, pieces, dtype=np.float64) * (2.0**64 / max(pieces, 1))).astype(np.uint64)
            tag = mix64(np.arange(groups, dtype=np.uint64) + np.uint64(label) * np.uint64(1 << 32) + np.uint64(1))
            subsets = [(list(c), mix64(tag + np.uint64(i))) for i, c in enumerate(combinations(range(segments), out))] if segments else []
            self.bands[label] = groups, edges, tag, subsets
        return self.bands[label]

    def keys_in_all(self, sizes: DataFrame) -> float:
        """About how many index keys sets of the sizes ``n`` are listed under, all together."""
        return sum(r["sets"] * self._keys_of(r["n"]) for r in sizes.groupBy(F.ceil(F.log2("n") * 2).alias("size")).agg(F.count("*").alias("sets"), F.max("n").alias("n")).collect())

    def _keys_of(self, n: int) -> int:
        while np.searchsorted(self.tops, n) + 1 >= len(self.tops):
            self.tops = band_tops(self.percent, 2 * int(self.tops[-1]))
        band, total = int(np.searchsorted(self.tops, n)), 0
        for label in (band, band + 1):
            groups, _, _, subsets = self._band(label)
            total += groups * len(subsets) if subsets else n + groups if groups else 0
        return total

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingle hashes of each text, end to end, and where each begins."""
        starts, words = self.hasher(b" ".join(texts))
        cuts = np.searchsorted(starts, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))))
        width = self.width

        def joined(n: int, k: int, low: int = 0) -> np.ndarray:
            total = np.full(max(n - k + 1, 0), k, dtype=np.uint64)
            for i in range(k):
                total = mix64(total + words[low + i : low + n - k + 1 + i] * np.uint64(2 * i + 3))
            return total

        shingles = joined(len(words), width)
        parts = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            h = shingles[a : b - width + 1] if b - a >= width else joined(b - a, b - a, a) if b > a else words[:0]
            h = np.sort(h)
            parts.append(h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    @staticmethod
    def names(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each set."""
        first = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)))))
        second = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes)))
        return mix64(first[at[1:]] - first[at[:-1]]), second[at[1:]] - second[at[:-1]]

    def sign(self, texts: list[bytes]) -> pa.RecordBatch:
        """Size and two hashes of each text's set, and how many of its hashes lie below ``probe``."""
        hashes, at = self.sets(texts)
        h1, h2 = self.names(hashes, at)
        probed = np.concatenate(([0], np.cumsum(self._probed(hashes))))
        return pa.record_batch([pa.array(np.diff(at)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(np.diff(probed[at]))], names=["n", "h1", "h2", "probed"])

    def _probed(self, hashes: np.ndarray) -> np.ndarray:
        return hashes < np.uint64(min(int(self.probe * 2.0**64), (1 << 64) - 1))

    def probes(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Hashes below ``probe``, spread anew, with the name and size code of the set that each is of."""
        hashes, at = self.sets(texts)
        sizes, low = np.diff(at), self._probed(hashes)
        return mix64(hashes[low]), np.repeat(self.names(hashes, at)[0], sizes)[low], np.repeat(size_codes(sizes), sizes)[low]

    def sketch(self, texts: list[bytes]) -> pa.RecordBatch:
        """Name, size and parity sketch of each text's set; differing shingles change at least as many bits of it."""
        hashes, at = self.sets(texts)
        sizes = np.diff(at)
        cell = np.repeat(np.arange(len(sizes)) * SKETCH, sizes) + (hashes & np.uint64(SKETCH - 1)).astype(np.int64)
        odd = np.bincount(cell, minlength=len(sizes) * SKETCH) & 1
        sketches = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(sizes), -1)
        return pa.record_batch([pa.array(self.names(hashes, at)[0].view(np.int64)), pa.array(sizes), *map(pa.array, np.ascontiguousarray(sketches.T))], names=["id", "n", *[f"s{i}" for i in range(SKETCH // 64)]])

    def keys(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Index keys, with the name and size code of the set that each is of."""
        hashes, at = self.sets(texts)
        value = mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
        sizes = np.diff(at)
        while np.searchsorted(self.tops, sizes.max(initial=0)) + 1 >= len(self.tops):
            self.tops = band_tops(self.percent, 2 * int(self.tops[-1]))
        bands = np.searchsorted(self.tops, sizes)
        found, counts = [], []
        for low, n, band in zip(at.tolist(), sizes.tolist(), bands.tolist()):
            before = len(found)
            for label in (band, band + 1) if n else ():
                groups, edges, tag, subsets = self._band(label)
                if not groups:
                    continue
                cut = np.concatenate(([0], np.searchsorted(hashes[low : low + n], edges), [n])) + low
                part = np.diff(sums[cut]).reshape(groups, -1)
                if not subsets:
                    whole = part[:, 0] + tag
                    found.append(whole)
                    found.append(np.repeat(whole, np.diff(cut)) - value[low : low + n])
                    continue
                whole = part.sum(axis=1)
                for left_out, subset_tag in subsets:
                    held = whole + subset_tag
                    for i in left_out:
                        held = held - part[:, i]
                    found.append(held)
            counts.append(sum(map(len, found[before:])))
        return mix64(np.concatenate(found)) if found else np.zeros(0, np.uint64), np.repeat(self.names(hashes, at)[0], counts), np.repeat(size_codes(sizes), counts)


def _rows(docs: DataFrame, signer: Signer, method: str, schema: str, carry: bool = False) -> DataFrame:
    """A row for each text of ``id, text``, made by a method of ``signer`` over a bounded amount of text at a time; with its id, if it is to ``carry`` it."""

    def run(batches):
        for batch in small_batches(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for low, high in byte_groups(texts):
                with np.errstate(over="ignore"):
                    made = getattr(signer, method)([t or b"" for t in texts[low:high]])
                if carry:
                    made = pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *made.columns], names=["id", *made.schema.names])
                yield made

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, {schema}" if carry else schema)


def _entries(docs: DataFrame, signer: Signer, method: str, buckets: int) -> DataFrame:
    """Packed entries of what a method of ``signer`` lists for the texts."""

    def run(batches):
        for batch in small_batches(batches):
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            with np.errstate(over="ignore"):
                made = [getattr(signer, method)([t or b"" for t in texts[low:high]]) for low, high in byte_groups(texts)]
                if made:
                    yield from pack_entries(*map(np.concatenate, zip(*made)), buckets)

    return docs.select("text").mapInArrow(run, ENTRY_SCHEMA)


def shingle_set(text: bytes, width: int) -> set:
    words = text.lower().split()
    if 0 < len(words) < width:
        return {tuple(words)}
    return set(zip(*[words[i:] for i in range(width)]))


def close_sketches(percent: int) -> str:
    """SQL: the sizes and sketches of two sets allow a link."""
    bits = " + ".join(f"bit_count(a_s{i} ^ b_s{i})" for i in range(SKETCH // 64))
    return f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n) and {100 + percent} * ({bits}) <= {100 - percent} * (a_n + b_n)"


def verified(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs of ids whose shingle sets, taken from their words, are alike enough."""
    both = pairs.join(texts.toDF("src", "a"), "src").join(texts.toDF("dst", "b"), "dst")

    def test(batches):
        for batch in small_batches(batches):
            keep, held = [], {}
            left, right = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            for i in range(batch.num_rows):
                sets = []
                for t in (left[i].as_py(), right[i].as_py()):
                    if t not in held:
                        if len(held) > 64:
                            held.clear()
                        held[t] = shingle_set(t, width)
                    sets.append(held[t])
                common = len(sets[0] & sets[1])
                keep.append(100 * common >= percent * (len(sets[0]) + len(sets[1]) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))

    id_type = pairs.schema["src"].dataType.simpleString()
    return both.select("src", "dst", "a", "b").mapInArrow(test, f"src {id_type}, dst {id_type}")


def jaccard_groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, ``n_shingles`` and ``component_id``, the smallest id its links reach.

    Rows link when their sets of ``width``-word shingles have a Jaccard
    likeness of ``percent`` / 100 at least.  Words are runs of other than
    ASCII white space, ASCII-lower-cased.  Null, empty and blank texts have
    no shingles and link with nothing: their component is their own id.
    Texts may be of any length; their sets are whole.  Rows of equal sets
    are one class from the start.  Ids should be unique; rows that share an
    id are taken as one node, each keeping its own size, and a null id is a
    component of its own.  Other columns are not read, whatever their names.
    An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    signer = Signer(width, percent)
    signed = scratch.keep(_rows(source, signer, "sign", "n long, h1 long, h2 long, probed long", carry=True))
    usable = signed.where("n > 0 and id is not null")
    classes = scratch.keep(usable.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.min("probed").alias("probed")))
    probed = classes.agg(F.sum("probed")).first()[0] or 0
    buckets = entry_buckets(probed)
    shared = shared_counts(_entries(source, signer, "probes", buckets), buckets).withColumnRenamed("id", "h1")
    # the shingles that no other set has are at most as many as a link allows
    able = classes.join(shared, "h1", "left").where(f"probed - coalesce(shared, 0) <= {100 - percent} * n div 100")
    able = scratch.keep(able.select("rep", "h1", "n"))
    texts = near_ids(source.where("id is not null"), able.select(F.col("rep").alias("id")), "id")
    signer = Signer(width, percent, able.count())
    candidates = scratch.keep(shared_rows(_entries(texts, signer, "keys", entry_buckets(signer.keys_in_all(able))), code_span(percent / 100)))
    sketch = [f"s{i}" for i in range(SKETCH // 64)]
    sketches = _rows(texts, signer, "sketch", "id long, n long, " + ", ".join(f"{c} long" for c in sketch))
    sketches = scratch.keep(sketches.groupBy("id").agg(*[F.first(c).alias(c) for c in ("n", *sketch)]))

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("src", "dst")).alias("h1")).distinct()
        reps = scratch.keep(wanted.join(able, "h1").groupBy("h1").agg(F.min("rep").alias("id")))
        found = scratch.keep(near_ids(source, reps, "id").join(reps, "id").groupBy("h1").agg(F.first("text").alias("text")))
        linked = scratch.keep(verified(found.withColumnRenamed("h1", "id"), pairs, width, percent))
        scratch.drop(reps, found)
        return linked

    groups = bucket_components(scratch, candidates, sketches, close_sketches(percent), verify)
    scratch.drop(sketches)
    # rows that share an id but not a text tie their sets together
    several = usable.groupBy("id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo < hi").select("id", "lo")
    ties = usable.select("id", "h1").join(several, "id").select(F.col("h1").alias("src"), F.col("lo").alias("dst"))
    if not several.isEmpty():
        groups = scratch.keep(connected_components(groups.toDF("src", "dst").union(ties), scratch))
    placed = classes.join(groups.withColumnRenamed("node", "h1"), "h1", "left").select("h1", "rep", F.coalesce("component", "h1").alias("group"))
    least = placed.groupBy("group").agg(F.min("rep").alias("least"))
    of = scratch.keep(placed.join(least, "group").groupBy("h1").agg(F.min("least").alias("component")).where("component is not null"))
    named = signed.withColumn("h1", F.when(F.col("n") > 0, F.col("h1"))).join(of, "h1", "left")
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
