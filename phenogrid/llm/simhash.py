"""SimHash near-duplicates by segment popcounts.

A fingerprint is cut into segments, and each is mapped to how many of its
bits are set.  The Manhattan distance of two such points is at most the
fingerprints' Hamming distance, so points that are farther apart belong to
no link.  A point is kept in unary: of each segment's bits the lowest ones
are set, as many as are set in the fingerprint; the distance is then a count
of differing bits.

Points meet in a grid.  The segments are dealt to ``most // 2 + 1`` parts;
linked points are at most one step apart in some part.  So every point goes
to the cell of each of its parts and to the cells one step up.  Points that
share a cell are tested on all segments, then on the fingerprints.  A cell
of many points is cut into blocks, and pairs of blocks are met; what leaves
a cell is a spanning forest of its links, not the links.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.llm.common import Scratch, connected_components, small_batches

SEED = 42
WORDS_AT_ONCE = 1 << 15
WIDTHS = (2, 1)  # bits of a segment, to be chosen from
BLOCK = 1 << 13  # points that a task compares with each other, or with so many others
ENTRIES_PER_BUCKET = 1 << 17
SMALL_CELL = 16


def fingerprint(text: bytes, width: int = 3) -> np.uint64:
    """SimHash of the word shingles of a text, repeats included: a bit is set if it is in over half the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return np.uint64(0)
    width = min(width, len(words))
    total, count = np.zeros(64, dtype=np.int64), len(words) - width + 1
    for low in range(0, count, WORDS_AT_ONCE):
        part = words[low : low + WORDS_AT_ONCE + width - 1]
        shingles = map(b" ".join, zip(*[part[i:] for i in range(width)]))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * total > count).view("<u8")[0]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """``id, fp`` of every row; 0 for a text without words and for null."""

    def sign(batches):
        for batch in small_batches(batches):
            made = [fingerprint((t or "").encode(), width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(made, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(sign, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def low_bits(width: int) -> int:
    """The lowest bit of each segment."""
    return sum(1 << i for i in range(0, 64, width))


def points(fps: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints with each segment's set bits moved to its low end."""
    low = np.uint64(low_bits(width))
    bits = [fps >> np.uint64(i) & low for i in range(width)]
    for end in range(width - 1, 0, -1):  # bits sink past unset ones
        for i in range(end):
            bits[i], bits[i + 1] = bits[i] | bits[i + 1], bits[i] & bits[i + 1]
    return sum((b << np.uint64(i) for i, b in enumerate(bits)), np.zeros_like(fps))


def cells(fps: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each fingerprint's point and of the points one step up in a part, and the fingerprint of each cell."""
    at, found, of = points(fps, width), [], []
    for part, segments in enumerate(np.array_split(np.arange(64 // width), most // 2 + 1)):
        low, bits = int(segments[0]) * width, len(segments) * width
        own = at >> np.uint64(low) & np.uint64((1 << bits) - 1)
        steps = [own]
        for s in range(0, bits, width) if most else ():
            filled = own >> np.uint64(s) & np.uint64((1 << width) - 1)
            steps.append(own | (filled << np.uint64(1) | np.uint64(1)) << np.uint64(s) & np.uint64(((1 << width) - 1) << s))
        for i, step in enumerate(steps):
            new = step != own if i else np.ones(len(own), dtype=bool)
            # parts have no more than 64 bits: the part's number spreads what would be equal
            found.append(step[new] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(part + 1) * np.uint64(0xD6E8FEB86659FD93))
            of.append(fps[new])
    return np.concatenate(found), np.concatenate(of)


def segment_width(rows: int, most: int) -> int:
    """Bits of a segment, by cost: wide ones write fewer cells, narrow ones bring fewer strangers into a cell."""
    best = None
    for width in WIDTHS:
        # chance that the counts of two random segments are equal, and that they differ by one
        ways = np.array([1.0])
        for _ in range(2 * width):
            ways = np.convolve(ways, [0.5, 0.5])
        same, next_ = ways[width], 2 * ways[width + 1]
        n = 64 // width / (most // 2 + 1)
        strangers = rows * same**n * (1 + n * next_ / same)
        written = 1 + n * (1 - 0.5**width)
        cost = written * (40 + strangers)
        if best is None or cost < best[0]:
            best = cost, width
    return best[1]


def forest(fps: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among distinct fingerprints, each compared with those that are not yet reached."""
    at, left, src, dst = points(fps, width), np.ones(len(fps), dtype=bool), [], []
    for first in range(len(fps)):
        if not left[first]:
            continue
        left[first] = False
        front = np.array([first])
        while len(front):
            reached = []
            rest = np.flatnonzero(left)
            step = max(1, (1 << 20) // max(len(rest), 1))
            for low in range(0, len(front), step):
                some = front[low : low + step]
                a, b = np.nonzero(np.bitwise_count(at[some, None] ^ at[None, rest]) <= most)
                linked = np.bitwise_count(fps[some[a]] ^ fps[rest[b]]) <= most
                b, once = np.unique(b[linked], return_index=True)
                src.append(fps[some[a[linked][once]]])
                dst.append(fps[rest[b]])
                reached.append(rest[b])
                left[rest[b]] = False
                rest = np.delete(rest, b)
            front = np.concatenate(reached)
    return np.concatenate(src or [fps[:0]]), np.concatenate(dst or [fps[:0]])


def cell_links(cell: np.ndarray, fps: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that tie together all that is linked within a cell, for many cells."""
    order = np.lexsort((fps, cell))
    cell, fps = cell[order], fps[order]
    new = np.ones(len(fps), dtype=bool)
    new[1:] = (cell[1:] != cell[:-1]) | (fps[1:] != fps[:-1])
    cell, fps = cell[new], fps[new]
    begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(cell)), dtype=bool), cell[1:] != cell[:-1])))
    size = np.diff(np.append(begin, len(cell)))
    src, dst = [fps[:0]], [fps[:0]]
    small = np.repeat(size <= SMALL_CELL, size)
    at, cell_, fps_ = points(fps[small], width), cell[small], fps[small]
    for lag in range(1, min(SMALL_CELL, len(fps_))):
        i = np.flatnonzero(cell_[lag:] == cell_[:-lag])
        if not len(i):
            break
        i = i[np.bitwise_count(at[i] ^ at[i + lag]) <= most]
        i = i[np.bitwise_count(fps_[i] ^ fps_[i + lag]) <= most]
        src.append(fps_[i]), dst.append(fps_[i + lag])
    for low, n in zip(begin[size > SMALL_CELL].tolist(), size[size > SMALL_CELL].tolist()):
        a, b = forest(fps[low : low + n], width, most)
        src.append(a), dst.append(b)
    a, b = np.concatenate(src), np.concatenate(dst)
    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _in_cells(classes: DataFrame, width: int, most: int) -> DataFrame:
    """``cell, fp``: the cells of every fingerprint."""

    def spread(batches):
        for batch in small_batches(batches):
            with np.errstate(over="ignore"):
                cell, fps = cells(batch.column(0).to_numpy().view(np.uint64), width, most)
            for low in range(0, len(cell), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[low : low + (1 << 16)].view(np.int64)) for x in (cell, fps)], names=["cell", "fp"])

    return classes.select("fp").mapInArrow(spread, "cell long, fp long")


def _block_pairs(blocks: Column, own: Column) -> Column:
    """Names of the pairs of a cell's blocks that a block is in."""
    return F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda other: F.xxhash64("cell", F.least(own, other), F.greatest(own, other)))


def links(classes: DataFrame, scratch: Scratch, most: int = 3) -> DataFrame:
    """``src, dst``: links that tie together all distinct fingerprints ``fp`` that links of at most ``most`` bits do."""
    rows = classes.count()
    width = segment_width(rows, most)
    entries = _in_cells(classes, width, most)
    # a table of known size: only a large one has the entries shuffled for the join
    heavy = scratch.keep(entries.groupBy("cell").agg(F.count("*").alias("n")).where(f"n > {BLOCK}"))
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = entries.join(heavy, "cell", "left").select(
        "fp", F.explode(F.when(F.col("n").isNull(), F.array(F.xxhash64("cell"))).otherwise(_block_pairs(blocks, F.pmod(F.xxhash64("fp", "cell"), blocks)))).alias("cell"))
    buckets = max(1, -(-rows * (most // 2 + 1) * (1 + 64 // width) // ENTRIES_PER_BUCKET))

    def meet(table: pa.Table) -> pa.Table:
        a, b = cell_links(*(table.column(c).to_numpy().view(np.uint64) for c in ("cell", "fp")), width, most)
        return pa.table({"src": a.view(np.int64), "dst": b.view(np.int64)})

    return dealt.withColumn("bucket", F.pmod("cell", F.lit(buckets))).groupBy("bucket").applyInArrow(meet, "src long, dst long")


def simhash_groups(docs: DataFrame, width: int = 3, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, ``fingerprint`` (a long, of 64 bits) and ``component_id``, the smallest id its links reach.

    Rows link when their fingerprints differ in ``most`` bits at most.  Words
    are runs of other than ASCII white space, ASCII-lower-cased; texts of
    fewer than ``width`` words are one shingle.  Null, empty and blank texts
    have fingerprint 0 and link like any other.  Texts may be of any length
    and are read whole.  Equal fingerprints are one class from the start.
    Rows that share an id are rows each, and links of either count for that
    id's component only through the fingerprints.  Rows with a null id link
    too; where no other id is reached, ``component_id`` is null.  Other
    columns are not read, whatever their names.  An empty table gives an
    empty one.
    """
    scratch = Scratch(docs.sparkSession)
    signed = scratch.keep(fingerprints(docs, id_col, text_col, width))
    classes = scratch.keep(signed.groupBy("fp").agg(F.min("id").alias("least")))
    found = scratch.keep(links(classes, scratch, most))
    groups = connected_components(found, scratch).toDF("fp", "component")
    named = scratch.keep(classes.join(groups, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = scratch.keep(named.join(least, "component").select("fp", "component_id"))
    scratch.drop(classes, found, named)
    return signed.join(placed, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")
