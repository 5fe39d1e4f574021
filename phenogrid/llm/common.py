"""What several corpus operators share: stored tables, hashing, shared keys, components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``; where none is named, a temporary one in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def _shuffles_freed(spark: SparkSession):
    """What is run inside gives back its shuffle files as soon as its result is written."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


class Scratch:
    """The intermediate tables of one job, as Parquet in the shared checkpoint folder.

    They cut lineage and outlive executors, only the columns that are asked
    for are read again, and a table goes when it has served.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.folder = f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"
        self.kept: list[tuple[DataFrame, str]] = []
        self.count = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, written once and read from there."""
        path, self.count = f"{self.folder}/{self.count}", self.count + 1
        with _shuffles_freed(self.spark):
            df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.kept.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of ``keep`` on which nothing depends any more."""
        gone = [k for k in self.kept if any(k[0] is t for t in tables)]
        self.kept = [k for k in self.kept if not any(k is g for g in gone)]
        for _, path in gone:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    with np.errstate(over="ignore"):
        up = np.full(n, _BASE, dtype=np.uint64)
        down = np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[:1] = down[:1] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


class WordHasher:
    """Hashes all words of a byte buffer at once.

    Words are runs of bytes for which ``is_space`` is false.  A word's hash
    is a polynomial of its bytes, taken from one running sum, then mixed.
    """

    def __init__(self, spaces: bytes, fold: bool = True):
        self.space = np.zeros(256, dtype=bool)
        self.space[list(spaces)] = True
        self.byte = np.arange(256, dtype=np.uint64) + np.uint64(1)
        if fold:
            self.byte[65:91] = self.byte[97:123]
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def _slice(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(data, dtype=np.uint8)
        edge = np.diff(np.concatenate(([1], self.space[raw].view(np.int8), [1])))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(raw) > len(self.up):
            self.up, self.down = _powers(max(len(raw), 1 << 16))
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.byte[raw] * self.up[: len(raw)], out=sums[1:])
        return starts, ends, mix64((sums[ends] - sums[starts]) * self.down[starts])

    def __call__(self, data: bytes, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the words of ``data``, worked out ``step`` bytes at a time."""
        starts, hashes, low, size = [], [], 0, step
        while low < len(data):
            at, ends, word = self._slice(data[low : low + size])
            if low + size < len(data) and len(at) and ends[-1] == size:
                if at[-1] == 0:  # one word fills the slice: take a longer one
                    size *= 2
                    continue
                cut = int(at[-1])
                at, word = at[:-1], word[:-1]
            else:
                cut = size
            starts.append(at + low)
            hashes.append(word)
            low, size = low + cut, step
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(starts), np.concatenate(hashes)


def byte_groups(texts: list[bytes | None], most: int = 1 << 20):
    """Index ranges of consecutive texts of about ``most`` bytes together; a longer text stands alone."""
    low, held = 0, 0
    for i, text in enumerate(texts):
        n = len(text or b"")
        if held and held + n > most:
            yield low, i
            low, held = i, 0
        held += n
    if low < len(texts):
        yield low, len(texts)


def small_batches(batches, most: int = 1 << 20):
    """Slices of Arrow batches of about ``most`` bytes each, so that few rows at a time become Python objects."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(batch.nbytes, 1))
        for low in range(0, batch.num_rows, step):
            yield batch.slice(low, step)
        del batch


ENTRIES_PER_BUCKET = 1 << 19
KEY_BITS, KEY_BYTES = 39, 5  # of a hash, besides the bits that its bucket stands for; one more bit is a mark
ENTRY_SCHEMA = "bucket int, home int, keys binary, ids binary, sizes binary"
SIZE_STEP = 1.04


def entry_buckets(entries: float) -> int:
    """How many buckets so many entries are dealt to."""
    return max(1, -(-int(entries) // ENTRIES_PER_BUCKET))


def size_codes(sizes: np.ndarray) -> np.ndarray:
    """Sizes as a byte each, on a scale of equal ratios; the largest ones share the last."""
    return np.minimum(np.log(np.maximum(sizes, 1)) / np.log(SIZE_STEP), 255).astype(np.uint8)


def code_span(ratio: float) -> int:
    """How far apart the codes of sizes can be of which one is at least ``ratio`` of the other."""
    return int(np.ceil(-np.log(ratio) / np.log(SIZE_STEP)))


def _blobs(values: np.ndarray, width: int, ends: np.ndarray) -> pa.Array:
    """The low ``width`` bytes of each value, end to end, cut after the places ``ends``."""
    data = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    offsets = np.concatenate(([0], ends)).astype(np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


PLACED_SCHEMA = ENTRY_SCHEMA + ", places binary"
NO_PLACE = (1 << 16) - 1
PARTNERS = 12  # places are compared with those of so many entries on either side; an entry with more partners passes


def place_codes(n: np.ndarray, place: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where in an item of ``n`` parts a key's only run begins, and n; other runs and long items have no place."""
    known = known & (n < NO_PLACE)
    return np.where(known, n, NO_PLACE).astype(np.uint64) | np.where(known, place, NO_PLACE).astype(np.uint64) << np.uint64(16)


def near_codes(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Whether items can be ``share`` of the longer one's parts apart in edits that leave this run alone.

    As many edits come before the run as its places differ by, and as many
    after it as what follows differs in length by.
    """
    low, high = np.uint64(NO_PLACE), np.uint64(16)
    (n, p), (m, q) = (((x & low).astype(np.int64), (x >> high).astype(np.int64)) for x in (a, b))
    edits = np.abs(p - q) + np.abs((n - p) - (m - q))
    return (p == NO_PLACE) | (q == NO_PLACE) | (edits <= np.floor(share * np.maximum(n, m) + 1e-9))


def pack_entries(hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, buckets: int, places: np.ndarray | None = None):
    """Record batches of ``ENTRY_SCHEMA`` for a batch's key hashes, the ids that list them, and the ids' ``size_codes``.

    With ``places``, the ``place_codes`` of the keys, of ``PLACED_SCHEMA``.

    Keys go to buckets by their hash, a row for each bucket.  Of the ids of
    one size that list one key only the first goes there, marked; the others
    are dealt to buckets anew, as they are known to share their key already.
    So a key that very many ids list puts few entries a batch into its
    bucket.
    """
    if not len(hashes):
        return
    ids = ids.astype(np.uint64)
    order = np.lexsort((ids, sizes, hashes))
    hashes, ids, sizes, places = hashes[order], ids[order], sizes[order], None if places is None else places[order]
    same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (sizes[1:] == sizes[:-1])))
    new = ~same | np.concatenate(([True], ids[1:] != ids[:-1]))
    hashes, ids, sizes, places = hashes[new], ids[new], sizes[new], None if places is None else places[new]
    same = np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (sizes[1:] == sizes[:-1])))
    many = np.concatenate((same[1:], [False])) & ~same
    home = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
    keys = hashes & np.uint64((1 << KEY_BITS) - 1) | many.astype(np.uint64) << np.uint64(KEY_BITS)
    turn = int(mix64(hashes[:1] ^ ids[-1:])[0] % np.uint64(buckets))
    for part, moved in ((~same, 0), (same, turn)):
        if part.any():
            at = home[part]
            ends = np.concatenate((np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]))
            homes = at[ends - 1]
            columns = [pa.array((homes + np.int64(moved)) % buckets, type=pa.int32()), pa.array(homes), _blobs(keys[part], KEY_BYTES, ends), _blobs(ids[part], 8, ends), _blobs(sizes[part], 1, ends)]
            names = ["bucket", "home", "keys", "ids", "sizes"]
            if places is not None:
                columns.append(_blobs(places[part], 4, ends)), names.append("places")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _unpacked(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Bucket, home, key, id, size code and place code (0 if there are none) of each entry."""
    raw = {c: [v for chunk in table.column(c).chunks for v in chunk.to_pylist()] for c in ("keys", "ids", "sizes", "places") if c in table.column_names}
    counts = [len(v) for v in raw["sizes"]]
    joined = {c: np.frombuffer(b"".join(v), dtype=np.uint8) for c, v in raw.items()}
    wide = np.zeros((len(joined["sizes"]), 8), dtype=np.uint8)
    wide[:, :KEY_BYTES] = joined["keys"].reshape(-1, KEY_BYTES)
    bucket, home = (np.repeat(table.column(c).to_numpy(), counts) for c in ("bucket", "home"))
    places = joined["places"].view("<u4").astype(np.uint64) if "places" in joined else np.zeros(len(bucket), np.uint64)
    return bucket, home, wide.view("<u8").ravel(), joined["ids"].view("<u8"), joined["sizes"], places


def _shared(table: pa.Table, span: int, share: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Name of the key and id of the entries of a bucket whose key another id of about their size lists, with ``share`` at about their place.

    A marked entry stands for others that are not here, of unknown places.
    """
    bucket, home, key, ids, sizes, places = _unpacked(table)
    many = key >> np.uint64(KEY_BITS) > 0
    key = key & np.uint64((1 << KEY_BITS) - 1)
    name = mix64(key ^ mix64(home.astype(np.uint64) + np.uint64(1)))
    own = bucket == home
    loose = name[~own], ids[~own]
    name, ids, sizes, many, places = name[own], ids[own], sizes[own].astype(np.int16), many[own], places[own]
    order = np.lexsort((~many, ids, sizes, name))
    name, ids, sizes, many, places = name[order], ids[order], sizes[order], many[order], places[order]
    new = np.ones(len(name), dtype=bool)
    new[1:] = (name[1:] != name[:-1]) | (ids[1:] != ids[:-1])
    name, ids, sizes, many, places = name[new], ids[new], sizes[new], many[new], places[new]
    met = many.copy()
    for step in range(1, 2 if share is None else PARTNERS + 2):
        at = np.flatnonzero((name[step:] == name[:-step]) & (sizes[step:] - sizes[:-step] <= span))
        if share is not None and step <= PARTNERS:
            at = at[many[at] | many[at + step] | near_codes(places[at], places[at + step], share)]
        met[at] = met[at + step] = True
    return np.concatenate((name[met], loose[0])), np.concatenate((ids[met], loose[1]))


def shared_rows(entries: DataFrame, span: int, share: float | None = None) -> DataFrame:
    """``key, id`` of the keys that at least two ids of about one size list, from packed entries; now and then a row twice.

    ``span``: the ``code_span`` of sizes that can belong together.  ``share``:
    of entries with places, the edits that can lie between items, as a share
    of the longer one's parts.
    """

    def meet(table: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            name, ids = _shared(table, span, share)
        return pa.table({"key": name.view(np.int64), "id": ids.view(np.int64)})

    return entries.groupBy("bucket").applyInArrow(meet, "key long, id long")


def shared_counts(entries: DataFrame, ranges: int) -> DataFrame:
    """``id, shared``: how many keys of an id other ids list too, or a few more; ids without any are left out.

    A bucket's counts go on packed, a row for each of so many ranges of ids,
    in which they are added up.
    """

    def meet(table: pa.Table) -> pa.Table:
        with np.errstate(over="ignore"):
            _, ids = _shared(table, 255)
        ids, counts = np.unique(ids, return_counts=True)
        at = ((ids >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
        ends = np.append(np.flatnonzero(at[1:] != at[:-1]) + 1, len(at)) if len(at) else np.zeros(0, np.int64)
        return pa.table({"range": pa.array(at[ends - 1], type=pa.int32()), "ids": _blobs(ids, 8, ends), "counts": _blobs(counts, 4, ends)})

    def add(table: pa.Table) -> pa.Table:
        ids, counts = (np.frombuffer(b"".join(v for chunk in table.column(c).chunks for v in chunk.to_pylist()), dtype=kind) for c, kind in (("ids", "<u8"), ("counts", "<u4")))
        ids, at = np.unique(ids, return_inverse=True)
        return pa.table({"id": ids.view(np.int64), "shared": np.bincount(at, counts, len(ids)).astype(np.int64)})

    packed = entries.groupBy("bucket").applyInArrow(meet, "range int, ids binary, counts binary")
    return packed.groupBy("range").applyInArrow(add, "id long, shared long")


def connected_components(edges: DataFrame, scratch: Scratch | None = None, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node that has an edge.

    ``edges`` has ``src`` and ``dst`` of one orderable type.  Alternates the
    large-star and small-star steps on the edge table; every round is a
    minimum, aggregated before its shuffle, and an equi-join whose large
    partitions Spark can split, written as a table.  Returns ``node,
    component`` (a component's smallest node maps to itself).
    """
    scratch = scratch or Scratch(edges.sparkSession)
    cur = scratch.keep(
        edges.where("src != dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    for _ in range(max_rounds):
        # settled: every node with a smaller neighbour has just one, which has none itself
        ends = cur.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(cur.select("v", F.lit(0), F.lit(1)))
        loose = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
        if loose.isEmpty():
            break
        both = cur.union(cur.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u != v")
            .distinct()
        )
        cur, old = scratch.keep(small), cur
        scratch.drop(old)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(found.select("component", "component").distinct())


ID_BUCKETS = 1 << 20


def near_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``df`` without most rows whose ``column`` is not among ``ids``, ahead of a join on it.

    Which of ``ID_BUCKETS`` hash values the ids have is broadcast: a million
    numbers at most, whatever the input.  Wide rows with another value are
    then not shuffled.  Past some millions of ids it drops little.
    """
    name = free_name(df, "_bucket")
    bucket = F.pmod(F.xxhash64(column), F.lit(ID_BUCKETS)).cast("int")
    some = ids.select(bucket.alias(name)).distinct()
    return df.withColumn(name, bucket).join(F.broadcast(some), name, "left_semi").drop(name)


PAIRS_PER_ROW = 2
FIRST_KEYS = 8  # the first stars are over one key in so many
LOW_KEYS = 16  # of an id, by which a pair that shares several keys mostly comes out for the least one alone


def bucket_components(scratch: Scratch, rows: DataFrame, sketches: DataFrame, close: str, verify, star_rounds: int = 8) -> DataFrame:
    """Components of the links that ``verify`` finds between ids that share a key.

    ``rows`` (a table of ``scratch``, which this deletes) has ``key, id`` of
    the keys that several ids list.  ``sketches`` has narrow columns for each
    ``id``, and ``close`` is an SQL condition on them, named ``a_`` and
    ``b_``, that every link meets: pairs that fail it are dropped inside the
    join.  ``verify`` takes ``src, dst`` and returns the pairs that are
    linked.  The result holds ``node, component`` of all ids with a link and
    equals that of verifying every candidate pair.

    Pairs within groups of copies are not formed.  First, a round of stars
    over a part of the keys tests each member of a key against one member
    drawn from it.  Members that have come into one component need no
    further test among themselves, so a large group of copies falls together
    in a linear round, and most keys are settled.  Further rounds of stars,
    over all keys, follow while the pairs are many times the rows and a
    round halves them.  What is left between different components is tested
    in full: a pair comes out for each key that it shares unless a lesser
    shared one is among the least ``LOW_KEYS`` of both, so never for none.
    """
    carry = [c for c in sketches.columns if c != "id"]

    def sketched(table: DataFrame, name: str, columns: dict[str, str]) -> DataFrame:
        wide = table.join(sketches, "id")
        return wide.select("key", *[F.col(c).alias(f"{name}_{n}") for c, n in columns.items()], *[F.col(c).alias(f"{name}_{c}") for c in carry])

    def linked(placed: DataFrame, stars: int | None) -> DataFrame:
        """Verified links between members of different components: with a member drawn by round, or of all pairs."""
        columns = {"id": "id", "comp": "comp"}
        if stars is None:
            low = placed.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LOW_KEYS).alias("low"))
            a = sketched(placed.join(low, "id"), "a", columns | {"low": "low"})
        else:
            a = sketched(placed, "a", columns)
        once = "true"
        if stars is None:
            once = "coalesce(array_min(array_intersect(a_low, b_low)), key) >= key"
            b = a.select("key", *[F.col(c).alias("b" + c[1:]) for c in a.columns if c != "key"])
        else:
            # the first round draws alike for all keys, so that pairs are few; later ones for each key, as not all members of a group may be linked
            draw = F.xxhash64("id", F.lit(stars), *(["key"] if stars else []))
            centre = placed.groupBy("key").agg(F.min(F.struct(draw.alias("draw"), "id", "comp")).alias("c"))
            b = sketched(centre.select("key", "c.id", "c.comp"), "b", columns)
        pairs = a.join(b, "key").where(f"a_comp {'<' if stars is None else '!='} b_comp and {close} and {once}")
        pairs = scratch.keep(pairs.select(F.least("a_id", "b_id").alias("src"), F.greatest("a_id", "b_id").alias("dst")).distinct())
        found = verify(pairs)
        scratch.drop(pairs)
        return found

    def merged(comp: DataFrame | None, found: DataFrame) -> DataFrame:
        # a component found before is a star: its rays stand for all its links
        return scratch.keep(connected_components(found if comp is None else comp.toDF("src", "dst").union(found), scratch))

    comp, before = None, None
    for stars in range(star_rounds + 1):
        if stars == 0:
            some = rows.where(F.pmod("key", F.lit(FIRST_KEYS)) == 0).withColumn("comp", F.col("id"))
            comp = merged(comp, linked(some, 0))
            continue
        placed = rows.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        # keys that lie within one component are settled
        mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        placed, old = scratch.keep(placed.join(mixed, "key", "left_semi")), rows
        scratch.drop(old)
        rows = placed.drop("comp")
        n, cross = (
            placed.groupBy("key", "comp").agg(F.count("*").cast("double").alias("n"))
            .groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"))
            .agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("nn")) / 2)).first()
        )
        if not n:
            break
        # no more stars once pairs are few or a round has not halved them
        last = cross <= PAIRS_PER_ROW * n or stars == star_rounds or before is not None and cross > before / 2
        before = cross
        comp = merged(comp, linked(placed, None if last else stars))
        if last:
            break
    return comp
