"""Exact top-k inner products over vectors, with a KD-tree for each shard.

Vectors are dealt to shards by the top splits of one tree.  A shard's task
builds a KD-tree by median splits on the widest side, with a tight box round
each node, and searches it best first: a box's bound is the largest inner
product that a point in it could have.  First each query searches the shard
that it lives in; its k-th score there is carried to those other shards
whose boxes have as high a bound, in which lower boxes are never opened.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.llm.common import checkpointed

SHARD_ROWS = 16_384
LEAST_SHARDS = 32  # as long as each has a leaf or two
LEAVES = 4_096  # at most, of the tree that deals rows to shards
SAMPLE = 16_384  # rows that it is fitted on
QUERY_BLOCK = 2_048
LEAF = 128
LONG = 9223372036854774784  # the largest double below 2**63


class KDTree:
    """Boxes, children and leaf ranges of one shard's points (int64 rows)."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.order = np.arange(len(points))
        low, high, self.left, self.span = [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            a, b, parent = todo.pop()
            node = len(low)
            if parent >= 0:
                self.left[parent].append(node)
            part = points[self.order[a:b]]
            low.append(part.min(axis=0)), high.append(part.max(axis=0))
            self.left.append([]), self.span.append((a, b))
            side = int(np.argmax(high[-1] - low[-1]))
            if b - a > leaf and high[-1][side] > low[-1][side]:
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(part[:, side], mid)]
                todo += [(a + mid, b, node), (a, a + mid, node)]
        self.low, self.high = np.array(low), np.array(high)
        self.sorted = points[self.order]
        self.peak = int(np.abs(points).max(initial=0))

    def search(self, query: np.ndarray, ids: np.ndarray, k: int, skip: int | None, floor: int | None) -> list[tuple[int, int]]:
        """The best ``k`` (score, id), ties to smaller ids, among scores of at least ``floor``."""
        low, high, points = self.low, self.high, self.sorted
        if self.peak * int(np.abs(query).max(initial=0)) * len(query) >= 1 << 62:
            # sums might not fit: count in Python's integers
            low, high, points, query = (x.astype(object) for x in (low, high, points, query))
        bounds = np.maximum(query * low, query * high).sum(axis=1).tolist()
        open_, best = [(-bounds[0], 0)], []  # best: a heap of (score, -id), worst on top
        while open_:
            bound, node = heapq.heappop(open_)
            worst = best[0][0] if len(best) == k else floor
            if worst is not None and -bound < worst:
                break
            if self.left[node]:
                for child in self.left[node]:
                    heapq.heappush(open_, (-bounds[child], child))
                continue
            a, b = self.span[node]
            scores = points[a:b] @ query
            if scores.dtype == object:
                scores = np.clip(scores, -(1 << 63), (1 << 63) - 1)
            at = np.arange(a, b) if worst is None else a + np.flatnonzero(scores >= worst)
            for i in at.tolist():
                name = int(ids[self.order[i]])
                if name == skip:
                    continue
                item = (int(scores[i - a]), -name)
                if len(best) < k:
                    if floor is None or item[0] >= floor:
                        heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(s, -n) for s, n in sorted(best, reverse=True)]


def scaled(vector: str, scale: int) -> str:
    """SQL for floor(scale * x) of each component as bigint; null if a component is null or not finite."""
    bad = f"{vector} is null or exists({vector}, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    # Spark's floor of a double is a long; a component beyond that is held to it
    held = f"greatest({-LONG}D, least({LONG}D, {scale}D * cast(x as double)))"
    return f"case when {bad} then null else transform({vector}, x -> cast(floor({held}) as bigint)) end"


class Dealer:
    """Median splits of a sample's points on their widest sides: which leaf a point falls to."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.splits: list[tuple[int, int, int, int]] = []  # side, cut, then nodes below and from the cut; a leaf n stands as -1 - n
        self.leaves = 0
        self.root = self._split(points, leaves)

    def _split(self, points: np.ndarray, leaves: int) -> int:
        if leaves > 1 and len(points) > 1:
            side = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
            values = np.sort(points[:, side])
            cut = int(values[len(values) // 2])
            below = points[:, side] < cut
            if below.any():
                node = len(self.splits)
                self.splits.append((side, cut, 0, 0))
                left, right = self._split(points[below], leaves // 2), self._split(points[~below], leaves - leaves // 2)
                self.splits[node] = side, cut, left, right
                return node
        self.leaves += 1
        return -self.leaves

    def leaf(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), dtype=np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -1 - node
                continue
            side, cut, left, right = self.splits[node]
            below = points[at, side] < cut
            todo += [(left, at[below]), (right, at[~below])]
        return out


def _matrix(vectors: list) -> np.ndarray:
    """Vectors of one length as rows; empty ones as one zero."""
    out = np.array(vectors, dtype=np.int64).reshape(len(vectors), -1)
    return out if out.shape[1] else np.zeros((len(vectors), 1), dtype=np.int64)


def _by_length(pdf: pd.DataFrame):
    """For each length of vectors: it, the rows' places and their matrix."""
    for dim, at in pdf.groupby("dim").indices.items():
        yield int(dim), at, _matrix([pdf["v"].iloc[i] for i in at])


def _dealt(rows: DataFrame, dealers: dict[int, Dealer]) -> DataFrame:
    """``rows`` with the leaf of each."""
    sent = rows.sparkSession.sparkContext.broadcast(dealers)

    def deal(batches):
        for pdf in batches:
            leaf = np.zeros(len(pdf), dtype=np.int32)
            for dim, at, points in _by_length(pdf):
                if dim in sent.value:
                    leaf[at] = sent.value[dim].leaf(points)
            yield pdf.assign(leaf=leaf)

    return rows.mapInPandas(deal, "id long, v array<long>, dim int, row long, leaf int")


def _boxes(dealt: DataFrame, dims: list[int]) -> dict[int, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Lows and highs of each leaf of these lengths: two vectors a leaf, gathered from as many a task."""

    def bound(batches):
        held: dict = {}
        for pdf in batches:
            for dim, at, points in _by_length(pdf):
                leaves = pdf["leaf"].to_numpy()[at]
                for leaf in np.unique(leaves).tolist():
                    part = points[leaves == leaf]
                    low, high = held.get((dim, leaf), (part[0], part[0]))
                    held[dim, leaf] = np.minimum(low, part.min(axis=0)), np.maximum(high, part.max(axis=0))
        yield pd.DataFrame([(d, f, lo.tolist(), hi.tolist()) for (d, f), (lo, hi) in held.items()], columns=["dim", "leaf", "low", "high"])

    parts = dealt.where(F.col("dim").isin(dims)).select("dim", "leaf", "v").mapInPandas(bound, "dim int, leaf int, low array<long>, high array<long>")
    each = parts.select("dim", "leaf", F.posexplode(F.arrays_zip("low", "high")).alias("i", "e")).groupBy("dim", "leaf", "i").agg(F.min("e.low").alias("low"), F.max("e.high").alias("high"))
    out: dict = {}
    for r in each.groupBy("dim", "leaf").agg(F.sort_array(F.collect_list(F.struct("i", "low", "high"))).alias("box")).collect():
        out.setdefault(r["dim"], {})[r["leaf"]] = np.array([b["low"] for b in r["box"]], dtype=np.int64), np.array([b["high"] for b in r["box"]], dtype=np.int64)
    return out


def _reached(asked: DataFrame, boxes: dict) -> DataFrame:
    """``id, dim, leaf, floor``: the leaves whose boxes may hold a score of at least a query's floor, by its length's boxes."""
    sent = asked.sparkSession.sparkContext.broadcast(boxes)

    def reach(batches):
        for pdf in batches:
            out = []
            for dim, at, points in _by_length(pdf):
                held = sent.value.get(dim)
                leaves = sorted(held) if held else [0]
                floors = [pdf["floor"].iloc[i] for i in at]
                if not held:
                    out += [(int(pdf["id"].iloc[i]), dim, 0, floor) for i, floor in zip(at, floors)]
                    continue
                low, high = (np.array([held[f][j] for f in leaves], dtype=np.float64) for j in (0, 1))
                for i, q, floor in zip(at, points.astype(np.float64), floors):
                    bound = np.maximum(q * low, q * high).sum(axis=1)
                    slack = np.maximum(np.abs(q * low), np.abs(q * high)).sum(axis=1) * 1e-12 + 1  # of sums in doubles
                    near = np.ones(len(leaves), dtype=bool) if floor is None or floor != floor else bound + slack >= float(floor)
                    out += [(int(pdf["id"].iloc[i]), dim, leaves[j], floor) for j in np.flatnonzero(near).tolist()]
            yield pd.DataFrame(out, columns=["id", "dim", "leaf", "floor"])

    return asked.select("id", "dim", "v", "floor").mapInPandas(reach, "id long, dim int, leaf int, floor string")


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each query the ``k`` rows of highest score: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are
    all rows with another id.  Scores are inner products of components
    floor(scale * x); ties go to the smaller id.  Null vectors, ids, and
    vectors with null or non-finite components take no part; vectors meet
    only vectors of their own length; empty ones score 0.  Rows that repeat
    an id are candidates each, but not of their own id, and ask once.  Sums
    are exact integers; a scaled component or a score beyond a long is held
    to it.  Other columns are not read, whatever their names; an empty table
    gives an empty one.

    Rows are dealt to the leaves of a tree of at most ``LEAVES``, whose
    splits are medians of ``SAMPLE`` rows; leaves of many rows are dealt on
    to shards by hash.  The sample decides where rows go, not what is found.
    A query searches its own shard, then the shards of those leaves whose
    box may hold a score as good as its k-th one there.  A task holds one
    shard and one block of queries, both of bounded size, and a shard is
    sent out as often as it has blocks of queries that reach it.
    """
    rows = vectors.selectExpr(f"`{id_col}` as id", f"{scaled(f'`{vector_col}`', scale)} as v").where("id is not null and v is not null").withColumn("dim", F.size("v"))
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    leaves = min(LEAVES, max(1, -(-n // SHARD_ROWS), min(LEAST_SHARDS, -(-n // (2 * LEAF)))))
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("dim", "v").toPandas()
    dealers = {dim: Dealer(points, max(1, leaves * len(points) // max(len(sample), 1))) for dim, _, points in _by_length(sample)} if len(sample) else {}
    dealt = checkpointed(_dealt(rows, dealers))
    boxes = _boxes(dealt, sorted(dealers))
    parts = checkpointed(dealt.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("int").alias("parts")))
    # rows that repeat a vector are spread too
    dealt = dealt.join(parts, ["dim", "leaf"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    queries = checkpointed(dealt.where(F.col("id") % every == 0).select("dim", "leaf", "part", "id", "v").dropDuplicates(["id"]))
    spec = "query_id long, vec_id long, score long"
    by = ["dim", "leaf", "part", "block"]

    def search(key, points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(points) and len(asked):
            points = points.sort_values("id", kind="stable")
            ids = points["id"].to_numpy()
            tree = KDTree(_matrix(points["v"].tolist()))
            for name, q, floor in zip(asked["q_id"].tolist(), _matrix(asked["q_v"].tolist()), asked["q_floor"].tolist()):
                out += [(name, i, s) for s, i in tree.search(q, ids, k, name, None if floor is None or floor != floor else int(floor))]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    def run(asked: DataFrame) -> DataFrame:
        """Searches of ``dim, leaf, part, id, v, floor``, in blocks of queries for each shard."""
        blocks = asked.groupBy("dim", "leaf", "part").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        points = dealt.join(blocks, ["dim", "leaf", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*by, "id", "v")
        asked = asked.join(blocks, ["dim", "leaf", "part"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int"))
        # fresh names: both sides descend from the same rows
        asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in (*by, "id", "v", "floor")])
        return points.groupBy(*by).cogroup(asked.groupBy(*[f"q_{c}" for c in by])).applyInPandas(search, spec)

    home = checkpointed(run(queries.withColumn("floor", F.lit(None).cast("string"))))
    bound = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(f"n >= {k}")
    floors = queries.join(bound.withColumnRenamed("query_id", "id"), "id", "left").withColumn("floor", F.col("least").cast("string"))
    reached = checkpointed(_reached(floors, boxes).join(parts, ["dim", "leaf"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))
    own = queries.select("id", "leaf", "part")
    away = reached.join(own, ["id", "leaf", "part"], "left_anti").join(queries.select("id", "v"), "id")
    found = home.union(run(away))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
