"""Merkle manifest of a table: leaf digests, roots, and a proof for each row.

Rows of a group, in order of their key, are the leaves of the group's tree,
in which a node is the digest of up to ``FAN`` nodes.  Groups' roots, in
order of the group, are the leaves of one more tree.

A tree is cut into aligned blocks of ``FAN ** BLOCK_LEVELS`` nodes, a task's
work each; blocks' roots are cut into blocks again until a group has one
node.  Proofs then come from above: a block is traversed with its own upper
proof in hand.  The traversal is fractal: of the block's subtrees, stacked
``STACK_LEVELS`` high, it holds the ones on the way to the leaf in turn and
the next ones, which grow by a leaf a step and take their place when the
leaf leaves the old ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from phenogrid.llm.common import Scratch

FAN, BLOCK_LEVELS, STACK_LEVELS = 8, 4, 2
BLOCK = FAN**BLOCK_LEVELS
PATH = "array<struct<before: string, after: string>>"
PATH_TYPE = ArrayType(StructType().add("before", "string").add("after", "string"))
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def digest(nodes: bytes) -> bytes:
    return hashlib.sha256(nodes).hexdigest().encode()


def leaf(values: Sequence[str]) -> Column:
    """Hex SHA-256 of SQL values end to end, each as its UTF-8 byte count, a colon and itself, or ``-`` for null."""
    texts = [f"cast({v} as string)" for v in values]
    return F.expr(f"sha2(concat({', '.join(f"coalesce(concat(octet_length({t}), ':', {t}), '-')" for t in texts)}), 256)")


def folded(leaf_sql: str, path_sql: str) -> Column:
    """The root that a leaf has under the siblings of a path."""
    return F.expr(f"aggregate({path_sql}, {leaf_sql}, (node, run) -> sha2(concat(run.before, node, run.after), 256))")


def proof_digest(path_sql: str) -> Column:
    """Hex SHA-256 of a path's siblings, level by level from below, left to right."""
    return F.expr(f"sha2(array_join(transform({path_sql}, run -> concat(run.before, run.after)), ''), 256)")


class Subtree:
    """Levels ``low`` to ``high`` - 1 under one node of level ``high``, which grow as the node's leaves come."""

    def __init__(self, low: int, high: int, leaves: int):
        self.low, self.high, self.missing = low, high, leaves
        self.open: list[list[bytes]] = [[] for _ in range(high)]
        self.runs: list[list[bytes]] = [[] for _ in range(high - low)]
        self.root = b""

    def feed(self, node: bytes) -> None:
        self.missing -= 1
        for level in range(self.high):
            run = self.open[level]
            run.append(node)
            if len(run) < FAN and self.missing:
                return
            nodes = b"".join(run)
            run.clear()
            if level >= self.low:
                self.runs[level - self.low].append(nodes)
            node = digest(nodes)
        self.root = node


def height(size: int) -> int:
    """Levels above the nodes of a block, where its tree has ``size`` nodes at their level."""
    levels = 0
    while levels < BLOCK_LEVELS and FAN**levels < size:
        levels += 1
    return levels


def paths(leaves: Sequence[bytes], levels: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """For each leaf of a block in turn, what stands before and after its node in its run, from the lowest level up."""
    n = len(leaves)
    stack = [(low, min(low + STACK_LEVELS, levels)) for low in range(0, levels, STACK_LEVELS)]
    spans = [FAN**high for _, high in stack]

    def planted(s: int, at: int) -> Subtree | None:
        return Subtree(*stack[s], min(spans[s], n - at * spans[s])) if at * spans[s] < n else None

    here = [planted(s, 0) for s in range(len(stack))]
    ahead = [planted(s, 1) for s in range(len(stack))]
    for tree in here:
        for i in range(tree.missing):
            tree.feed(leaves[i])
    for i in range(n):
        path = []
        for s, (low, high) in enumerate(stack):
            at, inside = divmod(i, spans[s])
            if i and not inside:
                here[s], ahead[s] = ahead[s], planted(s, at + 1)
            for level in range(low, high):
                place = inside // FAN**level
                run, place = here[s].runs[level - low][place // FAN], 64 * (place % FAN)
                path.append((run[:place], run[place + 64 :]))
            if ahead[s] and ahead[s].missing:
                ahead[s].feed(leaves[(at + 1) * spans[s] + inside])
        yield path


def _ordered(table: pa.Table) -> tuple[pa.Table, list[bytes], int]:
    """A block in order, its nodes as hex text, and its levels."""
    table = table.sort_by("pos")
    return table, [v.hex().encode() for v in table.column("hash").to_pylist()], height(table.column("size")[0].as_py())


def _roots(nodes: DataFrame) -> DataFrame:
    """The roots of the blocks of ``g, pos, size, hash``, as nodes of the next tier."""

    def climb(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, hexes, levels = _ordered(table)
        tree = Subtree(levels, levels, len(hexes))
        for node in hexes:
            tree.feed(node)
        size = -(-table.column("size")[0].as_py() // BLOCK)
        return pa.table({"g": [key[0].as_py()], "pos": [key[1].as_py()], "size": [size], "hash": [bytes.fromhex(tree.root.decode())]}, schema=pa.schema([("g", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("hash", pa.binary())]))

    return nodes.select("g", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "size", "hash").groupBy("g", "block").applyInArrow(climb, "g string, pos long, size long, hash binary")


def _tiers(nodes: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """``nodes``, their blocks' roots, these blocks' roots, and so on, until every group has one node."""
    tiers = [nodes]
    while not tiers[-1].where("size > 1").isEmpty():
        tiers.append(scratch.keep(_roots(tiers[-1])))
    return tiers


def _descended(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` with their paths up to the root: ``above`` has ``g, pos, path, subroot, root`` of their blocks."""
    schema = nodes.schema
    names = ["g", "block", *[c for c in nodes.columns if c != "g"]]

    def descend(key: tuple[pa.Scalar, ...], table: pa.Table, tops: pa.Table) -> pa.Table:
        table, hexes, levels = _ordered(table)
        upper = [(p["before"], p["after"]) for p in tops.column("path")[0].as_py()]
        made = [[*((b.decode(), a.decode()) for b, a in path), *upper] for path in paths(hexes, levels)] if levels else [upper] * len(hexes)
        flat = [run for path in made for run in path]
        runs = pa.StructArray.from_arrays([pa.array([r[i] for r in flat], type=pa.string()) for i in (0, 1)], names=["before", "after"])
        ends = [0]
        for path in made:
            ends.append(ends[-1] + len(path))
        same = {c: pa.array([tops.column(c)[0].as_py()] * len(hexes), type=pa.string()) for c in ("subroot", "root")}
        return pa.table([*[table.column(c) for c in schema.names], pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), runs), *same.values()], names=[*schema.names, "path", *same])

    left = nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).select(*names).groupBy("g", "block")
    right = above.select("g", "pos", "path", "subroot", "root").groupBy("g", "pos")
    return left.cogroup(right).applyInArrow(descend, StructType([*schema.fields]).add("path", PATH_TYPE).add("subroot", "string").add("root", "string"))


def _placed(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with ``pos``, the place among those of equal ``g`` by ``order``, and ``size``, how many these are.

    Rows are sorted in ranges of (g, order); a range's rows of a group follow
    those of the ranges before, so that no task holds a group.
    """
    ranged = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    ranged = scratch.keep(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    counts = ranged.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("at").alias("low"))
    group = Window.partitionBy("g")
    before = counts.withColumn("before", F.sum("n").over(group.orderBy("part")) - F.col("n")).withColumn("size", F.sum("n").over(group)).drop("n")
    return ranged.join(before, ["g", "part"]).withColumn("pos", F.col("at") - F.col("low") + F.col("before")).drop("part", "at", "low", "before")


def manifest(rows: DataFrame, key: str, group: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``carry``, ``leaf``, ``subroot``, ``root`` and ``path`` of every row of ``rows``, whose ``leaf`` is a hex digest.

    A path holds, for each level from the lowest, the siblings before and
    after the row's node: ``folded`` of leaf and path gives the root.  A tree
    of one leaf is that leaf.  Keys that are null come first in their group;
    equal keys go by leaf, and equal leaves are a leaf each.  The null group
    comes before all others, which go by their UTF-8 bytes.  Other columns
    are not read, whatever their names; an empty table gives an empty one.
    """
    scratch = Scratch(rows.sparkSession)
    named = rows.select(F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("g"), F.col(key).alias("key"), F.unhex("leaf").alias("hash"), *[F.col(c).alias(f"with_{c}") for c in carry])
    leaves = scratch.keep(_placed(named, ["key", "hash"], scratch))
    tiers = _tiers(leaves.select("g", "pos", "size", "hash"), scratch)
    groups = scratch.keep(_placed(tiers[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "hash"), ["name"], scratch))
    upper = _tiers(groups, scratch)
    above = upper[-1].select("g", "pos", F.expr(f"cast(array() as {PATH})").alias("path"), F.lit("").alias("subroot"), F.lower(F.hex("hash")).alias("root"))
    for tier in reversed(upper[:-1]):
        above = scratch.keep(_descended(tier, above))
    names = groups.select("pos", "name", F.lower(F.hex("hash")).alias("of"))
    above = above.select("pos", "path", "root").join(names, "pos").select(F.col("name").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.col("of").alias("subroot"), "root")
    for tier in reversed(tiers[1:-1]):
        above = scratch.keep(_descended(tier, above))
    out = _descended(leaves, above) if len(tiers) > 1 else leaves.join(above.drop("pos"), "g")
    return out.select(F.col("key").alias(key), *[F.col(f"with_{c}").alias(c) for c in carry], F.lower(F.hex("hash")).alias("leaf"), "subroot", "root", "path")
