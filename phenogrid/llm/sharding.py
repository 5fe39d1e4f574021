"""Rendezvous sharding with DataFrame expressions only.

Each record key is hashed once with every shard; the shard with the highest
weighted score takes the record.  A key's scores with the old shards stay
when a shard is added, so only the records that the new one wins move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.llm.common import checkpointed

ROWS_PER_BUCKET = 4096


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard that wins ``key``; a shard of twice the weight wins twice the keys.

    Score: -weight / ln(u) with u from the key's and the shard's hash.  Equal
    scores go to the lower shard.  A null key is a key like any other.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])

    def score(i: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit("shard"), key, i), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.element_at(w, i + 1) / F.ln(u)).alias("s"), (-i).alias("i"))

    return -F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), score))["i"]


def shard(docs: DataFrame, weights: list[float], grown_weight: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places every row by its id: size, checksum, shard, gapless slot, grown shard.

    ``size`` is the text's UTF-8 bytes plus 16 (null text: 16, checksum 0).
    Slots count a shard's rows from 0.  They come from two steps, so no task
    holds a shard: rows are numbered within hashed buckets of a shard, and
    buckets get the running total of those before them.  Rows that share an
    id share a shard; rows alike in everything get different slots.  Rows
    move only as narrow tuples, without their texts, which may be of any
    length.  A shard's bucket counts, one number for ``ROWS_PER_BUCKET`` rows,
    are summed in one task.  Other columns are not read, whatever their
    names; an empty table gives an empty one.
    """
    n = len(weights)
    narrow = docs.select(
        docs[id_col].alias("doc_id"),
        (F.coalesce(F.octet_length(docs[text_col]), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(docs[text_col], F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    grown = [*weights, weights[-1] if grown_weight is None else grown_weight]
    placed = narrow.withColumn("shard", rendezvous(F.col("doc_id"), weights)).withColumn("grown_shard", rendezvous(F.col("doc_id"), grown))
    placed = checkpointed(placed.withColumn("part", F.spark_partition_id()))
    buckets = max(1, placed.count() // (n * ROWS_PER_BUCKET) + 1)
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "part"), F.lit(buckets)))
    sizes = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = sizes.selectExpr("shard", "bucket", "sum(n) over (partition by shard order by bucket) - n as before")
    numbered = placed.selectExpr("*", "row_number() over (partition by shard, bucket order by doc_id, text_crc32, size) - 1 as i")
    return numbered.join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.col("shard").cast("int"), (F.col("before") + F.col("i")).cast("long").alias("slot"), F.col("grown_shard").cast("int"))
