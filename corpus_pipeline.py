"""A pipeline that prepares documents for training.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's docs.  All but the last keep the columns of
``documents``; extra columns pass, whatever their names.  Null and empty
texts go in the first stage, repeated rows and rows with a null id are taken
as each stage says, texts may be of any length, and an empty table gives an
empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.llm import language, lines, mixing, ngram_join, packing
from phenogrid.llm.common import ensure_checkpoint_dir, free_name

ROWS_PER_BATCH = 1000


def narrow_batches(spark: SparkSession) -> None:
    """Hands Python workers fewer rows at a time than Spark's 10,000, as documents are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty ones too); a low score, as short clean texts have, drops none."""
    narrow_batches(spark)
    model = language.train(docs, key=F.col("doc_id"))
    names = free_name(docs, "_lang_pred"), free_name(docs, "_lang_score")
    return language.predict(docs, model, docs.columns, names=names).where(F.col(names[0]) != "und").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out repeated lines; drops documents that have no others, or no words at all."""
    narrow_batches(spark)
    kept = lines.dedup_lines(docs).where(F.col("text").rlike(r"[A-Za-z0-9]|[^\x00-\x7F]"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near copies; rows with a null id stay."""
    narrow_batches(spark)
    groups = ngram_join.jaccard_groups(docs, width=5, percent=80).where("doc_id != component_id").select("doc_id")
    return docs.join(groups, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, up to half of them once more; none is lost.

    A null source is a source, and rows with a null id stay; rows that share
    an id are repeated alike.
    """
    key, epochs, copy = (free_name(docs, n) for n in ("_id", "_epochs", "_copy"))
    mixed = mixing.mix(docs, max_repeats=1.5).groupBy(F.col("doc_id").alias(key)).agg(F.max("epoch").alias(epochs))
    chosen = docs.join(mixed, docs["doc_id"].eqNullSafe(mixed[key])).withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(epochs))))
    return chosen.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the token pieces of all documents in sequences of 1024 tokens."""
    narrow_batches(spark)
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("language", detect_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language profiles, edit distances over runs and tokens are not to be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each over the Parquet files of the one before, which then go."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        before = name
    return docs
