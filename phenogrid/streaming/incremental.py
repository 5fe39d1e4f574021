"""Presence kept up to date from a stream of occurrence files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.functions.calendar import WEEKS

KEYS = ("cell", "week", "species")


def new_presence(stream: DataFrame) -> DataFrame:
    """Distinct (cell, week, species) as they first appear; the state holds only the keys."""
    return stream.where(F.col("week").between(1, WEEKS)).select(*KEYS).dropDuplicates(list(KEYS))


def weekly_counts(stream: DataFrame, time: str, late: str, width: str) -> DataFrame:
    """Counts per event-time window and type; rows later than ``late`` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def read_presence_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def write_presence(stream: DataFrame, table: str, checkpoint: str, once: bool = True):
    """Appends new presence rows to a Parquet folder, exactly once by the sink's log.

    The keys seen so far are the stream's state, on the executors' disks and
    in the checkpoint; a query that starts again from there repeats and
    loses nothing.  ``once``: end when all files there are have been read.
    """
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ON_DISK)
    try:
        writer = new_presence(stream).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="0 seconds")).start()
    finally:
        spark.conf.set(STATE_STORE, before)
