"""Tables that are worked out once, and rows dealt to tasks of a bounded size."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing: list[list[str]] = []  # the folders of tables that go with the blocks they are stored in


def _shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, lasting: bool = False) -> DataFrame:
    """``df`` written once, as Parquet in the folder in ``spark.checkpoint.dir``; where none is named, in a temporary one in local mode only.

    The shuffle files behind it go as soon as it is written.  Tables stored
    within ``passing`` go at its end, but for ``lasting`` ones.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    if _passing and not lasting:
        _passing[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession):
    """What is stored inside is deleted at the end; only what was stored as lasting may be used then."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in partitions of about so many rows, however few files it is read from; counts them first."""
    return df.repartition(max(1, -(-df.count() // rows)))
