"""Readers."""

from __future__ import annotations

import os
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OCCURRENCE_SCHEMA = "latitude double, longitude double, taxonKey bigint, verbatimScientificName string, commonName string, week int, class string"


def unpack_member(spark: SparkSession, archive: str, folder: str, member: str | None = None) -> str:
    """Unpacks one member of a zip archive into ``folder``, once, and returns its path.

    Both may be in any store that Spark reads; the bytes pass from stream to
    stream and are never held.  A zip member cannot be read in parts, an
    unpacked file can, so every later scan is parallel.  Without a name the
    largest member is taken.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source = jvm.org.apache.hadoop.fs.Path(archive)
    store = source.getFileSystem(conf)

    def members():
        stream = jvm.java.util.zip.ZipInputStream(store.open(source))
        try:
            while (entry := stream.getNextEntry()) is not None:
                yield stream, entry
        finally:
            stream.close()

    if member is None:
        sizes = {}
        for stream, entry in members():
            stream.closeEntry()  # reads on to its end, where the size stands
            sizes[entry.getName()] = entry.getSize()
        member = max(sizes, key=lambda n: (sizes[n], n))
    target = jvm.org.apache.hadoop.fs.Path(folder, os.path.basename(member))
    out = target.getFileSystem(conf)
    if not out.exists(target):
        part = jvm.org.apache.hadoop.fs.Path(folder, os.path.basename(member) + ".part")
        for stream, entry in members():
            if entry.getName() == member:
                sink = out.create(part, True)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, sink, 1 << 20, False)
                sink.close()
                break
        else:
            raise FileNotFoundError(f"{archive} has no member {member}")
        out.rename(part, target)
    return target.toString()


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Columns of a tab-separated file as text.  Long rows are cut, short ones end in nulls; neither is dropped."""
    header = spark.read.text(path).limit(1).first()[0].split("\t")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.csv(path, sep="\t", header=True, schema=schema, mode="PERMISSIVE", quote="", enforceSchema=True).select(*columns)


def parse_tsv(lines: DataFrame, header: list[str], columns: list[str], line: str = "value") -> DataFrame:
    """The same for lines that are already in a column."""
    parts = F.split(line, "\t")
    return lines.select(*[F.get(parts, header.index(c)).alias(c) for c in columns])


def read_occurrences(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Processed occurrence CSV, gzipped or not.  A gzipped file is one task, so its rows are dealt out after."""
    df = spark.read.csv(path, header=True, schema=OCCURRENCE_SCHEMA)
    if path.endswith(".gz"):
        df = df.repartition(spark.sparkContext.defaultParallelism)
    return df.select(*(columns or df.columns))


def read_parts(spark: SparkSession, folder: str, pattern: str = "grid_*_chunk_*.parquet") -> DataFrame:
    """All readable part files of a folder under one schema, missing columns as null."""
    return spark.read.option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True).option("mergeSchema", True).option("recursiveFileLookup", True).parquet(folder)


def parts_report(spark: SparkSession, folder: str, pattern: str = "grid_*_chunk_*.parquet") -> DataFrame:
    """``file, n_rows, skipped`` of every part file of a folder: what ``read_parts`` takes from it.

    A file that cannot be read, or holds no rows, is skipped.  The listing
    reads no content; rows are counted from the files' footers.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    files = listed.select(F.element_at(F.split("path", "/"), -1).alias("file"))
    rows = read_parts(spark, folder, pattern).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n_rows"))
    return files.join(rows, "file", "left").select("file", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"), F.col("n_rows").isNull().alias("skipped"))


def read_blocks(spark: SparkSession, folder: str, most: int, pattern: str = "*.parquet") -> tuple[DataFrame, int]:
    """Rows of the first part files that together hold ``most`` rows or more, and how many files were looked at.

    Files are blocks, in the order of their names.  The block in which the
    limit falls is taken whole, later ones are not.  Blocks are counted one,
    two, four, ... at a time, so that few of those beyond are looked at, and
    a late end takes few rounds.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted(f.getPath().toString() for f in store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(at, pattern)))
    schema = spark.read.parquet(files[0]).schema
    held, low, step = 0, 0, 1
    while low < len(files):
        group = files[low : low + step]
        counts = {r["file"]: r["n"] for r in spark.read.schema(schema).parquet(*group).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n")).collect()}
        for i, f in enumerate(group):
            held += counts.get(os.path.basename(f), 0)
            if held >= most:
                return spark.read.schema(schema).parquet(*files[: low + i + 1]), low + len(group)
        low, step = low + len(group), 2 * step
    return spark.read.schema(schema).parquet(*files), len(files)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Taxonomy CSV with its ``common_name_*`` columns gathered in a map."""
    df = spark.read.csv(path, header=True)
    local = [c for c in df.columns if c.startswith("common_name_")]
    pairs = [x for c in local for x in (F.lit(c.removeprefix("common_name_")), F.col(c))]
    names = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if local else F.create_map().cast("map<string,string>")
    return df.select(*[c for c in df.columns if c not in local], names.alias("locale_names"))


def label_fields(line: Column) -> list[Column]:
    """Code, scientific and common name of a label line of one to three fields."""
    parts = F.split(line, "\t")
    sci = F.coalesce(F.get(parts, 1), F.get(parts, 0))
    return [F.get(parts, 0).alias("code"), sci.alias("sci"), F.coalesce(F.get(parts, 2), sci).alias("com")]


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label file: line number as index, then the fields.  The file is as long as the model's vocabulary."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("idx", "line"))
    return lines.select("idx", *label_fields(F.col("line")))


def _wkb_rings(blob: bytes, at: int = 0) -> tuple[list, int]:
    """Rings of the polygons in a WKB shape from ``at``, and where it ends; a point or line is one ring of its vertices."""
    order = "<" if blob[at] == 1 else ">"
    kind = struct.unpack_from(order + "I", blob, at + 1)[0]
    at += 5

    def vertices(n: int, at: int) -> list:
        xy = struct.unpack_from(order + f"{2 * n}d", blob, at)
        return [{"lon": x, "lat": y} for x, y in zip(xy[::2], xy[1::2])]

    if kind == 1:
        return [vertices(1, at)], at + 16
    count = struct.unpack_from(order + "I", blob, at)[0]
    at, rings = at + 4, []
    if kind == 2:
        return [vertices(count, at)], at + 16 * count
    for _ in range(count):
        if kind == 3:
            n = struct.unpack_from(order + "I", blob, at)[0]
            rings.append(vertices(n, at + 4))
            at += 4 + 16 * n
        elif kind in (4, 5, 6, 7):
            more, at = _wkb_rings(blob, at)
            rings += more
        else:
            raise ValueError(f"WKB of kind {kind}")
    return rings, at


def parse_wkb(df: DataFrame, column: str, out: str = "ring", rings: str | None = None) -> DataFrame:
    """Adds the first ring (array of lon, lat) of WKB shapes, and all of them as ``rings`` if that is named.

    Points, lines, polygons with holes, and collections of them; null for
    null and for bytes that are none of these.
    """
    def decode_one(blob) -> list | None:
        try:
            return _wkb_rings(bytes(blob))[0] or None
        except (TypeError, IndexError, ValueError, struct.error):
            return None

    @F.pandas_udf("array<array<struct<lon:double,lat:double>>>")
    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(decode_one)

    every = df.withColumn("_rings", decode(column)).withColumn(out, F.get("_rings", F.lit(0)))
    return (every.withColumn(rings, F.col("_rings")) if rings else every).drop("_rings")
