"""Writers."""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.functions import geo
from phenogrid.operators.repair import repaired, signed_area
from phenogrid.sources.readers import OCCURRENCE_SCHEMA


def write_occurrences(df: DataFrame, path: str, gzip: bool = True) -> None:
    columns = [c.split()[0] for c in OCCURRENCE_SCHEMA.split(", ")]
    df.select(*columns).write.mode("overwrite").csv(path, header=True, compression="gzip" if gzip else "none")


def valid_cells(cells: DataFrame, ring: str = "ring") -> DataFrame:
    """Cells whose ring is there, within the globe and no wider than half of it."""
    b = geo.ring_bounds(F.col(ring))
    inside = (b["lon_min"] >= -180) & (b["lon_max"] <= 180) & (b["lat_min"] >= -90) & (b["lat_max"] <= 90)
    return cells.where((F.size(ring) >= 4) & inside & (geo.ring_span(F.col(ring)) <= 180))


def _polygons(rings: list) -> list[list]:
    """Outer rings, each followed by its holes: those that lie in it and in no smaller one."""
    shapes = [[r] for r in rings if signed_area(r) > 0]
    for hole in (r for r in rings if signed_area(r) <= 0):
        (ax, ay), (bx, by) = hole[:2]
        # a place just inside the hole, to the right of its first side
        x, y = (ax + bx) / 2 + (by - ay) * 1e-6, (ay + by) / 2 - (bx - ax) * 1e-6
        around = [s for s in shapes if sum((p[1] <= y) != (q[1] <= y) and x < p[0] + (y - p[1]) / (q[1] - p[1]) * (q[0] - p[0]) for p, q in zip(s[0], s[0][1:])) % 2]
        min(around or shapes, key=lambda s: signed_area(s[0])).append(hole)
    return shapes


def rings_wkb(rings: str) -> Column:
    """Rings (outer ones counter-clockwise, holes clockwise) as the WKB of a polygon, or of several."""
    def polygon(shape: list) -> bytes:
        return struct.pack("<BII", 1, 3, len(shape)) + b"".join(struct.pack(f"<I{2 * len(r)}d", len(r), *[v for p in r for v in p]) for r in shape)

    def encode(found) -> bytes | None:
        if found is None or not len(found):
            return None
        shapes = _polygons([[(p["lon"], p["lat"]) for p in r] for r in found])
        return polygon(shapes[0]) if len(shapes) == 1 else struct.pack("<BII", 1, 6, len(shapes)) + b"".join(map(polygon, shapes))

    @F.pandas_udf("binary")
    def encoded(column: pd.Series) -> pd.Series:
        return column.map(encode)

    return encoded(rings)


def write_cells(cells: DataFrame, path: str, rows_per_file: int = 500) -> None:
    """Cells as Parquet with their repaired rings as WKB ``geometry``, in files of bounded size.

    A ring that crosses itself is written as the polygons that it winds
    round; cells without area, off the globe or wider than half of it are
    left out.
    """
    sound = valid_cells(cells).withColumn("_rings", repaired("ring")).withColumn("geometry", rings_wkb("_rings")).drop("_rings")
    sound.where("geometry is not null").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_taxonomy(taxonomy: DataFrame, path: str) -> None:
    taxonomy.select("species_code", "taxonKey", "sci_name", "com_name", "class_name").write.mode("overwrite").csv(path, header=True)


def write_labels(labels: DataFrame, path: str) -> None:
    """Label lines in index order, in one file: the vocabulary is small and order is its meaning."""
    lines = labels.orderBy("idx").select(F.concat_ws("\t", "code", "sci", "com").alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_species_list(species: DataFrame, path: str) -> None:
    """One line for each row: rank, code and name, in order of rank.  A list for reading, so one file."""
    lines = species.orderBy("rank").select(F.concat_ws("\t", F.col("rank").cast("string"), "code", "com").alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_history(history: DataFrame, path: str) -> None:
    history.write.mode("overwrite").json(path)


def write_chunks(df: DataFrame, folder: str, chunk: str, name: str = "grid_5km_chunk_{:04d}.parquet") -> list[str]:
    """Rows of each number in the column ``chunk`` as one part file; returns the files' names in order.

    A chunk is to be of bounded size, as it is written by one task.
    """
    spark = df.sparkSession
    draft = f"{folder}/_draft-{uuid.uuid4().hex}"
    df.withColumn("_chunk", F.col(chunk)).drop(chunk).repartition("_chunk").write.partitionBy("_chunk").parquet(draft)
    place = spark._jvm.org.apache.hadoop.fs.Path
    store = place(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = []
    for f in store.globStatus(place(f"{draft}/_chunk=*/part-*")):
        names.append(name.format(int(f.getPath().getParent().getName().partition("=")[2])))
        store.rename(f.getPath(), place(folder, names[-1]))
    store.delete(place(draft), True)
    return sorted(names)


def _files_under(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, length and time of change of all files under a path, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        raise FileNotFoundError(path)
    files, found = store.listFiles(at, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def cache_key(spark: SparkSession, inputs: list[str], parameters: dict) -> str:
    """Name for prepared data: the input files' identity and every parameter, hashed."""
    identity = [_files_under(spark, path) for path in sorted(inputs)]
    return hashlib.sha256(json.dumps([identity, parameters], sort_keys=True, default=str).encode()).hexdigest()[:16]


def read_through(spark: SparkSession, folder: str, inputs: list[str], parameters: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` makes of the inputs, from ``folder`` if it was kept there for equal files and parameters.

    Otherwise it is built, written beside and moved into place as a whole; of
    two that build the same at a time, the first to end is kept.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path
    kept = f"{folder}/prepared-{cache_key(spark, inputs, parameters)}"
    store = place(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place(f"{kept}/_SUCCESS")):
        draft = f"{folder}/_draft-{uuid.uuid4().hex}"
        build().write.parquet(draft)
        if store.exists(place(f"{kept}/_SUCCESS")) or not store.rename(place(draft), place(kept)):
            store.delete(place(draft), True)
        else:
            store.delete(place(f"{kept}/{draft.rpartition('/')[2]}"), True)  # a rename onto a folder moves into it
    return spark.read.parquet(kept)
