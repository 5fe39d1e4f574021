"""Zip archives as a parallel source: a partition for each member, unpacked where it is read."""

from __future__ import annotations

import fnmatch
import sys
import zipfile

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LINES = "archive string, member string, line_no long, value string"
STEP = 1 << 20


def store_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a path (local, hdfs, s3, gs), and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


class MemberPartition(InputPartition):
    def __init__(self, archive: str, member: str):
        self.archive, self.member = archive, member


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options.get("member", "*")

    def partitions(self) -> list[MemberPartition]:
        """Members whose names match, from the archives' directories alone."""
        store, path = store_of(self.path)
        info = store.get_file_info(path)
        files = [info] if info.is_file else store.get_file_info(pyarrow.fs.FileSelector(path))
        found = []
        for f in sorted((f for f in files if f.is_file and f.path.endswith(".zip")), key=lambda f: f.path):
            with store.open_input_file(f.path) as source, zipfile.ZipFile(source) as z:
                found += [MemberPartition(f.path, m.filename) for m in z.infolist() if not m.is_dir() and fnmatch.fnmatch(m.filename, self.pattern)]
        return found

    def read(self, partition: MemberPartition):
        store, _ = store_of(self.path)
        name = partition.archive.rpartition("/")[2]
        with store.open_input_file(partition.archive) as source, zipfile.ZipFile(source) as z, z.open(partition.member) as stream:
            rest, line_no = b"", 0
            while True:
                data = stream.read(STEP)
                lines = (rest + data).split(b"\n")
                rest = lines.pop() if data else b""
                if not data and lines and not lines[-1]:
                    lines.pop()  # the last line ended, and none follows
                if lines:
                    texts = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(texts)), pa.array([partition.member] * len(texts)), pa.array(range(line_no, line_no + len(texts)), type=pa.int64()), pa.array(texts)],
                        names=["archive", "member", "line_no", "value"],
                    )
                    line_no += len(lines)
                if not data:
                    return


class ArchiveLines(DataSource):
    """Lines of the members of a zip archive, or of all archives of a folder.

    Options: ``path``, and ``member``, a pattern of members' names.  Archives
    may be in any store that pyarrow opens; a member is read as a stream, in
    one task.  Line numbers count from 0 in each member.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> MemberReader:
        return MemberReader(dict(self.options))


def read_archive(spark: SparkSession, path: str, member: str = "*") -> DataFrame:
    """``archive, member, line_no, value`` of all lines of the members that match."""
    spark.dataSource.register(ArchiveLines)
    return spark.read.format("archive_lines").option("member", member).load(path)


def write_archives(lines: DataFrame, folder: str, header: str | None = None, lines_per_member: int = 100_000) -> int:
    """Writes an archive for each partition of a frame of one text column, in members of bounded size; returns how many.

    Every member begins with the header, if one is given.  Archives get their
    names when they are complete, so that a task that runs again does no harm.
    """

    def pack(batches):
        store, at = store_of(folder)
        store.create_dir(at)
        part = TaskContext.get().partitionId()
        done, draft = f"{at}/part-{part:05d}.zip", f"{at}/.part-{part:05d}-{TaskContext.get().taskAttemptId()}"
        held = members = 0
        with store.open_output_stream(draft) as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
            out = None
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    if out is None or held == lines_per_member:
                        if out is not None:
                            out.close()
                        out, held, members = z.open(f"occurrence-{members:05d}.txt", "w"), 0, members + 1
                        if header is not None:
                            out.write(header.encode() + b"\n")
                    out.write((text or "").encode() + b"\n")
                    held += 1
            if out is not None:
                out.close()
        store.move(draft, done)
        yield pa.RecordBatch.from_pydict({"members": pa.array([members], type=pa.int32())})

    return lines.mapInArrow(pack, "members int").count()
