import struct
import zipfile

from pyspark.sql import functions as F

from phenogrid.functions import geo
from phenogrid.sources import archive, readers, writers
from phenogrid.streaming import incremental


def test_archive_and_ragged_rows(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("occurrence.txt", "x\ty\tz\n1\t2\t3\n4\t5\n6\t7\t8\t9\n")
        z.writestr("readme.txt", "no")
    path = readers.unpack_member(spark, str(tmp_path / "a.zip"), str(tmp_path / "out"))
    got = sorted(tuple(r) for r in readers.read_tsv(spark, path, ["x", "z"]).collect())
    assert got == [("1", "3"), ("4", None), ("6", "8")]


def test_labels_and_taxonomy(spark, tmp_path):
    (tmp_path / "labels.txt").write_text("c0\tSci a\tCom a\nc1\tSci b\nc2\n")
    got = [tuple(r) for r in readers.read_labels(spark, str(tmp_path / "labels.txt")).orderBy("idx").collect()]
    assert got == [(0, "c0", "Sci a", "Com a"), (1, "c1", "Sci b", "Sci b"), (2, "c2", "c2", "c2")]
    (tmp_path / "tax.csv").write_text("sci_name,com_name,species_code,common_name_de,common_name_fr\nA b,x,c,Hallo,\n")
    assert readers.read_taxonomy(spark, str(tmp_path / "tax.csv")).first()["locale_names"] == {"de": "Hallo"}
    labels = readers.read_labels(spark, str(tmp_path / "labels.txt"))
    writers.write_labels(labels, str(tmp_path / "again"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "again").glob("part-*")))
    assert text == "c0\tSci a\tCom a\nc1\tSci b\tSci b\nc2\tc2\tc2\n"


def test_occurrences_there_and_back(spark, tmp_path):
    df = spark.createDataFrame([(1.5, 2.5, 7, "A b", "x", 3, "Aves"), (1.0, 2.0, None, "C d", "C d", 48, None)], readers.OCCURRENCE_SCHEMA)
    writers.write_occurrences(df, str(tmp_path / "o"))
    assert sorted(map(tuple, readers.read_occurrences(spark, str(tmp_path / "o")).collect())) == sorted(map(tuple, df.collect()))


def test_parts_of_differing_columns(spark, tmp_path):
    spark.range(2).selectExpr("id", "1 as a").coalesce(1).write.parquet(str(tmp_path / "grid_5km_chunk_0000.parquet"))
    spark.range(3).selectExpr("id", "2 as b").coalesce(1).write.parquet(str(tmp_path / "grid_5km_chunk_0001.parquet"))
    df = spark.read.option("mergeSchema", True).parquet(*[str(p) for p in sorted(tmp_path.glob("grid_*"))])
    assert df.count() == 5 and set(df.columns) == {"id", "a", "b"}
    spark.range(4).coalesce(1).write.parquet(str(tmp_path / "flat"))
    assert readers.read_parts(spark, str(tmp_path / "flat"), "*.parquet").count() == 4


def test_cells_and_wkb(spark, tmp_path):
    xy = [0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 0.0]
    blob = struct.pack("<BIII8d", 1, 3, 1, 4, *xy)
    df = readers.parse_wkb(spark.createDataFrame([(1, bytearray(blob)), (2, None), (3, bytearray(b"\x01\x01"))], "id int, wkb binary"), "wkb")
    rings = {r["id"]: r["ring"] for r in df.collect()}
    assert [(p["lon"], p["lat"]) for p in rings[1]] == list(zip(xy[::2], xy[1::2])) and rings[2] is None and rings[3] is None
    wide = spark.createDataFrame([(1, 180.0), (2, 180.1), (3, 10.0)], "id int, w double")
    cells = wide.select("id", geo.bbox_ring(F.lit(-100.0), F.lit(0.0), F.col("w") - 100, F.lit(5.0)).alias("ring"))
    writers.write_cells(cells, str(tmp_path / "cells"), rows_per_file=1)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "cells")).collect()) == [1, 3]
    back = readers.parse_wkb(spark.read.parquet(str(tmp_path / "cells")), "geometry", "again").collect()
    assert all(r["again"] == r["ring"] for r in back)
    assert max(spark.read.parquet(str(p)).count() for p in (tmp_path / "cells").glob("part-*.parquet")) == 1


def test_cache_by_content(spark, tmp_path):
    source, built = tmp_path / "in.txt", []
    source.write_text("a")

    def get(parameters):
        def build():
            built.append(parameters)
            return spark.read.text(str(source))

        return [r["value"] for r in writers.read_through(spark, str(tmp_path / "cache"), [str(source)], parameters, build).collect()]

    assert get({"cap": 1}) == get({"cap": 1}) == ["a"] and len(built) == 1
    assert get({"cap": 2}) == ["a"] and len(built) == 2
    source.write_text("bb")
    assert get({"cap": 1}) == ["bb"] and len(built) == 3
    assert get({"cap": 2}) == ["bb"] and get({"cap": 1}) == ["bb"] and len(built) == 4
    assert not list((tmp_path / "cache").glob("_draft-*"))


def test_draft_that_comes_second_is_dropped(spark, tmp_path):
    source = tmp_path / "in.txt"
    source.write_text("a")

    def build():
        # another run publishes the same while this one builds
        writers.read_through(spark, str(tmp_path / "cache"), [str(source)], {}, lambda: spark.range(1))
        return spark.range(2)

    assert writers.read_through(spark, str(tmp_path / "cache"), [str(source)], {}, build).count() == 1
    assert len(list((tmp_path / "cache").iterdir())) == 1


def test_archive_of_several_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("occurrence-1.txt", "x\ty\r\n1\t2\nlast")
        z.writestr("occurrence-2.txt", "é\n\n" * 400_000)
        z.writestr("meta.xml", "<no>")
        z.writestr("empty-occurrence.txt", "")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("occurrence-1.txt", "only\n")
    lines = archive.read_archive(spark, str(tmp_path), "occurrence-*.txt")
    assert lines.rdd.getNumPartitions() == 3
    got = {(r["archive"], r["member"]): (r["n"], r["last"]) for r in lines.groupBy("archive", "member").agg(F.count("*").alias("n"), F.max("line_no").alias("last")).collect()}
    assert got == {("a.zip", "occurrence-1.txt"): (3, 2), ("a.zip", "occurrence-2.txt"): (800_000, 799_999), ("b.zip", "occurrence-1.txt"): (1, 0)}
    assert [r["value"] for r in lines.where("archive = 'a.zip' and member like '%-1.txt'").orderBy("line_no").collect()] == ["x\ty", "1\t2", "last"]
    assert archive.read_archive(spark, str(tmp_path / "a.zip"), "empty-*").count() == 0


def test_archives_there_and_back(spark, tmp_path):
    lines = spark.range(1000).selectExpr("concat('row ', id, ' ä') as line").repartition(3)
    assert archive.write_archives(lines, f"file:{tmp_path}/out", header="name", lines_per_member=150) == 3
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"part-{i:05d}.zip" for i in range(3)]
    back = archive.read_archive(spark, f"file://{tmp_path}/out")
    assert {r["value"] for r in back.where("line_no = 0").collect()} == {"name"} and back.select("archive", "member").distinct().count() >= 7
    assert back.where("line_no > 0").select("value").exceptAll(lines).count() == 0 and back.where("line_no > 0").count() == 1000


def test_part_files_with_a_broken_one(spark, tmp_path):
    names = writers.write_chunks(spark.range(10).selectExpr("id", "id * 2 as a", "id div 4 as chunk"), str(tmp_path), "chunk")
    assert names == [f"grid_5km_chunk_{i:04d}.parquet" for i in range(3)]
    writers.write_chunks(spark.range(3).selectExpr("id", "id * 3 as b", "7 as chunk"), str(tmp_path), "chunk")
    (tmp_path / "grid_5km_chunk_0008.parquet").write_bytes((tmp_path / names[0]).read_bytes()[:200])
    (tmp_path / "other.parquet").write_bytes(b"not asked for")
    assert {(r["file"], r["n_rows"], r["skipped"]) for r in readers.parts_report(spark, str(tmp_path)).collect()} == {(names[0], 4, False), (names[1], 4, False), (names[2], 2, False), ("grid_5km_chunk_0007.parquet", 3, False), ("grid_5km_chunk_0008.parquet", 0, True)}
    rows = readers.read_parts(spark, str(tmp_path))
    assert rows.count() == 13 and rows.where("a is null").count() == 3 and set(rows.columns) == {"id", "a", "b"}


def test_blocks_end_at_the_limit(spark, tmp_path):
    writers.write_chunks(spark.range(1000).selectExpr("id", "id div 10 as chunk"), str(tmp_path), "chunk")
    for most, blocks, seen in ((1, 1, 1), (10, 1, 1), (11, 2, 3), (35, 4, 7), (70, 7, 7), (999, 100, 100), (5000, 100, 100)):
        rows, looked_at = readers.read_blocks(spark, str(tmp_path), most)
        assert (rows.count(), rows.agg(F.max("id")).first()[0], looked_at) == (10 * blocks, 10 * blocks - 1, seen)


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Stopped in the midst, started again, with files that came meanwhile: no row is lost or comes twice."""
    schema = "cell bigint, week int, species string"
    rows = [(i % 7, i % 48 + 1, f"s{i % 11}") for i in range(4000)]
    for k in range(6):
        spark.createDataFrame(rows[k * 500 : k * 500 + 900], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start = lambda once: incremental.write_presence(incremental.read_presence_stream(spark, str(tmp_path / "in"), schema, 1), str(tmp_path / "out"), str(tmp_path / "cp"), once=once)
    running = start(False)
    while not any(p["numInputRows"] for p in running.recentProgress):
        running.awaitTermination(0.05)
    running.stop()
    spark.createDataFrame(rows[3400:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    start(True).awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(set(rows))


def test_presence_stream(spark, tmp_path):
    schema = "cell bigint, week int, species string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write([(1, 1, "a"), (1, 1, "a"), (1, 49, "a")])
    for _ in range(2):
        stream = incremental.read_presence_stream(spark, str(tmp_path / "in"), schema)
        incremental.write_presence(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        write([(1, 1, "a"), (2, 3, "b")])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, 1, "a"), (2, 3, "b")]


def test_wkb_of_many_rings_and_other_shapes(spark):
    ring = lambda *xy: struct.pack(f"<I{len(xy)}d", len(xy) // 2, *xy)
    head = lambda kind, n: struct.pack("<BII", 1, kind, n)
    outer, hole = (0.0, 0.0, 4.0, 0.0, 4.0, 4.0, 0.0, 0.0), (1.0, 0.5, 2.0, 0.5, 2.0, 1.0, 1.0, 0.5)
    polygon = head(3, 2) + ring(*outer) + ring(*hole)
    several = struct.pack(">BII", 0, 6, 2) + head(3, 1) + ring(*hole) + polygon
    point = struct.pack("<BIdd", 1, 1, 5.0, 6.0)
    df = spark.createDataFrame([(1, bytearray(polygon)), (2, bytearray(several)), (3, bytearray(point)), (4, bytearray(polygon[:40])), (5, bytearray(b"\x01\x63\x00\x00\x00\x01\x00\x00\x00"))], "id int, wkb binary")
    got = {r["id"]: r["rings"] and [[v for p in x for v in (p["lon"], p["lat"])] for x in r["rings"]] for r in readers.parse_wkb(df, "wkb", rings="rings").collect()}
    assert got == {1: [list(outer), list(hole)], 2: [list(hole), list(outer), list(hole)], 3: [[5.0, 6.0]], 4: None, 5: None}


def test_species_list(spark, tmp_path):
    writers.write_species_list(spark.createDataFrame([(2, "b", "Bee"), (1, "a", "Ant")], "rank int, code string, com string"), str(tmp_path / "list"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "list")).collect()] == ["1\ta\tAnt", "2\tb\tBee"]
