from collections import defaultdict

import corpus_pipeline as pipeline


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    first = docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == first.columns and dict(docs.dtypes) == dict(first.dtypes)
        seen[name] = docs
    n = {k: v.count() for k, v in seen.items()}
    assert n["language"] >= 0.97 * first.count() and n["near_duplicates"] <= n["line_dedup"] <= n["language"] <= n["mixing"] * 1.3
    assert {r["doc_id"] for r in seen["mixing"].select("doc_id").collect()} == {r["doc_id"] for r in seen["near_duplicates"].select("doc_id").collect()}
    lines = [x for r in seen["line_dedup"].collect() for x in r["text"].split("\n") if x.strip()]
    assert len(set(lines)) == len(lines)
    fill = defaultdict(int)
    for r in docs.collect():
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024 and sum(fill.values()) / 1024 / len(fill) > 0.95


def test_whole_run(spark):
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


def test_odd_rows_in_every_stage(spark, odd_documents, no_documents):
    extra = odd_documents.union(spark.createDataFrame([(None, "a text of some words without an id", None, "a", 1, 1, "q")], odd_documents.schema))
    for name, stage in pipeline.STAGES:
        for docs in (extra, no_documents):
            out = stage(spark, docs, "")
            ids = [r["doc_id"] for r in out.collect()]
            if name != "packing":
                assert out.columns == docs.columns
            if docs is no_documents:
                assert not ids
            else:
                assert None in ids and (2 in ids) == (name in ("near_duplicates", "mixing", "packing"))


def test_columns_of_any_name_pass(spark):
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, _kept string, _doc int, _lang_pred string, _id int, _epochs int, _copy int, _bucket int"
    docs = spark.createDataFrame([(i, f"some words of text number {i} and a few others", "en", "a", 9, "k", 1, "l", 2, 3, 4, 5) for i in range(6)], names)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {tuple(r)[5:] for r in out.collect()} == {("k", 1, "l", 2, 3, 4, 5)}
