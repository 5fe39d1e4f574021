import corpus_pipeline as pipeline


def test_no_document_with_a_letter_is_dropped(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    clean = {r["doc_id"] for r in docs.where("text rlike '\\\\p{L}'").select("doc_id").collect()}
    kept = {r["doc_id"] for r in pipeline.detect_language(spark, docs, "").select("doc_id").collect()}
    assert clean - kept == set()
