import re

from phenogrid.llm import secrets

TEXTS = [
    'set token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b" now',
    "fixed in commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b of main",
    "export API_KEY=ghp_A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6 # ci",
    "see https://example.com/photo/user-profile-2024/thumb.png",
    'TOKEN = "9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B"!! AND',
    "order id: 123e4567-e89b-12d3-a456-426614174000 shipped",
    "nothing here but superextraordinarily long words",
    "é\U0001f600 password: \"Zx9Kp2Lm8Qw4Rt6Yb1Nc3Vd\" then sha256: 2c26b46b68ffc68ff99b453c1d30413413422d706483bfa0f98a5e886266e7ae",
    None,
    "",
]
SECRET = {0, 2, 4, 7}


def test_candidates_have_right_places(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {(r["doc_id"], r["start"], r["end"], r["candidate"]) for r in secrets.candidates(df, "doc_id", "text").collect()}
    want = {(i, m.start(), m.end(), m[0]) for i, t in enumerate(TEXTS) for m in re.finditer(secrets.CANDIDATE, t or "")}
    assert got == want and len(want) >= 7


def test_forest_keeps_secrets_only(spark):
    model = secrets.train(secrets.labelled_findings(spark))
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    found = secrets.find_secrets(df, model).collect()
    assert {r["doc_id"] for r in found} == SECRET
    assert [r["candidate"] for r in found if r["doc_id"] == 7] == ["Zx9Kp2Lm8Qw4Rt6Yb1Nc3Vd"]


def test_held_out_accuracy(spark):
    rows = secrets.labelled_findings(spark).withColumn("doc_id", secrets.F.col("id"))
    model = secrets.train(rows.where("id % 5 <> 0"))
    held = rows.where("id % 5 = 0")
    text = held.selectExpr("doc_id", "label", 'concat(left, candidate, right) as text', "candidate as want")
    found = secrets.find_secrets(text, model).withColumnRenamed("candidate", "want").select("doc_id", "want").distinct()
    right = text.join(found.withColumn("hit", secrets.F.lit(1)), ["doc_id", "want"], "left").selectExpr("avg(cast(label = coalesce(hit, 0) as int))").first()[0]
    assert right > 0.93


def test_odd_rows(spark, odd_documents, no_documents):
    model = secrets.train(secrets.labelled_findings(spark, 2000))
    assert [r["doc_id"] for r in secrets.find_secrets(odd_documents, model).collect()] == [10]
    assert secrets.find_secrets(no_documents, model).count() == 0


def test_words_inside_other_words_are_no_cues(spark):
    model = secrets.train(secrets.labelled_findings(spark))
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    texts = [f'laairérevi token = "{key}" and', f'thesha token = "{key}" and', f'ershat orderly token = "{key}"', f'the tokenless commit {key} of', f'accessToken: "{key}"', f'DB_PASSWORD={key}']
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert {r["doc_id"] for r in secrets.find_secrets(df, model).collect()} == {0, 1, 2, 4, 5}


def test_templates_that_were_not_learned(spark):
    """Findings of held-out templates: hexadecimal keys of any length, quoted digests, paths."""
    held = "template in (1, 7, 9)"
    rows = secrets.labelled_findings(spark).withColumn("doc_id", secrets.F.col("id"))
    model = secrets.train(rows.where(f"not {held}"))
    text = rows.where(held).selectExpr("doc_id", "label", "template", "concat(left, candidate, right) as text", "candidate as want")
    found = secrets.find_secrets(text, model).withColumnRenamed("candidate", "want").select("doc_id", "want").distinct()
    by = text.join(found.withColumn("hit", secrets.F.lit(1)), ["doc_id", "want"], "left").groupBy("template").agg(secrets.F.avg((secrets.F.col("label") == secrets.F.coalesce("hit", secrets.F.lit(0))).cast("int")).alias("right"))
    assert all(r["right"] > 0.85 for r in by.collect()), by.collect()


def test_planted_tokens(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = docs.selectExpr("doc_id", "explode(regexp_extract_all(text, 'token = \"([0-9a-f]{40})\"', 1)) as candidate")
    found = secrets.find_secrets(docs, secrets.train(secrets.labelled_findings(spark)))
    assert planted.join(found, ["doc_id", "candidate"], "left_anti").count() == 0 < planted.count()


def test_long_runs_of_any_kind(spark):
    """A million repeats of what names, words and keys are made of: scanned in a loop, each as one candidate or none."""
    n = 10**6
    texts = ["a_" * n + "=x1", "ab-" * n + "=x1", "a1_" * n + "=x1", "a_" * n + "b=" + "9f86d081884c7d659a2f", "a" * n + "=1", "1_" * n, "-" * n + "1", "eyJ" + "a" * n + "." + "b" * n + "." + "c1" * 9, "A=" * n, "/a1" * n, "a_1" * n + "="]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {}
    for r in secrets.with_features(secrets.candidates(df, "doc_id", "text")).select("doc_id", "start", "end", "length").collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
        assert r["length"] == r["end"] - r["start"]
    assert found == {i: [(m.start(), m.end()) for m in re.finditer(secrets.CANDIDATE, t)] for i, t in enumerate(texts) if re.search(secrets.CANDIDATE, t)}
