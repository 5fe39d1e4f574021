"""Queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenogrid.llm import knn, language, lines, merkle, mixing, ngram_join, packing, pii, repair, secrets, sharding, simhash, sql, syncmers

SHARDS = 40


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_documents(spark, sf_dir))
    base = f"filter(spans, s -> s.kind in ({', '.join(repr(k) for k in pii.BASE_KINDS)}))"
    counts = [f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint) as n_{k}" for k in pii.BASE_KINDS]
    return found.selectExpr("doc_id", *counts, f"sha2({pii.digest_sql(base)}, 256) as base_sha256", f"{pii.digest_sql('spans')} as spans")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held_out", F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"))
    model = language.train(docs.where("not held_out"), key=F.col("doc_id"))
    return language.predict(docs, model, ["doc_id", "held_out"])


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), [1.0] * SHARDS).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "text")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(_documents(spark, sf_dir)))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir), max_repeats=2.0)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(_documents(spark, sf_dir), width=3, percent=90)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=10, every=100, scale=1024)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_findings(spark))
    return secrets.find_secrets(_documents(spark, sf_dir), model)


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(_documents(spark, sf_dir))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults drawn by id and turn, as the query's contract has them."""
    draw = F.expr("crc32(cast(concat(coalesce(cast(conv_id as string), ' '), ':', coalesce(cast(turn as string), ' ')) as binary)) % 20")
    drawn = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), draw.alias("draw"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.expr("array_repeat(0, case draw when 0 then 0 when 3 then 2 else 1 end)"))
    return drawn.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = damaged(conversations)
    found = repair.audits(rows)
    digests = repair.repaired_digests(rows, found).withColumnRenamed("conv_id", "digest_of")
    found = found.join(digests, F.expr("conv_id <=> digest_of")).drop("digest_of").withColumnRenamed("conv_id", "found_of")
    every = conversations.select("conv_id").distinct().join(found, F.expr("conv_id <=> found_of"), "left")
    return every.select("conv_id", *[F.coalesce(f, F.lit(0).cast("long")).alias(f) for f in repair.FACTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(_documents(spark, sf_dir), width=3, most=3)
    return found.select("doc_id", F.expr("lpad(lower(hex(fingerprint)), 16, '0')").alias("fingerprint"), "component_id")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    harmed = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 0 and text is not null")
    docs = _documents(spark, sf_dir).select("doc_id", "lang", merkle.leaf(columns).alias("leaf"), F.when(harmed, F.unhex(merkle.leaf([*columns[:-1], merkle.LOWER.format("text")]))).alias("other"))
    found = merkle.manifest(docs, "doc_id", "lang", carry=("other",))
    found = found.withColumn("folded_root", merkle.folded("coalesce(lower(hex(other)), leaf)", "path"))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest("path").alias("proof_sha256"), "folded_root", F.expr("folded_root = root").alias("verified"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii, op2_language, op3_sharding, op4_line_dedup, op5_packing, op6_mixing, op7_ngram_join, op8_topk, op9_secrets, op10_syncmers, op11_repair, op12_simhash, op13_manifest)}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_ngram_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
items AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y
  WHERE 100 * n >= 90 * (len(a.s) + len(b.s) - n)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS to_id FROM sets UNION SELECT r.doc_id, w.y FROM reach r JOIN ways w ON w.x = r.to_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.to_id) AS component_id
FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(s.s)""",
        "op8_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
        "op11_repair": sql.REPAIR,
        "op13_manifest": sql.MANIFEST,
    }
