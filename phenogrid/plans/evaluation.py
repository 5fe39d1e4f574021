"""Queries of metrics, losses and correlations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from phenogrid.functions import scalars
from phenogrid.operators import losses as L
from phenogrid.operators import metrics as M
from phenogrid.plans.tables import Tables, sql

QUERIES: dict = {}


def query(text: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = (f, text)
        return f

    return keep


def ap_sql(by: str) -> str:
    return f"""ap AS (SELECT {by}, count(*) FILTER (WHERE label) AS n_pos, sum(CASE WHEN label THEN hits::DOUBLE / rank ELSE 0 END) / count(*) FILTER (WHERE label) AS ap FROM (
 SELECT *, row_number() OVER w AS rank, sum(label::INT) OVER w AS hits FROM evaluation WINDOW w AS (PARTITION BY {by} ORDER BY prob DESC, tie ROWS UNBOUNDED PRECEDING)) GROUP BY {by} HAVING count(*) FILTER (WHERE label) > 0)"""


@query(sql("SELECT sample, n_pos, round(ap, 6) AS ap FROM ap", "evaluation", more=ap_sql("sample")))
def average_precision(t: Tables):
    return M.average_precision(t.evaluation(), "sample", "tie").withColumn("ap", F.round("ap", 6))


@query(sql("SELECT species, round(ap, 6) AS ap, round((SELECT avg(ap) FROM ap), 6) AS mean_ap FROM ap", "evaluation", more=ap_sql("species")))
def watchlist_ap(t: Tables):
    ap = M.average_precision(t.evaluation(), "species", "tie")
    return ap.crossJoin(F.broadcast(ap.agg(F.round(F.avg("ap"), 6).alias("mean_ap")))).select("species", F.round("ap", 6).alias("ap"), "mean_ap")


@query(sql(" UNION ALL ".join(f"""SELECT {k} AS k, round(sum(CASE WHEN pos > 0 AND n >= {k} THEN hits ELSE 0 END)::DOUBLE / greatest(sum(pos), 1), 6) AS recall FROM (SELECT sample, count(*) FILTER (WHERE label AND r <= {k}) AS hits, count(*) FILTER (WHERE label) AS pos, count(*) AS n FROM ranked GROUP BY sample)""" for k in (10, 30)), "evaluation", more="ranked AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY prob DESC, tie) AS r FROM evaluation)"))
def topk_recall(t: Tables):
    e = t.evaluation()
    return M.topk_recall(e, "sample", "tie", 10).union(M.topk_recall(e, "sample", "tie", 30)).withColumn("recall", F.round("recall", 6))


THRESH = "th(t) AS (VALUES (0.05::DOUBLE), (0.10::DOUBLE), (0.25::DOUBLE))"


@query(sql("""SELECT t, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(p + r, 1e-8), 6) AS f1 FROM (SELECT *, tp::DOUBLE / greatest(tp + fp, 1) AS p, tp::DOUBLE / greatest(tp + fn, 1) AS r FROM (
 SELECT t, count(*) FILTER (WHERE prob > t AND label) AS tp, count(*) FILTER (WHERE prob > t AND NOT label) AS fp, count(*) FILTER (WHERE NOT prob > t AND label) AS fn FROM evaluation CROSS JOIN th GROUP BY t))""", "evaluation", more=THRESH))
def f1_thresholds(t: Tables):
    return M.confusion(t.evaluation()).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(sql("SELECT t, round(coalesce(avg(CASE WHEN pos > 0 THEN pred::DOUBLE / pos END), 0), 6) AS list_ratio, round(avg(pred), 6) AS mean_list_len FROM (SELECT t, sample, count(*) FILTER (WHERE prob > t) AS pred, count(*) FILTER (WHERE label) AS pos FROM evaluation CROSS JOIN th GROUP BY t, sample) GROUP BY t", "evaluation", more=THRESH))
def list_ratio(t: Tables):
    return M.list_ratio(t.evaluation(), "sample").withColumns({c: F.round(c, 6) for c in ("list_ratio", "mean_list_len")})


DENSE = ap_sql("sample") + ", d AS (SELECT ap, density FROM ap JOIN (SELECT sample, max(density)::DOUBLE AS density FROM evaluation GROUP BY sample) USING (sample)), q AS (SELECT quantile_cont(density, 0.25) AS q25, quantile_cont(density, 0.75) AS q75 FROM d)"


@query(sql("SELECT round(s, 6) AS map_sparse, round(e, 6) AS map_dense, round(CASE WHEN e > 0 THEN s / e END, 6) AS map_density_ratio FROM (SELECT avg(CASE WHEN density <= q25 THEN ap END) AS s, avg(CASE WHEN density >= q75 THEN ap END) AS e FROM d CROSS JOIN q)", "evaluation", more=DENSE))
def density_stratified_map(t: Tables):
    e = t.evaluation()
    d = e.groupBy("sample").agg(F.max("density").cast("double").alias("obs_density"))
    out = M.density_stratified(M.average_precision(e, "sample", "tie").join(d, "sample"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(sql("SELECT round(corr(pred, density), 6) AS r FROM (SELECT sample, count(*) FILTER (WHERE prob > 0.1)::DOUBLE AS pred, max(density)::DOUBLE AS density FROM evaluation GROUP BY sample)", "evaluation"))
def pred_density_corr(t: Tables):
    per = t.evaluation().groupBy("sample").agg(F.count_if(F.col("prob") > 0.1).cast("double").alias("pred"), F.max("density").cast("double").alias("density"))
    return per.agg(F.round(F.corr("pred", "density"), 6).alias("r"))


@query(sql("SELECT round(corr(x, y), 6) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY water) + (count(*) OVER (PARTITION BY water) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY urban) + (count(*) OVER (PARTITION BY urban) - 1) / 2.0::DOUBLE AS y FROM cells WHERE water IS NOT NULL AND urban IS NOT NULL)", "cells"))
def spearman(t: Tables):
    return M.spearman(t.cells(), "water", "urban").withColumn("rho", F.round("rho", 6))


NAMES = list(M.SCORE_WEIGHTS)


def runs(t: Tables):
    """Made metric rows with some components missing."""
    cols = [f"case when pmod(c_custkey, {i + 3}) = 0 then null else (c_custkey * {i * 37 + 11} % 200) / 100 {'- 1' if n == 'pred_density_corr' else ''} end as {n}" for i, n in enumerate(NAMES)]
    return t.read("customer").selectExpr("c_custkey as run", *cols)


def _score_sql() -> str:
    cols = ", ".join(f"CASE WHEN c_custkey % {i + 3} = 0 THEN NULL ELSE (c_custkey * {i * 37 + 11} % 200)::DOUBLE / 100 {'- 1' if n == 'pred_density_corr' else ''} END AS {n}" for i, n in enumerate(NAMES))
    v = {n: n for n in NAMES} | {"list_ratio_10": "exp(-abs(ln(greatest(list_ratio_10, 1e-8))))", "map_density_ratio": "least(map_density_ratio, 1 / greatest(map_density_ratio, 1e-8))", "pred_density_corr": "greatest(0, 1 - abs(pred_density_corr))"}
    num = " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE {v[n]} * {w}::DOUBLE END" for n, w in M.SCORE_WEIGHTS.items())
    den = " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE {w}::DOUBLE END" for n, w in M.SCORE_WEIGHTS.items())
    return f"SELECT run, round(CASE WHEN {den} > 0 THEN ({num}) / ({den}) ELSE 0 END, 6) AS score FROM (SELECT c_custkey AS run, {cols} FROM customer)"


@query(_score_sql())
def geoscore(t: Tables):
    return M.composite_score(runs(t)).select("run", F.round("score", 6).alias("score"))


@query("SELECT epoch, score, max(score) OVER o AS best, CAST(epoch - max(CASE WHEN is_new THEN epoch END) OVER o AS BIGINT) AS since FROM (SELECT *, score > coalesce(max(score) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS is_new FROM (SELECT n_nationkey AS epoch, (n_nationkey * 7919 % 100)::DOUBLE / 100 AS score FROM nation)) WINDOW o AS (ORDER BY epoch ROWS UNBOUNDED PRECEDING)")
def running_best(t: Tables):
    """A run's best score so far and the epochs since; a run has few epochs."""
    e = t.read("nation").selectExpr("n_nationkey as epoch", "(n_nationkey * 7919 % 100) / 100 as score")
    w = Window.orderBy("epoch")
    new = F.col("score") > F.coalesce(F.max("score").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1.0))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.withColumn("new", new).select("epoch", "score", F.max("score").over(upto).alias("best"), (F.col("epoch") - F.max(F.when(F.col("new"), F.col("epoch"))).over(upto)).cast("long").alias("since"))


BCE = "(greatest(logit, 0) - logit * target + ln(1 + exp(-abs(logit))))"
P = "(1 / (1 + exp(-logit)))"


@query(sql(f"""SELECT species, round(avg({BCE}), 6) AS bce, round(avg((0.25 * target + 0.75 * (1 - target)) * pow(1 - ({P} * target + (1 - {P}) * (1 - target)), 2) * {BCE}), 6) AS focal,
 round(avg(-(target * ln({P}) + (1 - target) * pow(greatest({P} - 0.05, 0), 2) * ln(1 - greatest({P} - 0.05, 0)))), 6) AS asl, round(sum({BCE}), 4) AS bce_sum FROM evaluation GROUP BY species""", "evaluation"))
def losses(t: Tables):
    x, y = F.col("logit"), F.col("target")
    return t.evaluation().groupBy("species").agg(F.round(F.avg(L.bce(x, y)), 6).alias("bce"), F.round(F.avg(L.focal(x, y)), 6).alias("focal"), F.round(F.avg(L.asymmetric(x, y)), 6).alias("asl"), F.round(F.sum(L.bce(x, y)), 4).alias("bce_sum"))


@query(sql(f"SELECT round(avg(s / n), 6) AS an_loss FROM (SELECT sample, sum(CASE WHEN target > 0.5 THEN 4.0 * {BCE} ELSE {BCE} END) AS s, count(*) AS n FROM evaluation GROUP BY sample)", "evaluation"))
def an_loss(t: Tables):
    return L.assume_negative(t.evaluation(), "sample").select(F.round("an_loss", 6).alias("an_loss"))


# a sample's species are its events, numbered; 16 of them are drawn
SAMPLED = f"""numbered AS (SELECT sample, target, {BCE} AS loss, row_number() OVER (PARTITION BY sample ORDER BY tie) - 1 AS idx, count(*) OVER (PARTITION BY sample) AS n FROM (SELECT sample, tie, target, greatest(0.05, least(0.95, target)) AS smooth, logit FROM evaluation)),
drawn AS (SELECT sample, CAST(floor(CAST('0x' || substr(md5(CAST(sample AS VARCHAR) || '|' || turn || '|42'), 1, 8) AS BIGINT)::DOUBLE / 4294967296 * n) AS BIGINT) AS idx FROM (SELECT DISTINCT sample, n FROM numbered WHERE n > 16) CROSS JOIN range(0, 16) r(turn)),
few AS (SELECT sample, sum(loss) / count(*) AS mean FROM drawn JOIN numbered USING (sample, idx) WHERE target < 0.5 GROUP BY sample),
per AS (SELECT sample, sum(CASE WHEN target > 0.5 THEN loss ELSE 0 END) AS pos, sum(CASE WHEN target > 0.5 THEN 0 ELSE loss END) AS neg, count(*) AS n, count(*) FILTER (WHERE target < 0.5) AS n_neg FROM numbered GROUP BY sample)""".replace("- logit * target", "- logit * smooth")


@query(sql("SELECT round(avg((4.0 * pos + CASE WHEN n > 16 THEN coalesce(mean * n_neg, 0) ELSE neg END) / n), 6) AS an_loss FROM per LEFT JOIN few USING (sample)", "evaluation", more=SAMPLED))
def an_loss_sampled(t: Tables):
    """The loss with sixteen species of each sample drawn, and smoothed labels."""
    e = t.evaluation().withColumn("idx", F.row_number().over(Window.partitionBy("sample").orderBy("tie")) - 1)
    return L.assume_negative(e, "sample", smoothing=0.05, negatives=16, idx="idx").select(F.round("an_loss", 6).alias("an_loss"))


@query(sql("SELECT round(coalesce(avg(pow(least(10000.0, greatest(-10000.0, lat * 400)) - elevation, 2)), 0), 3) AS mse FROM cells", "cells"))
def masked_mse(t: Tables):
    return t.cells().agg(F.round(L.masked_mse(F.col("lat") * 400, F.col("elevation")), 3).alias("mse"))


@query(sql(f"SELECT species, round(1.0 * avg({BCE}) + 0.1 * avg(pow(prob - target, 2)) + 0.5 * avg({BCE} * 0.5), 6) AS total FROM evaluation GROUP BY species", "evaluation"))
def total_loss(t: Tables):
    x, y = F.col("logit"), F.col("target")
    return t.evaluation().groupBy("species").agg(F.round(1.0 * F.avg(L.bce(x, y)) + 0.1 * L.masked_mse(F.col("prob"), y) + 0.5 * F.avg(L.bce(x, y) * 0.5), 6).alias("total"))


@query(sql("SELECT tie, round(prob * 0.3 + (1 - prob) * 0.8, 6)::DOUBLE AS p FROM evaluation", "evaluation"))
def gate_mix(t: Tables):
    return t.evaluation().select("tie", F.round(scalars.gate_mix(F.col("prob"), F.lit(0.3), F.lit(0.8)), 6).alias("p"))


@query(sql("SELECT round(max(d), 6) AS max_diff, round(avg(d), 6) AS mean_diff, max(d) <= 0.08 AS ok FROM (SELECT abs(prob - round(prob, 1)) AS d FROM evaluation WHERE tie < 200)", "evaluation"))
def max_abs_diff(t: Tables):
    """Two versions of the same outputs compared: here full and coarsened probabilities."""
    e = t.evaluation().where("tie < 200").select("tie", "prob")
    both = e.join(e.select("tie", F.round("prob", 1).alias("coarse")), "tie").select(F.abs(F.col("prob") - F.col("coarse")).alias("d"))
    return both.agg(F.round(F.max("d"), 6).alias("max_diff"), F.round(F.avg("d"), 6).alias("mean_diff"), (F.max("d") <= 0.08).alias("ok"))
