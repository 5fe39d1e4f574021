"""Species lists from predictions in long form: lat, lon, week, idx, prob."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phenogrid.operators.stored import stored


def best(predictions: DataFrame, threshold: float, k: int, tie: str = "idx") -> DataFrame:
    """Rows of at least ``threshold``, then the k most probable; ties by index."""
    return predictions.where(F.col("prob") >= threshold).orderBy(F.desc("prob"), tie).limit(k)


def best_each(predictions: DataFrame, threshold: float, k: int, by: list[str], tie: str = "idx") -> DataFrame:
    """Of each place, rows of at least ``threshold``, then the k most probable; ties by index."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("prob"), tie))
    return predictions.where(F.col("prob") >= threshold).withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def yearly_max(predictions: DataFrame, by: list[str]) -> DataFrame:
    return predictions.where(F.col("week").between(1, 48)).groupBy(*by).agg(F.max("prob").alias("prob"))


def richness(predictions: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    return predictions.groupBy(*by).agg(F.count_if(F.col("prob") >= threshold).alias("n_species"))


def over_maximum(df: DataFrame, value: str, floor: float = 0.0) -> DataFrame:
    """Adds the column's global maximum (at least ``floor``), as one broadcast row."""
    return df.crossJoin(F.broadcast(df.agg(F.greatest(F.max(value), F.lit(floor)).alias("max_value"))))


def region_scores(points: DataFrame) -> DataFrame:
    """Mean probability of each species over a region's points and weeks."""
    return points.groupBy("region_id", "name", "idx").agg(F.avg("prob").alias("score"))


def region_ranks(scores: DataFrame) -> DataFrame:
    """Rank within region, apart for birds and others."""
    w = Window.partitionBy("region_id", "is_bird").orderBy(F.desc("score"), "idx")
    return scores.withColumn("rank", F.row_number().over(w))


def round_robin(ranked: DataFrame, target: int, birds: int = 4, others: int = 1) -> DataFrame:
    """Picks species region by region: up to ``birds`` new birds, then ``others`` new others, round after round.

    Choosing is sequential, as a pick bars the species everywhere.  A queue
    never gives more than ``target`` picks and never skips more species than
    were taken before, so only its first ``target`` ranks can be chosen: the
    driver sees two queues of so many rows a region, however many species
    there are.
    """
    found = ranked.where(F.col("rank") <= target).select("region_id", "is_bird", "rank", "idx").collect()
    queues: dict[tuple[int, bool], list] = {}
    for r in sorted(found, key=lambda r: (r["region_id"], r["rank"])):
        queues.setdefault((r["region_id"], r["is_bird"]), []).append(r["idx"])
    regions = sorted({region for region, _ in queues})
    streams = {k: iter(v) for k, v in queues.items()}
    taken, order = set(), []
    while len(order) < target:
        before = len(order)
        for region in regions:
            for is_bird, quota in ((True, birds), (False, others)):
                for idx in streams.get((region, is_bird), iter(())):
                    if idx in taken:
                        continue
                    taken.add(idx)
                    order.append((len(order) + 1, region, idx))
                    quota -= 1
                    if not quota or len(order) == target:
                        break
                if len(order) == target:
                    break
            if len(order) == target:
                break
        if len(order) == before:
            break
    return ranked.sparkSession.createDataFrame(order, "pick int, region_id int, idx int")


def region_coverage(scores: DataFrame, selected: DataFrame, present_above: float = 0.01) -> DataFrame:
    """Species present in each region, and how many of them were selected."""
    present = scores.where(F.col("score") > present_above)
    marked = present.join(selected.select("idx").distinct().withColumn("sel", F.lit(1)), "idx", "left")
    return marked.groupBy("name").agg(F.count("*").alias("n_present"), F.count("sel").alias("n_selected")).withColumn("pct", 100.0 * F.col("n_selected") / F.col("n_present"))


def search(labels: DataFrame, text: str, most: int = 30) -> DataFrame:
    """Labels with the text in code, scientific or common name, in index order; names ignore case."""
    low = text.lower()
    hit = F.col("code").contains(low) | F.lower("sci").contains(low) | F.lower("com").contains(low)
    return labels.where(hit).orderBy("idx").limit(most)


NAMES = ("code", "sci", "com")
GRAM = 3


def _grams(text, sizes: str):
    """Distinct runs of characters of a text, of the sizes that an SQL array gives."""
    return F.expr(f"array_distinct(flatten(transform({sizes}, n -> transform(sequence(1, length({text}) - n + 1), i -> substring({text}, i, n)))))")


def name_index(labels: DataFrame) -> DataFrame:
    """``gram, idx``: runs of up to three characters of each label's names, and one empty run; a table worth keeping for many searches."""
    names = labels.select("idx", F.explode(F.array(*[F.lower(c) for c in NAMES])).alias("name")).where("name is not null")
    sizes = f"filter(sequence(1, {GRAM}), n -> n <= length(name))"
    grams = F.array_union(F.array(F.lit("")), _grams("name", sizes))
    return names.select("idx", F.explode(grams).alias("gram")).distinct()


def matches(labels: DataFrame, asked: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``query`` and label columns of the labels that hold each distinct asked text in code, scientific or common name.

    Of a text's runs of three characters (the text itself, if it is shorter)
    the one that the fewest labels have leads to the candidates, which are
    then tested whole.  Texts are trimmed, and case does not count.
    """
    index = name_index(labels) if index is None else index
    texts = asked.select("query").distinct().withColumn("_q", F.lower(F.trim("query")))
    sizes = f"array(least({GRAM}, length(_q)))"
    grams = texts.withColumn("gram", F.explode(F.when(F.length("_q") > 0, _grams("_q", sizes)).otherwise(F.array(F.lit("")))))
    held = grams.join(index.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    rarest = held.groupBy("query", "_q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")).select("query", "_q", "m.gram")
    q = F.col("_q")
    found = rarest.join(index, "gram").join(labels, "idx")
    return found.where(F.lower("code").contains(q) | F.lower("sci").contains(q) | F.lower("com").contains(q))


def resolve(labels: DataFrame, asked: DataFrame, exact_first: bool, index: DataFrame | None = None) -> DataFrame:
    """The label that each asked name means: exact matches first if wanted, then substrings, by index."""
    q = F.col("_q")
    exact = ((F.lower("code") == q) | (F.lower("sci") == q) | (F.lower("com") == q)).cast("int")
    order = F.struct((-exact if exact_first else F.lit(0)).alias("e"), "idx", "code")
    return matches(labels, asked, index).groupBy("query").agg(F.min(order).alias("m")).select("query", F.col("m.idx").alias("idx"), F.col("m.code").alias("code"))


def resolve_each(labels: DataFrame, asked: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``turn, query, idx, code``: each question takes, in turn, its first match that no earlier one took; those left without are not listed.

    Goes in rounds: every question asks for the first label that has not
    turned it down, and a label keeps the earliest that asks for it.  This
    ends with what taking turns gives.  A question that is the j-th of its
    text starts at the text's j-th match, as the ones before it take as many.
    """
    ahead = Window.partitionBy("query").orderBy("turn")
    first = Window.partitionBy("query").orderBy("idx")
    # no question is turned down by more labels than there are questions before it
    most = asked.count()
    ways = stored(matches(labels, asked, index).select("query", "idx", "code", F.row_number().over(first).alias("place")).where(F.col("place") <= most))
    state = stored(asked.select("turn", "query", F.row_number().over(ahead).alias("place")))
    while True:
        tried = state.join(ways, ["query", "place"])
        kept = tried.groupBy("idx").agg(F.min("turn").alias("_kept"))
        judged = stored(tried.join(kept, "idx"))
        if judged.where("turn != _kept").isEmpty():
            return judged.select("turn", "query", "idx", "code")
        state = judged.select("turn", "query", (F.col("place") + (F.col("turn") != F.col("_kept")).cast("int")).alias("place"))
