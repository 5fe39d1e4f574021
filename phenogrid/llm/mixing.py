"""Temperature mixing of sources, with DataFrame expressions only.

A source with share s of the tokens gets weight s**a / sum(s**a).  The
exponent a, from 0 (all sources alike) to 1 (as they come), is found by
bisection for a target: an entropy of the weights, or a limit on how often
the most repeated source may recur.  Each source's token budget is then
filled by whole epochs of its documents and a part of one more, every epoch
a fresh permutation of hashed blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.llm.common import checkpointed

GRID = 16  # a step of the search cuts the interval into so many
STEPS = 8
ROWS_PER_BLOCK = 1024


def token_count(text: Column) -> Column:
    """Words of a text, at least 1 for a text that has any character, 0 for null or empty."""
    words = F.size(F.filter(F.split(text, " "), lambda w: w != ""))
    return F.when(F.length(text) > 0, F.greatest(words, F.lit(1))).otherwise(0).cast("long")


def find_exponent(shares: DataFrame, entropy: float | None = None, max_repeats: float | None = None) -> float:
    """The exponent in [0, 1] that meets a target for ``source, tokens``.

    ``entropy`` (nats): the largest exponent whose weights have at least that
    entropy.  ``max_repeats``: the smallest exponent at which, with every
    source seen at least once, none is seen more often than that.  An
    unreachable target gives the nearer end.  Each step tests a grid of
    exponents in one aggregation, so the sources stay on the executors.
    """
    total, largest, smallest = shares.where("tokens > 0").agg(F.sum("tokens"), F.max("tokens"), F.min("tokens")).first()
    if not total or largest == smallest:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        if max_repeats is not None:
            # repeats of a source go as its share to the power a - 1
            good = [(float(largest) / float(smallest)) ** (1 - a) <= max_repeats for a in grid]
            at = good.index(True) if any(good) else GRID
            low, high = grid[max(0, at - 1)], grid[at]
        else:
            share = F.col("tokens") / F.lit(float(total))
            parts = shares.where("tokens > 0").agg(*[f(F.pow(share, F.lit(a)), share, a) for a in grid for f in (lambda p, s, a: F.sum(p), lambda p, s, a: F.sum(p * F.lit(a) * F.ln(s)))]).first()
            # entropy of p / z is ln z - sum(p ln p) / z
            bends = [_entropy(parts[2 * i], parts[2 * i + 1]) for i in range(GRID + 1)]
            good = [h >= entropy for h in bends]
            at = max((i for i, g in enumerate(good) if g), default=0)
            low, high = grid[at], grid[min(GRID, at + 1)]
    return high if max_repeats is not None else low


def _entropy(z: float, weighted: float) -> float:
    import math

    return math.log(z) - weighted / z


def mix(docs: DataFrame, entropy: float | None = None, max_repeats: float | None = 2.0, budget: int | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture's rows: doc_id, source, tokens, weight, epoch, block, place.

    ``budget`` is the mixture's number of tokens; without one it is the least
    at which every source is used whole at least once, so no document is
    lost.  A source's documents come in epochs from 0; each epoch orders
    them by hash, in blocks, and is cut where the running total of tokens
    before a document reaches what is left of the source's budget.  ``place``
    is the document's running token total within its source.  A null source
    is a source of its own; documents without tokens belong to epoch 0 and
    cost nothing.  Repeated rows count and come out each for itself.  Only
    narrow rows are shuffled; running totals add block totals to sums within
    blocks, so no task holds a source's documents; its block totals, one
    number for ``ROWS_PER_BLOCK`` documents, are summed in one task.  Texts
    may be of any length; other columns are not read, whatever their names;
    an empty table gives an empty one.
    """
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), token_count(docs[text_col]).alias("tokens"))
    narrow = checkpointed(narrow.withColumn("part", F.spark_partition_id()))
    shares = checkpointed(narrow.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    exponent = find_exponent(shares, entropy, max_repeats)
    total = shares.agg(F.sum("tokens")).first()[0] or 0
    raw = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(exponent))).otherwise(0.0)
    powered = shares.withColumn("power", raw)
    z = powered.agg(F.sum("power")).first()[0] or 1.0
    weighed = powered.withColumn("weight", F.col("power") / F.lit(float(z))).drop("power")
    if budget is None:
        budget = weighed.where("weight > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0
    plan = weighed.select(
        F.col("source").alias("s"), "weight", F.col("tokens").alias("whole"),
        F.greatest(F.lit(1), F.ceil(F.col("rows") / ROWS_PER_BLOCK)).alias("blocks"),
        # a hair of rounding must not cost the last document of a full epoch
        F.ceil(F.col("weight") * F.lit(float(budget)) - 1e-3).cast("long").alias("quota"),
    )
    rows = narrow.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    epochs = F.greatest(F.lit(1), F.ceil(F.when(F.col("whole") > 0, F.col("quota") / F.col("whole")).otherwise(1))).cast("int")
    rows = rows.withColumn("epoch", F.explode(F.when((F.col("tokens") > 0), F.sequence(F.lit(0), epochs - 1)).otherwise(F.array(F.lit(0)))))
    key = F.xxhash64("doc_id", "part", "epoch", F.lit(seed))
    rows = rows.withColumn("draw", key).withColumn("block", F.pmod(key, F.col("blocks")))
    sums = rows.groupBy("source", "epoch", "block").agg(F.sum("tokens").alias("t"))
    before = sums.selectExpr("source as s", "epoch as e", "block as b", "sum(t) over (partition by source order by epoch, block) - t as before")
    within = rows.selectExpr("*", "sum(tokens) over (partition by source, epoch, block order by draw, doc_id, tokens rows between unbounded preceding and current row) - tokens as inside")
    placed = within.join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("block") == F.col("b")))
    placed = placed.withColumn("place", F.col("before") + F.col("inside"))
    return placed.where("place < quota or tokens = 0").select("doc_id", "source", "tokens", "weight", "epoch", "block", "place")
