"""Running totals and exact quantiles of a whole column, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 1024  # at most
RANGE_ROWS = 20_000  # fewer rows are not cut into ranges


def even_cuts(column: str, ranges: int) -> Column:
    """Aggregate: approximate quantiles that cut a column into ranges of about equal numbers of rows."""
    # one expression of text, as a thousand literals take seconds to hand over
    shares = ", ".join(f"{i / ranges!r}D" for i in range(1, ranges))
    return F.expr(f"percentile_approx({column}, array({shares}), {10 * ranges})")


def running_totals(df: DataFrame, head: str, order: list[str], values: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds totals of ``values`` up to and with each row of equal ``by``, in the order of the number ``head``, then ``order``.

    Rows are cut into ranges of ``head`` at approximate quantiles, as many as
    their number asks for; a row's total is that of the ranges below plus the
    running total in its own.  So a group with most of the rows is spread
    over as many tasks as there are ranges, of which there are a thousand at
    most.  Rows of one ``head`` are in one range.
    """
    cuts = df.agg(even_cuts(head, RANGES).alias("_every"), F.count("*").alias("_rows"))
    # of all cuts every one in so many, or none
    cuts = cuts.select(F.expr(f"filter(_every, (c, i) -> (i + 1) % greatest(1, cast({RANGES * RANGE_ROWS} div greatest(_rows, 1) as int)) = 0)").alias("_cuts"))
    rows = df.crossJoin(F.broadcast(cuts)).withColumn("_range", F.expr(f"coalesce(size(filter(_cuts, c -> c <= {head})), 0)")).drop("_cuts")
    inside = Window.partitionBy(*by, "_range").orderBy(head, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    group = {c: f"_of_{c}" for c in [*by, "_range"]}
    sums = rows.groupBy(*by, "_range").agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in values.items()])
    sums = sums.select(*[F.col(c).alias(g) for c, g in group.items()], *[F.coalesce(F.sum(f"_sum_{n}").over(below), F.lit(0)).alias(f"_below_{n}") for n in values])
    same = None
    for c, g in group.items():
        same = F.col(c).eqNullSafe(F.col(g)) if same is None else same & F.col(c).eqNullSafe(F.col(g))
    # without groups there is a row for each range
    found = rows.withColumns({f"_in_{n}": F.sum(v).over(inside) for n, v in values.items()}).join(sums if by else F.broadcast(sums), same)
    return found.select(*df.columns, *[(F.col(f"_below_{n}") + F.col(f"_in_{n}")).alias(n) for n in values])


def running_total(df: DataFrame, head: str, order: list[str], value: str, name: str = "upto") -> DataFrame:
    """Adds the total of one column over the whole table."""
    return running_totals(df, head, order, {name: F.col(value)})


def text_ranks(df: DataFrame, column: str, name: str, width: int = 6) -> DataFrame:
    """Adds each row's place, from 1, in the order of a column of distinct texts.

    Texts are counted by their first characters; a place is the count of all
    lower beginnings plus the place among texts of the same one.  Beginnings
    alone are put in order in one task.
    """
    rows = df.withColumn("_head", F.substring(column, 1, width))
    heads = rows.groupBy(F.col("_head").alias("_of")).agg(F.count("*").alias("_n"))
    heads = heads.select("_of", F.coalesce(F.sum("_n").over(Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"))
    placed = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_head").orderBy(column))).join(heads, F.col("_head").eqNullSafe(F.col("_of")))
    return placed.select(*df.columns, (F.col("_below") + F.col("_at")).alias(name))


def quantiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: the interpolated quantile of the non-null values for each named share; null without any.

    Equal values are counted before anything is ordered.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    upto = running_total(counts, "_v", [], "_n").crossJoin(F.broadcast(counts.agg((F.sum("_n") - 1).alias("_last"))))
    ends = []
    for name, q in shares.items():
        at = F.col("_last") * F.lit(q)
        ends += [F.min(F.when(F.col("upto") > F.floor(at), F.col("_v"))).alias(f"{name}_lo"), F.min(F.when(F.col("upto") > F.ceil(at), F.col("_v"))).alias(f"{name}_hi"), F.max(at - F.floor(at)).alias(f"{name}_at")]
    out = upto.agg(*ends)
    return out.select(*[(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_at")).alias(n) for n in shares])
