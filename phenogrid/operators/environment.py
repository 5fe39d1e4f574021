"""Environment columns of cells: zonal statistics, filling, scaling, one-hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.operators.nearest import k_nearest
from phenogrid.operators.totals import quantiles


def mode_of(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Most frequent value of each group; ties go to the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), value)).alias("m")).select(*keys, F.col(f"m.{value}").alias(name))


def zonal(pixels: DataFrame, cell: str = "cell", value: str = "value", category: str = "category") -> DataFrame:
    """Mean of a value and mode of a category over the pixels of each cell."""
    mean = pixels.groupBy(cell).agg(F.avg(value).alias("mean_value"))
    return mean.join(mode_of(pixels, [cell], category, "mode_category"), cell, "left")


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation of each column, with 1 for a zero deviation."""
    aggs = []
    for c in columns:
        sd = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{c}_mean"), F.when((sd == 0) | sd.isNull(), 1.0).otherwise(sd).alias(f"{c}_sd")]
    return df.agg(*aggs)


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scales columns by the whole table's statistics; nulls stay null.  The statistics are one row."""
    stats = column_stats(df, columns)
    return df.crossJoin(F.broadcast(stats)).withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_sd") for c in columns}).drop(*stats.columns)


def one_hot(df: DataFrame, column: str, categories: list) -> DataFrame:
    """A 0/1 column for each category in order; a null value has only zeros."""
    return df.withColumns({f"{column}_{c}": F.coalesce((F.col(column) == c).cast("int"), F.lit(0)) for c in categories}).drop(column)


def normalise(df: DataFrame, continuous: list[str], fractions: list[str], categorical: str, categories: list) -> DataFrame:
    """The model's features: one-hot classes, fractions with null as 0, scaled continuous columns."""
    out = zscore(df, continuous).withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in fractions})
    return one_hot(out, categorical, categories)


def nearest_filled(cells: DataFrame, fill: list[str], columns: list[str], k: int = 3, cell: str = "cell", kind: str = "double") -> DataFrame:
    """For each of the columns ``fill`` and each cell that lacks it beside another of ``columns``, the ``k`` nearest cells that have it.

    Distances are straight ones in degrees of latitude and longitude, as the
    fill is meant for neighbours on a grid; ties go to the smaller cell.
    Cells without any value are left alone.  Columns: ``filled``, the cell,
    ``near``, its ``value`` cast to ``kind``, ``dist``, ``rn``.
    """
    some = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull().alias("some")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("filled"), F.col(c).cast(kind).alias("value")) for c in fill])).alias("e")
    rows = cells.select(cell, "lat", "lon", some, each).select(cell, "lat", "lon", "some", "e.filled", "e.value")
    lacking = rows.where("value is null and some").select("filled", cell, "lat", "lon")
    having = rows.where("value is not null").select("filled", F.col(cell).alias("near"), "lat", "lon", "value")
    return k_nearest(lacking, having, ["filled"], [cell], ["lat", "lon"], "near", k).select("filled", cell, "near", "value", "dist", "rn")


def impute(cells: DataFrame, numeric: list[str], categorical: list[str], k: int = 3, cell: str = "cell") -> DataFrame:
    """Fills each column where it is missing beside other values: the mean of its ``k`` nearest, or their mode."""
    columns = numeric + categorical
    # one search for all columns: values go as text, which gives doubles back unchanged
    found = nearest_filled(cells, columns, columns, k, cell, "string").groupBy("filled", cell).agg(F.collect_list("value").alias("values"))
    # ties of a mode go to the smallest value in the columns' own order, where they have one type
    kinds = {cells.schema[c].dataType.simpleString() for c in categorical}
    kind = kinds.pop() if len(kinds) == 1 else "string"
    mean = F.expr("aggregate(values, 0D, (total, v) -> total + cast(v as double)) / size(values)")
    mode = F.expr(f"array_min(transform(array_distinct(values), x -> struct(-size(filter(values, y -> y = x)) as n, cast(x as {kind}) as value))).value")
    found = found.select("filled", cell, *([F.when(F.col("filled").isin(numeric), mean).alias("mean")] if numeric else []), *([F.when(F.col("filled").isin(categorical), mode).alias("mode")] if categorical else []))
    fills = [F.max(F.when(F.col("filled") == c, F.col("mean" if c in numeric else "mode"))).cast(cells.schema[c].dataType).alias(f"_fill_{c}") for c in columns]
    out = cells.join(found.groupBy(cell).agg(*fills), cell, "left")
    return out.withColumns({c: F.coalesce(c, f"_fill_{c}") for c in columns}).select(*cells.columns)


def robust_range(df: DataFrame, column: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Quantile range of a column; zeros are left out where they are more than half of it."""
    c = F.col(column)
    shares = {"lo": low, "hi": high}
    every = quantiles(df, column, shares)
    other = quantiles(df.where(c != 0), column, shares).toDF("other_lo", "other_hi")
    counts = df.agg(F.count_if(c == 0).alias("zeros"), F.count(c).alias("n"))
    sparse = (F.col("zeros") * 2 > F.col("n")) & (F.col("n") > F.col("zeros"))
    out = counts.crossJoin(F.broadcast(every)).crossJoin(F.broadcast(other))
    out = out.select(F.when(sparse, F.col("other_lo")).otherwise(F.col("lo")).alias("vmin"), F.when(sparse, F.col("other_hi")).otherwise(F.col("hi")).alias("vmax"))
    same = F.col("vmin") == F.col("vmax")
    return out.select(F.when(same, F.col("vmin") - 1e-6).otherwise(F.col("vmin")).alias("vmin"), F.when(same, F.col("vmax") + 1e-6).otherwise(F.col("vmax")).alias("vmax"))


def drop_all_null(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value; looks at the table once."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c]])
