"""From raw occurrence text to clean, typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenogrid.functions import calendar, names

RAW_COLUMNS = ("decimalLatitude", "decimalLongitude", "day", "month", "taxonKey", "verbatimScientificName", "class")
MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a")


def blank_to_null(c: Column) -> Column:
    return F.when(~F.trim(c).isin(*MISSING), c)


def drop_incomplete(raw: DataFrame, columns: tuple[str, ...] = RAW_COLUMNS) -> DataFrame:
    """Drops rows that lack one of the columns; blanks and the usual tokens for missing count as lacking."""
    # one higher-order test over all columns, which keeps the generated code of the stage small
    whole = F.forall(F.array(*columns), lambda c: c.isNotNull() & ~F.trim(c).isin(*MISSING))
    return raw.where(whole)


def clean(raw: DataFrame, taxonomy: DataFrame, classes: list[str] | None = None, decimals: int = 3) -> DataFrame:
    """Raw text rows to occurrences: latitude, longitude, taxonKey, names, week, class.

    Filters run before the taxonomy lookup.  The lookup is a plain join on
    the name, so Spark broadcasts the taxonomy only while it is small.
    """
    rows = drop_incomplete(raw)
    if classes:
        rows = rows.where(F.lower("class").isin([c.lower() for c in classes]))
    rows = rows.where(names.is_binomial(F.col("verbatimScientificName")))
    rows = rows.select(
        F.round(F.expr("try_cast(decimalLatitude as double)"), decimals).alias("latitude"),
        F.round(F.expr("try_cast(decimalLongitude as double)"), decimals).alias("longitude"),
        F.expr("try_cast(taxonKey as bigint)").alias("taxonKey"),
        "verbatimScientificName",
        calendar.week_of(F.expr("try_cast(day as int)"), F.expr("try_cast(month as int)")).alias("week"),
        "class",
    ).where("latitude is not null and longitude is not null and week is not null")
    known = taxonomy.select(F.col("sci_name").alias("verbatimScientificName"), "com_name").dropDuplicates(["verbatimScientificName"])
    joined = rows.join(known, "verbatimScientificName")
    return joined.select("latitude", "longitude", "taxonKey", "verbatimScientificName", names.or_self(F.col("com_name"), F.col("verbatimScientificName")).alias("commonName"), "week", "class")


def dedupe_taxonomy(taxonomy: DataFrame, key: str = "sci_name", order: str = "line_no") -> DataFrame:
    """One row per lower-cased name: the last one of the file."""
    rows = taxonomy.withColumn("name_key", names.key(F.col(key)))
    last = rows.groupBy("name_key").agg(F.max(order).alias(order))
    return rows.join(last, ["name_key", order], "left_semi")
