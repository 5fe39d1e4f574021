"""Species of cells and weeks: long and list form, vocabulary, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenogrid.functions.calendar import WEEKS
from phenogrid.operators.totals import running_total


def species_sets(occurrence: DataFrame, cell: str = "cell", week: str = "week", species: str = "species") -> DataFrame:
    """Sorted distinct species of each cell and week.  Sets are built partly before the shuffle."""
    return occurrence.where(F.col(week).between(1, WEEKS)).groupBy(cell, week).agg(F.array_sort(F.collect_set(species)).alias(species))


def with_yearly(sets: DataFrame, cell: str = "cell", week: str = "week", species: str = "species") -> DataFrame:
    """Adds week 0: the union of a cell's weeks."""
    yearly = sets.groupBy(cell).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(species)))).alias(species))
    return sets.unionByName(yearly.withColumn(week, F.lit(0).cast(sets.schema[week].dataType)))


def wide_weeks(sets: DataFrame, cells: DataFrame, cell: str = "cell") -> DataFrame:
    """One row per cell with a list column for each week; cells without any keep empty lists."""
    wide = sets.groupBy(cell).pivot("week", list(range(1, WEEKS + 1))).agg(F.first("species"))
    wide = wide.select(cell, *[F.col(str(w)).alias(f"week_{w}") for w in range(1, WEEKS + 1)])
    empty = F.array().cast("array<string>")
    return cells.join(wide, cell, "left").select(*cells.columns, *[F.coalesce(f"week_{w}", empty).alias(f"week_{w}") for w in range(1, WEEKS + 1)])


def long_weeks(wide: DataFrame, keep: list[str]) -> DataFrame:
    """Back from list columns to one row per cell and week; empty lists stay."""
    lists = F.array(*[f"week_{w}" for w in range(1, WEEKS + 1)])
    return wide.select(*keep, F.posexplode(lists).alias("place", "species")).select(*keep, (F.col("place") + 1).alias("week"), "species")


def vocabulary(presence: DataFrame, species: str = "species") -> DataFrame:
    """Species with the index of their rank by code.  Only the distinct codes are sorted."""
    return presence.select(species).distinct().withColumn("idx", (F.row_number().over(Window.orderBy(species)) - 1).cast("int"))


def frequent(presence: DataFrame, least: int, species: str = "species") -> DataFrame:
    counts = presence.groupBy(species).agg(F.count("*").alias("n_obs"))
    return counts.where(F.col("n_obs") >= least)


def encode(presence: DataFrame, vocab: DataFrame, species: str = "species") -> DataFrame:
    """Indices in place of codes; codes outside the vocabulary go."""
    return presence.join(vocab, species).drop(species)


def taxon_metadata(occurrence: DataFrame) -> DataFrame:
    """One name, key and class for each species: those of the row that sorts first."""
    return occurrence.groupBy("species").agg(F.min(F.struct("name", "taxon_key", "class")).alias("m")).select("species", "m.*")


def observation_density(sets: DataFrame, cell: str = "cell") -> DataFrame:
    """All list lengths of a cell added up, on each of its rows."""
    total = sets.groupBy(cell).agg(F.sum(F.size("species")).cast("long").alias("obs_density"))
    return sets.join(total, cell)


def csr_offsets(sets: DataFrame, order: list[str]) -> DataFrame:
    """Where each row's values begin and end in the packed array of all rows.

    Running totals go over cells first (one total each, by ranges of cells),
    then within a cell.  The first column of the order is a number.
    """
    n = sets.withColumn("n_values", F.size("species").cast("long"))
    head = order[0]
    per = n.groupBy(head).agg(F.sum("n_values").alias("total"))
    before = running_total(per, head, [], "total").select(head, (F.col("upto") - F.col("total")).alias("before"))
    inside = F.sum("n_values").over(Window.partitionBy(head).orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = n.withColumn("inside", inside).join(before, head)
    return rows.select(*order, (F.col("before") + F.col("inside") - F.col("n_values")).cast("long").alias("start_offset"), (F.col("before") + F.col("inside")).cast("long").alias("end_offset"))


def diff(before: DataFrame, after: DataFrame, on: list[str]) -> DataFrame:
    """What was added to each row's list, and what stayed."""
    both = before.withColumnRenamed("species", "was").join(after.withColumnRenamed("species", "now"), on)
    return both.select(*on, F.array_sort(F.array_except("now", "was")).alias("added"), F.array_sort(F.array_intersect("was", "now")).alias("kept"))
