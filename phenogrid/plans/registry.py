"""All named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phenogrid.plans import evaluation, hexagons, ingest, prediction, preparation, spatial
from phenogrid.plans.tables import Tables

MODULES = (ingest, preparation, spatial, hexagons, evaluation, prediction)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: f(Tables(spark, sf_dir))

    return {name: bound(f) for module in MODULES for name, (f, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, (_, text) in module.QUERIES.items() if text}
