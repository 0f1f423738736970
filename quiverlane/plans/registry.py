"""All queries of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quiverlane.plans import graphs, records


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return graphs.QUERIES | records.QUERIES


def oracle_sql() -> dict[str, str]:
    return graphs.ORACLE | records.ORACLE


def flagship(spark: SparkSession, directory: str) -> DataFrame:
    """Orders and revenue per region."""
    return graphs.QUERIES["flagship"](spark, directory)
