"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Names of the tables that a data directory may hold.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "graph_catalog shared_nodes nodes node_tombstones edges node_props prop_catalog mix_targets"
).split()


def table_path(directory: str, name: str) -> str:
    return f"{directory.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """A table of ``directory``; with ``columns``, only those, so that a scan reads nothing else."""
    df = spark.read.parquet(table_path(directory, name))
    return df.select(*columns) if columns else df
