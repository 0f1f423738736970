"""The tables of a graph store as property graphs: labels and properties are JSON text there.

Nodes and edges may stand in several rows that differ in the time of loading only; each is one.
Labels are the strings of a JSON array, or the pieces of ``:A:B``; any other text holds none.
Properties are all members of the JSON map, by the names and types that occur in any row; a map that
is wrapped in a JSON string is read like any other, a text that isn't a map gives none. A property
whose type differs from row to row is tagged if all its values are scalars and a variant otherwise.

A node is deleted if its latest deletion is at or after its latest load; a later load brings it
back. Deleted nodes match nothing. Edges without both ends, and edges that lead to nodes that don't
exist, were deleted or belong to another graph, match nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import lru_cache, partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quiverlane.graph import ID, LABELS, SOURCE, TARGET, EdgeFrame, NodeFrame, PropertyGraph
from quiverlane.lang import values as V
from quiverlane.sources.tables import read_table

#: The graph of the nodes and edges that name none.
DEFAULT = "default"


def label_array(text: Column) -> Column:
    """The labels of a text in order, repeated as they stand."""
    pieces = F.filter(F.split(text, ":"), lambda x: x != "")
    members = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    strings = F.transform(F.filter(members, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    return F.coalesce(F.when(text.startswith(":"), pieces).otherwise(strings), F.array().cast("array<string>"))


def _unwrapped(text: str) -> Column:
    """The JSON value of a text; a string that holds one is that value."""
    document = F.try_parse_json(text)
    return F.when(F.schema_of_variant(document) == "STRING", F.try_parse_json(F.try_variant_get(document, "$", "string"))).otherwise(document)


def _found(rows: DataFrame) -> dict[str, V.Type]:
    """The names of all rows' properties with the types that hold all their values."""
    documents = rows.select(_unwrapped("properties").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    schema = documents.agg(F.schema_of_variant_agg("v")).first()[0]
    # what is in backticks is a name
    parts = re.split(r"(`(?:[^`]|``)*`)", schema)
    parts[::2] = [re.sub(r"\bOBJECT<", "struct<", p) for p in parts[::2]]
    struct = S.DataType.fromDDL("".join(parts))
    if not isinstance(struct, S.StructType):
        return {}
    mixed = [f.name for f in struct.fields if isinstance(f.dataType, S.VariantType)]
    kinds = {}
    if mixed:
        kind = lambda n: F.regexp_extract(F.schema_of_variant(V.in_variant(F.col("v"), n, V.VARIANT)), r"^\w+", 0)
        kinds = documents.agg(*[F.collect_set(kind(n)).alias(str(i)) for i, n in enumerate(mixed)]).first()
    types = {}
    for f in struct.fields:
        if f.name in mixed:
            types[f.name] = V.VARIANT if {"OBJECT", "ARRAY"} & set(kinds[mixed.index(f.name)]) else V.ANY
        elif not isinstance(f.dataType, S.NullType):
            types[f.name] = V.type_of(_without_void(f.dataType))
    return types


def _without_void(t: S.DataType) -> S.DataType:
    """A list or member that is empty or null in all rows may have any type."""
    if isinstance(t, S.ArrayType):
        return S.ArrayType(_without_void(t.elementType))
    if isinstance(t, S.StructType):
        return S.StructType([S.StructField(f.name, _without_void(f.dataType)) for f in t.fields])
    return S.StringType() if isinstance(t, S.NullType) else t


def _read(types: Mapping[str, V.Type]) -> list[Column]:
    """The property columns; those that a query doesn't use are pruned and so never extracted."""
    document = _unwrapped("__text")

    def member(name: str, t: V.Type) -> Column:
        if t == V.ANY:
            return V.tagged(V.in_variant(document, name, V.VARIANT), V.VARIANT)
        return V.in_variant(document, name, t)

    return [member(n, t).alias(n) for n, t in types.items()]


def _once(df: DataFrame, columns: Mapping[str, str], *more: Column) -> DataFrame:
    """One row per id. Copies agree but for the time, so any row will do, and unused columns are pruned."""
    return df.where("id is not null").groupBy("id").agg(*[F.first(c, ignorenulls=True).alias(a) for a, c in columns.items()], *more)


@lru_cache(maxsize=4)
def property_types(spark: SparkSession, directory: str) -> tuple[dict[str, V.Type], dict[str, V.Type]]:
    """The names and types of the properties of nodes and of edges, as all rows have them.

    A pass over the column of properties, like reading JSON files without a schema; its result is one
    type. A session does it once per directory.
    """
    nodes = read_table(spark, directory, "nodes", "properties").unionByName(read_table(spark, directory, "shared_nodes", "properties"))
    return _found(nodes), _found(read_table(spark, directory, "edges", "properties"))


@lru_cache(maxsize=4)
def store_graph(spark: SparkSession, directory: str) -> PropertyGraph:
    """All graphs of the store as one."""
    return _graph(spark, directory, None)


@lru_cache(maxsize=4)
def store_graphs(spark: SparkSession, directory: str) -> dict[str, Callable[[], PropertyGraph]]:
    """The graphs of the store by the names of its catalog, for ``connect(spark, graphs=...)``, which
    opens those that queries use. What is read here is the catalog's list of names.

    Shared nodes are in every graph. Nodes and edges without the name of a graph are in ``default``.
    """
    names = {r.graph_name for r in read_table(spark, directory, "graph_catalog", "graph_name").where("graph_name is not null").collect()}
    return {n: partial(_graph, spark, directory, n) for n in sorted(names | {DEFAULT})}


@lru_cache(maxsize=64)
def _graph(spark: SparkSession, directory: str, name: str | None) -> PropertyGraph:
    of_nodes, of_edges = property_types(spark, directory)

    def table(source: str, *columns: str) -> DataFrame:
        if name is None or source == "shared_nodes":
            return read_table(spark, directory, source, *columns)
        # all copies of a row are in one graph, so the scan may leave out the others
        own = (F.col("graph_name") == name) | (F.lit(name == DEFAULT) & F.col("graph_name").isNull())
        return read_table(spark, directory, source, "graph_name", *columns).where(own).drop("graph_name")

    columns = ["id", "labels", "properties", "loaded_at"]
    rows = table("nodes", *columns).unionByName(table("shared_nodes", *columns))
    once = _once(rows, {"__labels_text": "labels", "__text": "properties"}, F.max("loaded_at").alias("__loaded"))
    deaths = read_table(spark, directory, "node_tombstones", "node_id", "deleted_at").where("node_id is not null").groupBy("node_id").agg(F.max("deleted_at").alias("__deleted"))
    alive = once.join(deaths, (F.col("id") == F.col("node_id")) & (F.col("__deleted") >= F.col("__loaded")), "left_anti")
    nodes = alive.select(F.col("id").alias(ID), label_array(F.col("__labels_text")).alias(LABELS), *_read(of_nodes))
    edges = _once(table("edges", "id", "labels", "properties", "left_id", "right_id"), {SOURCE: "left_id", TARGET: "right_id", "__labels_text": "labels", "__text": "properties"})
    edges = edges.where(F.col(SOURCE).isNotNull() & F.col(TARGET).isNotNull()).select(F.col("id").cast("string").alias(ID), SOURCE, TARGET, label_array(F.col("__labels_text")).alias(LABELS), *_read(of_edges))
    one = frozenset([0])
    return PropertyGraph((NodeFrame(nodes, None, dict(of_nodes), place=0),), (EdgeFrame(edges, None, dict(of_edges), sources=one, targets=one, complete=False, source_place=0, target_place=0),))
