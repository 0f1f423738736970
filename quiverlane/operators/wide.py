"""Attribute-value rows into one typed row per entity.

Cells are resolved by one aggregation per (entity, attribute) whose state is of fixed size, so an
entity or an attribute with a third of all rows is combined before the shuffle. Only resolved
cells, at most one per attribute of the catalog and entity, are gathered into the key-value map
that the typed columns are projected from. Cells that can't be settled stay in ``faults``.

Defined results: names are compared without outer blanks and in lower case and come out as in the
catalog; rows with other names, without an entity or without a name count for nothing. A cell
whose values are all null is empty and no fault. Texts lose their outer blanks first. Integers:
optional sign, ASCII digits, 64 bits. Floats: optional sign, ASCII digits with at most one point
and at least one digit, optional exponent. Booleans: true or false in any letter case. Strings:
every text. Of the readable values of a cell the one with the latest load counts, then the one of
the largest row number, then the greatest text (a time or number that is null comes first).
Attributes with many values give a sorted list of their distinct readable values, and no
conflict. An entity that has rows with known names but nothing readable still gets a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNREADABLE, CONFLICT = "unreadable", "conflict"

#: The column type of each kind of value.
TYPES = {"Integer": "bigint", "Float": "double", "Boolean": "boolean", "String": "string"}

INTEGER = r"^[+-]?[0-9]+\z"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: str
    is_multi: bool = False


def catalog_of(df: DataFrame) -> list[Attribute]:
    """The attributes of a ``prop_name, value_kind, is_multi`` table: the columns of the wide table, so few.

    Names that are equal when compared are one attribute; the first in alphabetical order holds.
    """
    found: dict[str, Attribute] = {}
    for r in sorted(df.select("prop_name", "value_kind", "is_multi").where("prop_name is not null").collect(), key=lambda r: r.prop_name):
        if r.value_kind not in TYPES:
            raise ValueError(f"{r.prop_name} is of an unknown kind, {r.value_kind}")
        found.setdefault(r.prop_name.strip(" ").lower(), Attribute(r.prop_name, r.value_kind, bool(r.is_multi)))
    return list(found.values())


def _one_of(attributes: Sequence[Attribute], value) -> Column:
    """Per row, ``value`` of the attribute that the row's name stands for; null for other names."""
    pairs = [F.lit(x) for a in attributes for x in (a.name.strip(" ").lower(), value(a))]
    return F.create_map(*pairs)[F.lower(F.trim("__name"))] if pairs else F.lit(None).cast("string")


def resolved_cells(props: DataFrame, attributes: Sequence[Attribute]) -> DataFrame:
    """One row per cell: ``node_id, attribute`` (its place among the attributes), ``value, fault, unread``.

    ``value`` is the text that stands for the typed value, the same for equal values. A
    multi-valued attribute has one row per distinct value, and one of a null value for the rest.
    The state of a cell has a fixed number of fields, so cells are combined before the shuffle.
    """
    rows = props.select(F.col("node_id"), F.col("prop_name").alias("__name"), F.trim("prop_text").alias("text"), F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"), F.col("row_no").cast("bigint").alias("row_no")).where("node_id is not null")
    places = {id(a): i for i, a in enumerate(attributes)}
    rows = rows.withColumn("attribute", _one_of(attributes, lambda a: places[id(a)]).cast("tinyint" if len(attributes) < 128 else "int")).where("attribute is not null").drop("__name")

    def of_kind(kind: str) -> Column:
        return F.col("attribute").isin([i for i, a in enumerate(attributes) if a.kind == kind])

    text, multi = F.col("text"), F.col("attribute").isin([i for i, a in enumerate(attributes) if a.is_multi])
    value = (
        F.when(of_kind("Integer"), F.when(text.rlike(INTEGER), F.expr("try_cast(text as bigint)").cast("string")))
        .when(of_kind("Float"), F.when(text.rlike(FLOAT), (F.expr("try_cast(text as double)") + F.lit(0.0)).cast("string")))
        .when(of_kind("Boolean"), F.when(F.lower(text).isin("true", "false"), F.lower(text)))
        .otherwise(text)
    )
    typed = rows.withColumn("value", value).withColumn("of_many", F.when(multi, F.col("value")))
    at = [F.col("loaded_at").alias("a"), F.col("row_no").alias("n")]
    cells = typed.groupBy("node_id", "attribute", "of_many").agg(
        F.max(F.when(F.col("value").isNotNull(), F.struct(*at, F.col("value").alias("v")))).alias("best"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        F.max(F.when(F.col("value").isNull() & text.isNotNull(), F.struct(*at, text.alias("v")))).alias("worst"),
    )
    fault = F.when(multi, F.lit(None)).when(F.col("best").isNull() & F.col("worst").isNotNull(), F.lit(UNREADABLE)).when(F.col("least") != F.col("most"), F.lit(CONFLICT))
    return cells.select("node_id", "attribute", F.col("best.v").alias("value"), fault.alias("fault"), F.col("worst.v").alias("unread"))


def entity_maps(props: DataFrame, attributes: Sequence[Attribute]) -> DataFrame:
    """``node_id, cells, many``: per entity the key-value map of its single-valued attributes, and
    the list of the values of the others."""
    cells = resolved_cells(props, attributes)
    multi = [i for i, a in enumerate(attributes) if a.is_multi]
    gathered = cells.groupBy("node_id").agg(F.collect_list(F.struct("attribute", "value", "fault", "unread")).alias("all"))
    single = F.filter("all", lambda c: ~c["attribute"].isin(multi))
    return gathered.select(
        "node_id",
        F.map_from_entries(F.transform(single, lambda c: F.struct(c["attribute"], F.struct(c["value"], c["fault"], c["unread"])))).alias("cells"),
        F.filter("all", lambda c: c["attribute"].isin(multi)).alias("many"),
    )


def wide_table(props: DataFrame, attributes: Sequence[Attribute]) -> DataFrame:
    """One row per entity: ``node_id``, a typed column per attribute, ``faults`` and ``unread``.

    ``faults`` maps an attribute to unreadable or conflict, ``unread`` to the latest text of it
    that couldn't be read. An attribute called like one of these columns is refused.
    """
    if clash := {a.name for a in attributes} & {"node_id", "faults", "unread"}:
        raise ValueError(f"attributes are called like columns of the wide table: {sorted(clash)}")

    def column(i: int, a: Attribute) -> Column:
        if a.is_multi:
            values = F.transform(F.filter("many", lambda c: (c["attribute"] == i) & c["value"].isNotNull()), lambda c: c["value"].cast(TYPES[a.kind]))
            return F.array_sort(values).alias(a.name)
        return F.col("cells")[F.lit(i)]["value"].cast(TYPES[a.kind]).alias(a.name)

    names = F.create_map(*[F.lit(x) for i, a in enumerate(attributes) for x in (i, a.name)])

    def kept(part: str) -> Column:
        held = F.map_filter("cells", lambda _, v: v[part].isNotNull())
        return F.transform_values(F.transform_keys(held, lambda k, _: names[k.cast("int")]), lambda _, v: v[part])

    columns = [column(i, a) for i, a in enumerate(attributes)]
    # all that couldn't be read of a multi-valued attribute is in its one entry without a value
    of_many = F.map_from_entries(F.transform(F.filter("many", lambda c: c["unread"].isNotNull()), lambda c: F.struct(names[c["attribute"].cast("int")], c["unread"])))
    unread = F.map_concat(kept("unread"), of_many)
    return entity_maps(props, attributes).select("node_id", *columns, kept("fault").alias("faults"), unread.alias("unread"))


def unsettled_cells(props: DataFrame, attributes: Sequence[Attribute]) -> DataFrame:
    """``node_id, prop_name, fault`` of the cells of the wide table that can't be settled."""
    return wide_table(props, attributes).select("node_id", F.explode("faults").alias("prop_name", "fault"))
