"""Patterns over edges that arrive as a stream.

A graph whose nodes are tables and whose newest edges are a streaming DataFrame is queried like any
other: lowering only builds joins, filters and projections, which Structured Streaming runs as
stream-static joins without state. What needs all edges at once is refused.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlane.graph import ID, SOURCE, TARGET, EdgeFrame, PropertyGraph
from quiverlane.lang import values as V
from quiverlane.lang.errors import Internal
from quiverlane.lang.lowering import Reader
from quiverlane.lang.parser import parse
from quiverlane.lang.syntax import Match, Return, Unwind, With
from quiverlane.lang.usage import has_aggregate, uses


def with_streamed_edges(graph: PropertyGraph, label: str, stream: DataFrame, source: tuple[str, str], target: tuple[str, str], key: str) -> PropertyGraph:
    """The graph with edges of a stream: rows that refer to nodes by key, like a table of edges.

    References that lead nowhere give no match. All columns are properties, so an event time can
    be returned and windows or watermarks applied to the result.
    """
    s, t = graph._places[source[0]], graph._places[target[0]]
    ends = F.col(source[1]).isNotNull() & F.col(target[1]).isNotNull()
    identity = F.concat_ws(":", F.lit(len(graph.edges)), F.col(key))
    df = stream.where(ends).select(identity.alias(ID), F.col(source[1]).cast("bigint").alias(SOURCE), F.col(target[1]).cast("bigint").alias(TARGET), *[F.col(f"`{c}`") for c in stream.columns])
    types = {f.name: V.type_of(f.dataType) for f in stream.schema.fields}
    frame = EdgeFrame(df, (label,), types, sources=frozenset([s]), targets=frozenset([t]), complete=False, source_place=s, target_place=t)
    return replace(graph, edges=(*graph.edges, frame))


def stream_query(graph: PropertyGraph, text: str, parameters: Mapping[str, Any] | None = None) -> DataFrame:
    """The matches of a reading query as a streaming DataFrame.

    The query may match, unwind, filter and project; aggregates, sorting and limits belong to the
    result, where a window and a watermark can be named.
    """
    (statements,) = parse(text)
    spark = graph.nodes[0].df.sparkSession
    reader = Reader(spark, graph, parameters or {}, uses(statements))
    for s in statements:
        if isinstance(s, Match) and not s.optional:
            reader.match(s)
        elif isinstance(s, Unwind):
            reader.unwind(s)
        elif isinstance(s, (With, Return)):
            if any(has_aggregate(i.expression) for i in s.items) or s.modifiers.order or s.modifiers.skip or s.modifiers.limit:
                raise Internal["Unimplemented"]("aggregates, sorting and limits over a stream of matches")
            reader.project(s.star, s.items, s.where if isinstance(s, With) else None, s.modifiers)
        else:
            raise Internal["Unimplemented"](f"{type(s).__name__} over a stream of edges")
    return reader.result()
