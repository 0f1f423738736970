"""Aggregates that queries may call: partial and final states are Spark's own."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiverlane.lang import values as V
from quiverlane.lang.errors import compile_error, run_error
from quiverlane.lang.values import FLOAT, INT, NULL, Value

#: The names of the aggregates.
AGGREGATES = ("count", "sum", "avg", "min", "max", "collect")


def aggregate(name: str, args: list[Value]) -> Value:
    """The aggregate of one argument. All but ``collect`` skip nulls."""
    if len(args) != 1:
        raise compile_error("InvalidNumberOfArguments", f"{name} got {len(args)} expected 1")
    v = args[0] if name in ("count", "collect") else V.settled(args[0])
    kind = v.type.kind
    if name == "count":
        return Value(INT, F.count(V.identity(v) if kind in ("node", "edge", "path") else v.column))
    if name == "collect":
        if kind == "null":
            return Value(V.list_of(NULL), F.transform(F.collect_list(F.lit(0)), lambda _: F.lit(None)))
        return Value(V.list_of(v.type), F.transform(F.collect_list(F.struct(V.as_column(v).alias("e"))), lambda x: x["e"]))
    if kind == "null":
        return Value(NULL, F.first(F.lit(None)))
    if name in ("min", "max"):
        return Value(v.type, (F.min if name == "min" else F.max)(V.as_column(v)))
    if kind not in V.NUMBERS:
        raise run_error("InvalidBinaryOperands", f"{name} of {v.type}")
    if kind == "any":
        d, i = v.column["d"], v.column["i"]
        if name == "avg":
            return Value(FLOAT, F.avg(d))
        whole = V.tagged(F.sum(i), INT)
        return Value(V.ANY, F.when(F.count(i) == F.count(d), whole).otherwise(V.tagged(F.sum(d), FLOAT)))
    if name == "avg":
        return Value(FLOAT, F.avg(v.column))
    return Value(v.type, F.sum(v.column))
