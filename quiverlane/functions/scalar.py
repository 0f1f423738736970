"""Functions that queries may call, as macros over columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiverlane.lang import values as V
from quiverlane.lang.errors import compile_error, run_error
from quiverlane.lang.values import BOOL, FLOAT, INT, NULL, STR, Entity, Path, Value


@dataclass(frozen=True)
class Function:
    """``least`` and ``most`` arguments (most None: any number). ``takes_null``: called even if all are null."""

    call: Callable[[Sequence[Value]], Value]
    least: int
    most: int | None
    takes_null: bool = False


FUNCTIONS: dict[str, Function] = {}


def register(name: str, least: int, most: int | None = -1, takes_null: bool = False):
    """Makes a macro from values to a value callable under a name. Users may register their own."""

    def add(call: Callable[[Sequence[Value]], Value]):
        FUNCTIONS[name] = Function(call, least, least if most == -1 else most, takes_null)
        return call

    return add


def call(name: str, args: Sequence[Value]) -> Value:
    f = FUNCTIONS.get(name)
    if f is None:
        raise compile_error("UnknownFunction", name)
    if len(args) < f.least or f.most is not None and len(args) > f.most:
        raise compile_error("InvalidNumberOfArguments", f"{name} got {len(args)} expected {f.least}")
    if args and not f.takes_null and all(a.type.kind == "null" for a in args):
        return Value(NULL, F.lit(None))
    return f.call(args)


def _refuse(name: str, v: Value):
    raise run_error("InvalidArgument", f"{name} of {v.type}")


@register("head", 1, takes_null=True)
def _head(args: Sequence[Value]) -> Value:
    (v,) = args
    if v.type == V.VARIANT:
        v = V.variant_list(v)
    if v.type.kind != "list":
        _refuse("head", v)
    return Value(v.type.element, F.get(v.column, F.lit(0)))


@register("keys", 1)
def _keys(args: Sequence[Value]) -> Value:
    """The names of members in alphabetical order."""
    (v,) = args
    if v.type == V.VARIANT:
        held = F.map_filter(F.try_variant_get(v.column, "$", "map<string,variant>"), lambda _, x: ~F.is_variant_null(x))
        return Value(V.list_of(STR), F.array_sort(F.map_keys(held)))
    if v.type.kind not in ("map", "node", "edge"):
        _refuse("keys", v)
    members = v.properties if isinstance(v, Entity) else v.type.members
    dense = v.type.kind == "map" and not v.type.sparse
    names = [F.lit(k) if dense else F.when(~V.is_null(V.member(v, k)), F.lit(k)) for k in sorted(members)]
    listed = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
    return Value(V.list_of(STR), F.when(~V.is_null(v), listed))


@register("range", 2)
def _range(args: Sequence[Value]) -> Value:
    """Both ends included; empty if the first is larger."""
    for v in args:
        if v.type.kind not in ("int", "null"):
            _refuse("range", v)
    a, b = (v.column.cast("bigint") for v in args)
    return Value(V.list_of(INT), F.when(a <= b, F.sequence(a, b)).when(a > b, F.array().cast("array<bigint>")))


def _count(v: Value, name: str) -> Value:
    if isinstance(v, Path):
        return Value(INT, F.when(v.edge.id.isNotNull(), F.lit(1)).cast("bigint"))
    if v.type == V.VARIANT:
        items, names = V.variant_list(v).column, _keys([v]).column
        return Value(INT, F.when(items.isNotNull(), F.size(items)).when(names.isNotNull(), F.size(names)).cast("bigint"))
    if v.type.kind == "list":
        return Value(INT, F.when(v.column.isNotNull(), F.size(v.column)).cast("bigint"))
    if v.type.kind == "map":
        n = F.size(_keys([v]).column) if v.type.sparse else F.lit(len(v.type.fields))
        return Value(INT, F.when(v.column.isNotNull(), n).cast("bigint"))
    return _refuse(name, v)


@register("size", 1)
def _size(args: Sequence[Value]) -> Value:
    return _count(args[0], "size")


@register("length", 1, takes_null=True)
def _length(args: Sequence[Value]) -> Value:
    return _count(args[0], "length")


@register("type", 1)
def _type(args: Sequence[Value]) -> Value:
    (v,) = args
    if v.type.kind != "edge":
        _refuse("type", v)
    labels = v.labels if isinstance(v, Entity) else v.column["labels"]
    missing = F.raise_error(F.lit("RunTime: MissingEdgeLabel")).cast("string")
    return Value(STR, F.when(~V.is_null(v), F.when(F.size(labels) > 0, F.get(labels, F.lit(0))).otherwise(missing)))


def _rounded(name: str, f: Callable[[Column], Column]) -> None:
    @register(name, 1)
    def rounded(args: Sequence[Value]) -> Value:
        v = V.settled(args[0])
        if v.type.kind == "any":
            v = Value(FLOAT, F.when(v.column["i"].isNull(), v.column["d"]))
        if v.type.kind != "float":
            _refuse(name, v)
        # beyond 2**52 a double is whole; infinities and NaN stay what they are
        return Value(FLOAT, F.when(F.abs(v.column) < 4503599627370496.0, f(v.column).cast("double")).otherwise(v.column))


_rounded("ceil", F.ceil)
_rounded("floor", F.floor)


@register("rand", 0)
def _rand(args: Sequence[Value]) -> Value:
    return Value(FLOAT, F.rand())


@register("labels", 1)
def _labels(args: Sequence[Value]) -> Value:
    (v,) = args
    if v.type.kind != "node":
        _refuse("labels", v)
    labels = v.labels if isinstance(v, Entity) else v.column["labels"]
    return Value(V.list_of(STR), F.when(~V.is_null(v), labels))


@register("coalesce", 1, None, takes_null=True)
def _coalesce(args: Sequence[Value]) -> Value:
    t = NULL
    for v in args:
        t = V.unify(t, v.type)
    if t.kind == "null":
        return Value(NULL, F.lit(None))
    return Value(t, F.coalesce(*[V.cast(V.as_column(v), v.type, t) for v in args]))


@register("properties", 1)
def _properties(args: Sequence[Value]) -> Value:
    (v,) = args
    if v.type.kind == "map" or v.type == V.VARIANT:
        return v
    if v.type.kind not in ("node", "edge"):
        _refuse("properties", v)
    if not isinstance(v, Entity):
        return Value(V.map_of(v.type.members, sparse=True), v.column["properties"])
    made = V.map_value(v.properties, sparse=True)
    return Value(made.type, F.when(v.id.isNotNull(), made.column))


@register("toInteger", 1)
def _to_integer(args: Sequence[Value]) -> Value:
    """Floats lose their fraction and stop at the ends of the range, NaN is 0; a bad text is an error."""
    v = V.settled(args[0])
    if v.type.kind == "int":
        return v
    if v.type.kind == "float":
        x = v.column
        inside = F.when(F.isnan(x), F.lit(0)).when(x >= 9.223372036854775807e18, F.lit(2**63 - 1)).when(x <= -9.223372036854775808e18, F.lit(-(2**63)))
        return Value(INT, inside.otherwise(x.cast("bigint")).cast("bigint"))
    if v.type.kind == "str":
        return Value(INT, v.column.cast("bigint"))
    if v.type.kind == "any":
        c = v.column
        whole = _to_integer([Value(FLOAT, c["d"])]).column
        return Value(INT, F.when(c["k"] == 8, F.coalesce(c["i"], whole)).when(c["k"] == 6, c["s"].cast("bigint")))
    return _refuse("toInteger", v)


@register("toString", 1)
def _to_string(args: Sequence[Value]) -> Value:
    """Whole floats lose their point, others their exponent."""
    v = V.settled(args[0])
    if v.type.kind in ("int", "bool", "str"):
        return Value(STR, v.column.cast("string"))
    if v.type.kind == "float":
        return Value(STR, float_text(v.column))
    if v.type.kind == "any":
        c = v.column
        return Value(STR, F.when(c["k"] == 8, F.coalesce(c["i"].cast("string"), float_text(c["d"]))).when(c["k"] == 7, c["b"].cast("string")).when(c["k"] == 6, c["s"]))
    return _refuse("toString", v)


def float_text(x: Column) -> Column:
    size = F.abs(x)
    special = F.when(F.isnan(x), F.lit("NaN")).when(size == float("inf"), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf")))
    usual = F.regexp_replace(x.cast("string"), r"\.0$", "")
    large = F.when(size < 1e37, F.regexp_replace(F.when(size < 1e37, x).cast("decimal(38,1)").cast("string"), r"\.0$", "")).otherwise(x.cast("string"))
    small = F.when(size < 1e-3, F.regexp_replace(F.when(size < 1e-3, x).cast("decimal(38,37)").cast("string"), r"0+$", ""))
    return special.when(size >= 1e7, large).when((size < 1e-3) & (x != 0), small).otherwise(usual)


@register("has_label", 2)
def _has_label(args: Sequence[Value]) -> Value:
    return _has_labels(args)


@register("has_labels", 2, None)
def _has_labels(args: Sequence[Value]) -> Value:
    """Whether a node or edge has all of the labels; null for null."""
    v, *names = args
    if v.type.kind not in ("node", "edge"):
        _refuse("has_labels", v)
    labels = v.labels if isinstance(v, Entity) else v.column["labels"]
    held = F.lit(True)
    for n in names:
        if n.type.kind != "str":
            _refuse("has_labels", n)
        held = held & F.array_contains(labels, n.column)
    return Value(BOOL, F.when(~V.is_null(v), held))
