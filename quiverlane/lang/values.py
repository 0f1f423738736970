"""Values of expressions: a Spark column and what is known of its type.

Types are known when a query is lowered, since the columns of a graph are. A value whose type
differs from row to row has the type ANY and is a *tagged struct* whose fields are ordered so that
Spark's own order of structs is the order of values: maps, nodes, edges, lists, paths, strings,
booleans, numbers. Comparisons follow three-valued logic; see each function.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quiverlane.lang.errors import compile_error, run_error


@dataclass(frozen=True)
class Type:
    kind: str
    element: Type | None = None
    fields: tuple[tuple[str, Type], ...] = ()
    native: str = ""
    #: Of a map: a null member is one that isn't there, as in what is stored.
    sparse: bool = field(default=False, compare=False)

    def __str__(self) -> str:
        return f"list of {self.element}" if self.kind == "list" else self.native or self.kind

    @property
    def members(self) -> dict[str, Type]:
        return dict(self.fields)


NULL, BOOL, INT, FLOAT, STR, ANY = (Type(k) for k in ("null", "bool", "int", "float", "str", "any"))
#: Values of any type as they were stored; they are tagged where they are compared or computed with.
VARIANT = Type("native", native="variant")
NUMBERS = ("int", "float", "any")


def list_of(element: Type) -> Type:
    return Type("list", element)


def map_of(fields: Mapping[str, Type], sparse: bool = False) -> Type:
    return Type("map", fields=tuple(sorted(fields.items())), sparse=sparse)


#: Tables of nodes that a graph may have. A node's id is its key * FRAMES + the place of its table.
FRAMES = 64

#: The order of kinds.
RANKS = {"map": 1, "node": 2, "edge": 3, "list": 4, "path": 5, "str": 6, "bool": 7, "int": 8, "float": 8, "native": 9}
TAGGED = "struct<k:int,s:string,b:boolean,d:double,i:bigint>"


def spark_type(t: Type) -> str:
    """The DDL of a type's columns."""
    simple = {"null": "void", "bool": "boolean", "int": "bigint", "float": "double", "str": "string", "any": TAGGED}
    if t.kind in simple:
        return simple[t.kind]
    if t.kind == "native":
        return t.native
    if t.kind == "list":
        return f"array<{spark_type(t.element)}>"
    members = ",".join(f"`{k}`:{spark_type(v)}" for k, v in t.fields)
    if t.kind == "map":
        return f"struct<{members}>"
    if t.kind == "node":
        return f"struct<id:bigint,labels:array<string>,properties:struct<{members}>>"
    if t.kind == "edge":
        return f"struct<id:string,labels:array<string>,properties:struct<{members}>>"
    raise compile_error("InvalidArgumentType", f"a {t.kind} can't be part of a list")


def type_of(data_type: S.DataType) -> Type:
    """The type of a table's column."""
    if isinstance(data_type, (S.ByteType, S.ShortType, S.IntegerType, S.LongType)):
        return INT
    if isinstance(data_type, (S.FloatType, S.DoubleType, S.DecimalType)):
        return FLOAT
    if isinstance(data_type, (S.StringType, S.CharType, S.VarcharType)):
        return STR
    if isinstance(data_type, S.BooleanType):
        return BOOL
    if isinstance(data_type, S.NullType):
        return NULL
    if isinstance(data_type, S.ArrayType):
        return list_of(type_of(data_type.elementType))
    if isinstance(data_type, S.StructType):
        if data_type.simpleString() == TAGGED:
            return ANY
        return map_of({f.name: type_of(f.dataType) for f in data_type.fields}, sparse=True)
    return Type("native", native=data_type.simpleString())


@dataclass(frozen=True)
class Value:
    """A column, or an entity's columns. ``literal``: the Python value of a constant."""

    type: Type
    column: Column | None = None
    constant: bool = False
    literal: Any = None
    aggregate: bool = False


@dataclass(frozen=True)
class Entity(Value):
    """A node or an edge that is bound by a pattern: its parts are columns of the binding table.

    ``frames``: the places in the graph's lists of frames that it can come from. ``place``: where all
    rows come from one table of nodes, its place; ``id`` is then that table's own key, so that joins
    and filters are on the table's column. The same goes for the ends of an edge.
    """

    id: Column | None = None
    labels: Column | None = None
    properties: Mapping[str, Value] = field(default_factory=dict)
    frames: frozenset[int] = frozenset()
    source: Column | None = None
    target: Column | None = None
    place: int | None = None
    source_place: int | None = None
    target_place: int | None = None

    def whole(self) -> Column:
        """The entity as one struct, null if it is missing."""
        inner = F.struct(*[v.column.alias(k) for k, v in sorted(self.properties.items())])
        return F.when(self.id.isNotNull(), F.struct(coded(self.id, self.place).alias("id"), self.labels.alias("labels"), inner.alias("properties")))


def coded(key: Column, place: int | None) -> Column:
    """The id of a node from its key in the table at a place; None: the key is an id already."""
    return key if place is None else key * FRAMES + place


def same_node(a: Column, a_place: int | None, b: Column, b_place: int | None) -> Column:
    """Whether two keys mean the same node."""
    if a_place == b_place:
        return a == b
    if a_place is not None and b_place is not None:
        return F.lit(False)
    return coded(a, a_place) == coded(b, b_place)


@dataclass(frozen=True)
class Path(Value):
    start: Entity | None = None
    edge: Entity | None = None
    end: Entity | None = None


def literal(value: Any) -> Value:
    """A constant of Python: null, boolean, number, string, list or map."""
    if value is None:
        return Value(NULL, F.lit(None), True, None)
    if isinstance(value, bool):
        return Value(BOOL, F.lit(value), True, value)
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            raise compile_error("IntegerOverflow", f"'{value}' is too large.")
        return Value(INT, F.lit(value).cast("bigint"), True, value)
    if isinstance(value, float):
        return Value(FLOAT, F.lit(value), True, value)
    if isinstance(value, str):
        return Value(STR, F.lit(value), True, value)
    if isinstance(value, (list, tuple)):
        return replace(list_value([literal(v) for v in value]), constant=True, literal=list(value))
    if isinstance(value, Mapping):
        return replace(map_value({str(k): literal(v) for k, v in value.items()}), constant=True, literal=dict(value))
    raise TypeError(f"{type(value).__name__} is no value of a query")


# -- types together ----------------------------------------------------------------------


def unify(a: Type, b: Type) -> Type:
    """The type that columns of both types can have; integers and floats stay apart in ANY."""
    if a == b and not b.sparse or b.kind == "null":
        return a
    if a.kind == "null":
        return b
    if a.kind == b.kind == "list":
        return list_of(unify(a.element, b.element))
    if a.kind == b.kind and a.kind in ("map", "node", "edge"):
        x, y = a.members, b.members
        fields = tuple(sorted((k, unify(x.get(k, NULL), y.get(k, NULL))) for k in {*x, *y}))
        return Type(a.kind, fields=fields, sparse=a.sparse or b.sparse or set(x) != set(y))
    return ANY


def cast(column: Column, of: Type, to: Type) -> Column:
    """A column of one type as one of a type that it was unified into."""
    if of == to:
        return column
    if of.kind == "null":
        return F.lit(None).cast(spark_type(to))
    if to.kind == "any":
        return tagged(column, of)
    if of.kind == "list":
        return F.transform(column, lambda x: cast(x, of.element, to.element))
    if of.kind in ("map", "node", "edge"):
        held = of.members
        inside = column if of.kind == "map" else column["properties"]
        parts = [(cast(inside[k], held[k], t) if k in held else F.lit(None).cast(spark_type(t))).alias(k) for k, t in to.fields]
        made = F.struct(*parts)
        if of.kind != "map":
            made = F.struct(column["id"].alias("id"), column["labels"].alias("labels"), made.alias("properties"))
        return F.when(column.isNotNull(), made)
    raise run_error("InvalidArgumentType", f"{of} isn't {to}")


def tagged(column: Column, of: Type) -> Column:
    """A column as tagged struct."""
    if of.kind == "any":
        return column
    if of.kind == "null":
        return F.lit(None).cast(TAGGED)
    if of == VARIANT:
        return _tagged_variant(column)
    none = {"s": F.lit(None).cast("string"), "b": F.lit(None).cast("boolean"), "d": F.lit(None).cast("double"), "i": F.lit(None).cast("bigint")}
    if of.kind == "int":
        part = {"d": column.cast("double"), "i": column}
    elif of.kind == "float":
        part = {"d": column}
    elif of.kind == "bool":
        part = {"b": column}
    elif of.kind in ("str", "native"):
        part = {"s": column.cast("string")}
    else:
        part = {"s": F.to_json(column)}
    made = F.struct(F.lit(RANKS[of.kind]).alias("k"), *[(part.get(n) if n in part else c).alias(n) for n, c in none.items()])
    return F.when(column.isNotNull(), made)


def _tagged_variant(column: Column) -> Column:
    kind = F.schema_of_variant(column)

    def get(t: Type) -> Column:
        return tagged(F.try_variant_get(column, "$", spark_type(t)), t)

    def text(rank: str) -> Column:
        none = [F.lit(None).cast(t).alias(n) for n, t in (("b", "boolean"), ("d", "double"), ("i", "bigint"))]
        return F.struct(F.lit(RANKS[rank]).alias("k"), F.to_json(column).alias("s"), *none)

    number = F.when(kind == "BIGINT", get(INT)).when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), get(FLOAT))
    return number.when(kind == "BOOLEAN", get(BOOL)).when(kind == "STRING", get(STR)).when(kind.startswith("ARRAY"), text("list")).when(kind.startswith("OBJECT"), text("map"))


def stored(column: Column) -> Column:
    """A variant, null where it holds JSON's null."""
    return F.when(~F.is_variant_null(column), column)


def in_variant(document: Column, name: str, t: Type) -> Column:
    """A member of a variant as a type; null where it has none, or one of another type."""
    if "'" in name or "\\" in name:
        found = F.try_variant_get(document, "$", "map<string,variant>")[name]
        return stored(found) if t == VARIANT else F.try_variant_get(found, "$", spark_type(t))
    found = F.try_variant_get(document, f"$['{name}']", spark_type(t))
    return stored(found) if t == VARIANT else found


def variant_list(v: Value) -> Value:
    """A variant as a list of variants; null if it isn't one."""
    return Value(list_of(VARIANT), F.transform(F.try_variant_get(v.column, "$", "array<variant>"), stored))


def settled(v: Value) -> Value:
    """A value that can be compared and grouped by: variants are tagged."""
    return Value(ANY, _tagged_variant(v.column)) if v.type == VARIANT else v


def as_column(v: Value) -> Column:
    """The one column of a value; entities become structs."""
    if isinstance(v, Path):
        made = F.struct(as_column(v.start).alias("source"), as_column(v.edge).alias("edge"), as_column(v.end).alias("destination"))
        return F.when(v.edge.id.isNotNull(), made)
    return v.whole() if isinstance(v, Entity) else v.column


def plain(v: Value) -> Value:
    """A value as one column, so that it can be an element of a list or map."""
    if isinstance(v, Entity):
        return Value(v.type, v.whole())
    return v


def list_value(items: Sequence[Value]) -> Value:
    element = NULL
    for v in items:
        element = unify(element, v.type)
    columns = [cast(as_column(v), v.type, element) for v in items]
    return Value(list_of(element), F.array(*columns) if columns else F.array().cast("array<void>"), all(v.constant for v in items), [v.literal for v in items])


def map_value(entries: Mapping[str, Value], sparse: bool = False) -> Value:
    items = sorted(entries.items())
    t = map_of({k: v.type for k, v in items}, sparse)
    return Value(t, F.struct(*[as_column(v).alias(k) for k, v in items]), all(v.constant for v in entries.values()), {k: v.literal for k, v in items})


# -- comparison ----------------------------------------------------------------------------


def _either_null(a: Value, b: Value) -> Column:
    return is_null(a) | is_null(b)


def is_null(v: Value) -> Column:
    if isinstance(v, Entity):
        return v.id.isNull()
    if isinstance(v, Path):
        return v.edge.id.isNull()
    return F.lit(True) if v.type.kind == "null" else v.column.isNull()


def unknown() -> Value:
    """Neither true nor false."""
    return Value(BOOL, F.lit(None).cast("boolean"))


def _not_nan(v: Value) -> Column:
    return F.lit(True) if v.type.kind != "float" else ~F.isnan(v.column)


def identity(v: Value) -> Column:
    """What tells entities apart."""
    if isinstance(v, Path):
        return v.edge.id
    return coded(v.id, v.place) if isinstance(v, Entity) else v.column["id"]


def equal(a: Value, b: Value) -> Value:
    """Null if either is null; false for values of different types and for NaN; numbers compare by value."""
    a, b = settled(a), settled(b)
    if a.type.kind == "null" or b.type.kind == "null":
        return unknown()
    kinds = {a.type.kind, b.type.kind}
    if kinds <= {"int", "float"}:
        same = a.column == b.column
        if "float" in kinds:
            same = same & _not_nan(a) & _not_nan(b)
        return Value(BOOL, same)
    if "any" in kinds:
        x, y = tagged(as_column(a), a.type), tagged(as_column(b), b.type)
        number = (x["k"] == 8) & (y["k"] == 8)
        whole = x["i"].isNotNull() & y["i"].isNotNull()
        same = F.when(number, F.when(whole, x["i"] == y["i"]).otherwise((x["d"] == y["d"]) & ~F.isnan(x["d"]) & ~F.isnan(y["d"]))).otherwise((x["k"] == y["k"]) & x["s"].eqNullSafe(y["s"]) & x["b"].eqNullSafe(y["b"]))
        return Value(BOOL, F.when(x.isNotNull() & y.isNotNull(), same))
    if len(kinds) > 1:
        return Value(BOOL, F.when(~_either_null(a, b), F.lit(False)))
    kind = a.type.kind
    if kind == "node" and isinstance(a, Entity) and isinstance(b, Entity):
        same = same_node(a.id, a.place, b.id, b.place)
        return Value(BOOL, same if a.place == b.place else F.when(~_either_null(a, b), same))
    if kind in ("node", "edge", "path"):
        return Value(BOOL, identity(a) == identity(b))
    if kind == "list":
        return Value(BOOL, _equal_lists(a, b))
    if kind == "map":
        x, y = a.type.members, b.type.members
        if set(x) != set(y):
            return Value(BOOL, F.when(~_either_null(a, b), F.lit(False)))
        same = F.lit(True)
        for k in x:
            same = same & equal(Value(x[k], a.column[k]), Value(y[k], b.column[k])).column
        return Value(BOOL, F.when(~_either_null(a, b), same))
    if a.type != b.type:
        return Value(BOOL, F.when(~_either_null(a, b), F.lit(False)))
    return Value(BOOL, a.column == b.column)


def _equal_lists(a: Value, b: Value) -> Column:
    """Different lengths: false. Else false if a pair differs, else null if one is unknown."""
    if a.type.element.kind == "null" or b.type.element.kind == "null":
        pairs = F.when(F.size(a.column) == 0, F.lit(True))
    else:
        both = F.zip_with(a.column, b.column, lambda x, y: equal(Value(a.type.element, x), Value(b.type.element, y)).column)
        pairs = F.forall(both, lambda x: x)
    return F.when(~_either_null(a, b), F.when(F.size(a.column) != F.size(b.column), F.lit(False)).otherwise(pairs))


def negate(v: Value) -> Value:
    v = settled(v)
    if v.type.kind == "null":
        return unknown()
    if v.type.kind == "any":
        return Value(BOOL, ~v.column["b"])
    if v.type.kind != "bool":
        raise run_error("InvalidArgumentType", f"NOT of {v.type}")
    return Value(BOOL, ~v.column, v.constant, None if v.literal is None else not v.literal)


def less(a: Value, b: Value, op: str) -> Value:
    """``< <= > >=``: null if either is null or the types don't compare; false for NaN."""
    a, b = settled(a), settled(b)

    def compared(x: Column, y: Column) -> Column:
        return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    kinds = {a.type.kind, b.type.kind}
    if kinds <= {"int", "float"}:
        result = compared(a.column, b.column)
        if "float" in kinds:
            result = result & _not_nan(a) & _not_nan(b)
        return Value(BOOL, result)
    if "any" in kinds and "null" not in kinds:
        x, y = tagged(as_column(a), a.type), tagged(as_column(b), b.type)
        number = F.when(x["i"].isNotNull() & y["i"].isNotNull(), compared(x["i"], y["i"])).otherwise(compared(x["d"], y["d"]) & ~F.isnan(x["d"]) & ~F.isnan(y["d"]))
        return Value(BOOL, F.when(x["k"] == y["k"], F.when(x["k"] == 8, number).when(x["k"] == 6, compared(x["s"], y["s"])).when(x["k"] == 7, compared(x["b"], y["b"]))))
    if kinds == {"list"}:
        size = compared(F.size(a.column), F.size(b.column))
        element = unify(a.type.element, b.type.element)
        if element.kind == "null":
            inside = F.when(F.size(a.column) == 0, F.lit(op in ("<=", ">=")))
        else:
            x, y = cast(a.column, a.type, list_of(element)), cast(b.column, b.type, list_of(element))
            known = ~F.exists(x, lambda e: e.isNull()) & ~F.exists(y, lambda e: e.isNull())
            inside = F.when(known, compared(x, y))
        return Value(BOOL, F.when(~_either_null(a, b), F.when(F.size(a.column) != F.size(b.column), size).otherwise(inside)))
    if len(kinds) == 1 and a.type == b.type and a.type.kind in ("str", "bool", "native"):
        return Value(BOOL, compared(a.column, b.column))
    return unknown()


def contains(x: Value, within: Value) -> Value:
    """``x IN list``: true if an element equals x, else null if one might, else false."""
    if within.type.kind == "null":
        if within.constant:
            raise compile_error("InvalidArgumentType", "IN needs a list")
        return unknown()
    if within.type == VARIANT:
        within = variant_list(within)
    if within.type.kind != "list":
        raise compile_error("InvalidArgumentType", f"IN needs a list, not {within.type}")
    element = within.type.element
    if within.constant and x.type.kind in ("int", "str", "bool") and element == x.type and within.literal and None not in within.literal:
        return Value(BOOL, x.column.isin(within.literal))  # which a scan can be asked for
    found = F.exists(within.column, lambda e: equal(x, Value(element, e)).column)
    return Value(BOOL, found)


def logic(op: str, a: Value, b: Value) -> Value:
    def truth(v: Value) -> Column:
        v = settled(v)
        if v.type.kind == "null":
            return F.lit(None).cast("boolean")
        if v.type.kind == "any":
            return v.column["b"]
        if v.type.kind != "bool":
            raise run_error("InvalidArgumentType", f"{op} of {v.type}")
        return v.column

    x, y = truth(a), truth(b)
    return Value(BOOL, {"AND": x & y, "OR": x | y, "XOR": x != y}[op])


# -- arithmetic ------------------------------------------------------------------------------


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """Integers stay integers (``/`` truncates), mixed numbers are floats; null in, null out."""
    a, b = settled(a), settled(b)
    if a.type.kind == "null" or b.type.kind == "null":
        return literal(None)
    kinds = {a.type.kind, b.type.kind}
    if op == "+" and a.type.kind == "list":
        other = b.type if b.type.kind == "list" else list_of(b.type)
        t = unify(a.type, other)
        added = b if b.type.kind == "list" else Value(other, F.array(as_column(b)))
        return Value(t, F.concat(cast(a.column, a.type, t), cast(added.column, other, t)))
    if op == "+" and kinds == {"str"}:
        return Value(STR, F.concat(a.column, b.column))
    if kinds <= {"int"}:
        if op == "/":
            # as SQL's div, which truncates and refuses to divide by zero
            return Value(INT, F.call_function("div", a.column, b.column))
        return Value(INT, {"+": a.column + b.column, "-": a.column - b.column, "*": a.column * b.column, "%": a.column % b.column}[op])
    if kinds <= {"int", "float"}:
        return Value(FLOAT, _floats(op, a.column.cast("double"), b.column.cast("double")))
    if kinds <= set(NUMBERS) or op == "+" and kinds == {"any", "str"}:
        x, y = tagged(a.column, a.type), tagged(b.column, b.type)
        whole = arithmetic(op, Value(INT, x["i"]), Value(INT, y["i"])) if op in "+-*" else Value(INT, F.call_function("try_mod" if op == "%" else "div", x["i"], F.when(y["i"] != 0, y["i"])))
        made = F.when(x["i"].isNotNull() & y["i"].isNotNull(), tagged(whole.column, INT)).otherwise(tagged(_floats(op, x["d"], y["d"]), FLOAT))
        made = F.when((x["k"] == 8) & (y["k"] == 8), made)
        if op == "+":
            made = made.when((x["k"] == 6) & (y["k"] == 6), tagged(F.concat(x["s"], y["s"]), STR))
        return Value(ANY, made)
    raise run_error("InvalidBinaryOperands", f"{a.type} {op} {b.type}")


def _floats(op: str, x: Column, y: Column) -> Column:
    if op == "/":
        by_zero = F.when(x > 0, F.lit(math.inf)).when(x < 0, F.lit(-math.inf)).when(x.isNotNull(), F.lit(math.nan))
        return F.when(y == 0, by_zero).otherwise(F.try_divide(x, y))
    if op == "%":
        return F.when((y == 0) & x.isNotNull(), F.lit(math.nan)).otherwise(F.try_mod(x, y))
    return {"+": x + y, "-": x - y, "*": x * y}[op]


def minus(v: Value) -> Value:
    v = settled(v)
    if v.type.kind == "null":
        return literal(None)
    if v.type.kind == "any":
        return arithmetic("-", literal(0), v)
    if v.type.kind not in ("int", "float"):
        raise run_error("InvalidNegationOperands", str(v.type))
    return Value(v.type, -v.column, v.constant, None if v.literal is None else -v.literal)


# -- parts -------------------------------------------------------------------------------------


def member(v: Value, name: str) -> Value:
    """A property, or the value under a key; null where there is none."""
    if isinstance(v, Entity):
        return v.properties.get(name, literal(None))
    if v.type == VARIANT:
        return Value(VARIANT, in_variant(v.column, name, VARIANT))
    if v.type.kind in ("map", "node", "edge") and name in v.type.members:
        inside = v.column if v.type.kind == "map" else v.column["properties"]
        return Value(v.type.members[name], inside[name])
    return Value(NULL, F.lit(None))


def element(v: Value, index: Value) -> Value:
    """``list[i]`` from 0, out of bounds is an error; ``map['k']``, null where there is none."""
    if v.type.kind == "null" or index.type.kind == "null":
        return Value(NULL, F.lit(None))
    index = settled(index)
    if v.type == VARIANT:
        if index.type.kind == "str":
            return member(v, index.literal) if index.constant else Value(VARIANT, stored(F.try_variant_get(v.column, "$", "map<string,variant>")[index.column]))
        v = variant_list(v)
    if v.type.kind == "list":
        if index.type.kind == "any":
            index = Value(INT, index.column["i"])
        if index.type.kind != "int":
            raise run_error("InvalidArgumentType", f"index of type {index.type}")
        if index.constant and index.literal is not None and index.literal < 0:
            raise run_error("OutOfBound", "index is out of bound for array.")
        inside = (index.column >= 0) & (index.column < F.size(v.column))
        wrong = F.raise_error(F.lit("RunTime: OutOfBound: index is out of bound for array.")).cast(spark_type(v.type.element)) if v.type.element.kind != "null" else F.lit(None)
        found = F.when(v.column.isNull() | index.column.isNull(), F.lit(None)).when(inside, F.get(v.column, index.column.cast("int"))).otherwise(wrong)
        return Value(v.type.element, found)
    if v.type.kind in ("map", "node", "edge"):
        if index.type.kind != "str":
            raise run_error("MapElementAccessByNonString")
        if index.constant:
            return member(v, index.literal)
        members = {k: x.type for k, x in v.properties.items()} if isinstance(v, Entity) else v.type.members
        t = NULL
        for x in members.values():
            t = unify(t, x)
        if t.kind == "null":
            return Value(NULL, F.lit(None))
        found = F.lit(None).cast(spark_type(t))
        for k, x in members.items():
            found = F.when(index.column == k, cast(member(v, k).column, x, t)).otherwise(found)
        return Value(t, found)
    raise run_error("InvalidArgumentType", f"index of {v.type}")


def slice_of(v: Value, start: Value | None, end: Value | None) -> Value:
    """``list[a..b]``: half open, negative bounds count from the end, bounds are clamped, null gives null."""
    if v.type.kind == "null" or any(x is not None and x.type.kind == "null" for x in (start, end)):
        return Value(NULL, F.lit(None))
    if v.type == VARIANT:
        v = variant_list(v)
    if v.type.kind != "list":
        raise run_error("InvalidArgumentType", f"range of {v.type}")
    n = F.size(v.column)

    def bound(x: Value | None, otherwise: Column) -> Column:
        if x is None:
            return otherwise
        if x.type.kind == "any":
            x = Value(INT, x.column["i"])
        if x.type.kind != "int":
            raise run_error("InvalidArgumentType", f"range bound of type {x.type}")
        return F.when(x.column.isNotNull(), F.least(F.greatest(F.when(x.column < 0, x.column + n).otherwise(x.column), F.lit(0)), n)).cast("int")

    a, b = bound(start, F.lit(0)), bound(end, n)
    known = a.isNotNull() & b.isNotNull() & v.column.isNotNull()
    return Value(v.type, F.when(known, F.slice(v.column, a + 1, F.when(b > a, b - a).otherwise(F.lit(0)))))
