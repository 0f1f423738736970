"""Reading clauses to DataFrame operations.

A query keeps a *binding table*, a DataFrame with one row per match so far, and a scope that says
which of its columns a variable stands for. Patterns become equi-joins between node and edge frames;
nothing is executed here. Columns that are out of scope stay in the plan and are pruned by Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlane.functions import scalar
from quiverlane.functions.aggregates import AGGREGATES, aggregate
from quiverlane.graph import ID, LABELS, OWN, SOURCE, TARGET, EdgeFrame, Frame, PropertyGraph, key_column, typed_property
from quiverlane.lang import values as V
from quiverlane.lang.errors import Internal, compile_error, run_error
from quiverlane.lang.syntax import (
    Binary,
    Call,
    Chain,
    EdgePattern,
    Index,
    IsNull,
    Item,
    Label,
    LabelAnd,
    LabelTest,
    ListLiteral,
    Literal,
    MapLiteral,
    Match,
    Member,
    Modifiers,
    Node,
    NodePattern,
    Parameter,
    Slice,
    Unary,
    Unwind,
    Variable,
)
from quiverlane.lang.usage import Use, has_aggregate
from quiverlane.lang.values import Entity, Path, Type, Value


def label_holds(expression: Node | None, labels: Sequence[str]) -> bool:
    """Whether fixed labels satisfy a label expression."""
    if expression is None:
        return True
    if isinstance(expression, Label):
        return expression.name in labels
    test = all if isinstance(expression, LabelAnd) else any
    return test(label_holds(p, labels) for p in expression.parts)


def label_filter(expression: Node, labels: Column) -> Column:
    if isinstance(expression, Label):
        return F.array_contains(labels, F.lit(expression.name))
    parts = [label_filter(p, labels) for p in expression.parts]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if isinstance(expression, LabelAnd) else (out | p)
    return out


def is_true(v: Value) -> Column:
    """What WHERE keeps: anything but null and false."""
    if v.type.kind == "bool":
        return F.coalesce(v.column, F.lit(False)) if v.constant else v.column
    v = V.settled(v)
    if v.type.kind == "any":
        return v.column.isNotNull() & ((v.column["k"] != 7) | v.column["b"])
    return ~V.is_null(v)


@dataclass
class Bindings:
    """The binding table (None: one row of nothing) and its scope."""

    spark: SparkSession
    df: DataFrame | None = None
    scope: dict[str, Value] = field(default_factory=dict)
    count: int = 0

    def fresh(self) -> str:
        self.count += 1
        return f"c{self.count}"

    def table(self) -> DataFrame:
        if self.df is None:
            self.df = self.spark.range(1).select(F.lit(True).alias(self.fresh()))
        return self.df

    def bind(self, columns: Sequence[Column]) -> list[Column]:
        """Adds columns to the table; gives their names as columns."""
        names = [self.fresh() for _ in columns]
        if columns:
            self.df = self.table().select("*", *[c.alias(n) for c, n in zip(columns, names)])
        return [F.col(n) for n in names]

    def bind_value(self, v: Value) -> Value:
        """The value as a column of the table; entities and constants are left as they are."""
        if isinstance(v, (Entity, Path)) or v.constant:
            return v
        return replace(v, column=self.bind([v.column])[0])


class Expressions:
    """Expressions over a scope. ``known``: what certain subexpressions were found to be already."""

    def __init__(self, scope: Mapping[str, Value], parameters: Mapping[str, Any], known: Mapping[Node, Value] | None = None, lost: Sequence[str] = ()) -> None:
        self.scope, self.parameters, self.known, self.lost = scope, parameters, known or {}, frozenset(lost)

    def value(self, n: Node) -> Value:
        if n in self.known:
            return self.known[n]
        return getattr(self, "_" + type(n).__name__)(n)

    def _Literal(self, n: Literal) -> Value:
        return V.literal(n.value)

    def _Parameter(self, n: Parameter) -> Value:
        for key in ("$" + n.name, n.name):
            if key in self.parameters:
                return V.literal(self.parameters[key])
        raise run_error("UnknownParameter", f"no value was given for ${n.name}")

    def _Variable(self, n: Variable) -> Value:
        if n.name in self.scope:
            return self.scope[n.name]
        if n.name in self.lost:
            return V.literal(None)  # neither grouped nor aggregated
        raise compile_error("UndefinedVariable", f"nothing is called {n.name} here")

    def _ListLiteral(self, n: ListLiteral) -> Value:
        return V.list_value([self.value(x) for x in n.items])

    def _MapLiteral(self, n: MapLiteral) -> Value:
        return V.map_value({k: self.value(x) for k, x in zip(n.keys, n.values)})

    def _Member(self, n: Member) -> Value:
        v = self.value(n.of)
        for name in n.path:
            v = V.member(v, name)
        return v

    def _Index(self, n: Index) -> Value:
        return V.element(self.value(n.of), self.value(n.index))

    def _Slice(self, n: Slice) -> Value:
        return V.slice_of(self.value(n.of), *[None if x is None else self.value(x) for x in (n.start, n.end)])

    def _Unary(self, n: Unary) -> Value:
        return (V.negate if n.op == "NOT" else V.minus)(self.value(n.of))

    def _Binary(self, n: Binary) -> Value:
        a, b = self.value(n.left), self.value(n.right)
        if n.op == "=":
            return V.equal(a, b)
        if n.op == "<>":
            return V.negate(V.equal(a, b))
        if n.op in ("<", "<=", ">", ">="):
            return V.less(a, b, n.op)
        if n.op == "IN":
            return V.contains(a, b)
        if n.op == "NOT IN":
            return V.negate(V.contains(a, b))
        if n.op in ("AND", "OR", "XOR"):
            return V.logic(n.op, a, b)
        made = V.arithmetic(n.op, a, b)
        if a.constant and b.constant and a.type.kind == b.type.kind == "int" and made.type.kind == "int":
            return replace(made, constant=True, literal=_folded(n.op, a.literal, b.literal))
        return made

    def _IsNull(self, n: IsNull) -> Value:
        null = V.is_null(self.value(n.of))
        return Value(V.BOOL, ~null if n.negated else null)

    def _LabelTest(self, n: LabelTest) -> Value:
        return scalar.call("has_labels", [self.value(Variable(n.variable)), *[V.literal(x) for x in n.labels]])

    def _Call(self, n: Call) -> Value:
        if n.name in AGGREGATES:
            raise compile_error("InvalidAggregation", "aggregates have no place here")
        return scalar.call(n.name, [self.value(a) for a in n.args])


def _folded(op: str, a: int | None, b: int | None) -> int | None:
    if a is None or b is None or op in "/%" and b == 0:
        return None
    if op in "/%":
        q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return q if op == "/" else a - b * q
    return {"+": a + b, "-": a - b, "*": a * b}[op]


@dataclass
class _End:
    """A node of a pattern: bound already, or still to be scanned."""

    pattern: NodePattern
    frames: frozenset[int]
    entity: Entity | None = None


class Matcher:
    """The patterns of one MATCH.

    Without OPTIONAL, each pattern is joined to the binding table as it is found. With it, the
    patterns are a table of their own, in which outer variables are only ids, and ``on`` collects the
    conditions of the left join.
    """

    def __init__(self, bindings: Bindings, graph: PropertyGraph, used: Mapping[str, Use], expressions: Callable[[Mapping[str, Value]], Expressions], declared: dict[str, NodePattern], optional: bool) -> None:
        self.bindings, self.graph, self.used, self.expressions, self.declared, self.optional = bindings, graph, used, expressions, declared, optional
        self.df = None if optional else bindings.df
        self.scope = dict(bindings.scope)
        self.local: dict[str, Entity] = {}
        self.edges: list[Entity] = []
        self.candidates: list[set[int]] = []
        self.paths = False
        self.narrowed = False
        self.on: list[Column] = []
        self.later: list[Callable[[], Column]] = []

    # -- the table so far --

    def join(self, other: DataFrame, on: Sequence[Column]) -> None:
        condition = None
        for c in on:
            condition = c if condition is None else condition & c
        if self.df is None:
            self.df = other if condition is None else other.where(condition)
        elif condition is None:
            self.df = self.df.crossJoin(other)
        else:
            self.df = self.df.join(other, condition)

    def keep(self, condition: Column) -> None:
        if self.df is None:
            self.on.append(condition)
        else:
            self.df = self.df.where(condition)

    # -- variables --

    def bound(self, name: str | None, kind: str) -> Entity | None:
        if name is None:
            return None
        if name in self.local:
            v: Value = self.local[name]
        elif name in self.scope:
            v = self.scope[name]
            if self.optional and isinstance(v, Entity) and v.type.kind == kind:
                return None  # an outer variable gets an id of its own on this side
        else:
            return None
        if v.type.kind == "null":
            v = Entity(Type(kind), id=F.lit(None).cast("bigint" if kind == "node" else "string"), labels=F.lit(None).cast("array<string>"), source=F.lit(None).cast("bigint"), target=F.lit(None).cast("bigint"))
        if v.type.kind != kind:
            raise compile_error("VariableTypeConflict", f"{name} is a {v.type}, where a {kind} is needed")
        if not isinstance(v, Entity):
            labels = v.column["labels"]
            v = Entity(v.type, id=v.column["id"], labels=labels, properties={k: Value(t, v.column["properties"][k]) for k, t in v.type.fields}, frames=frozenset(range(len(self.graph.nodes if kind == "node" else self.graph.edges))))
        return v

    def set(self, name: str | None, entity: Entity) -> None:
        if name is None:
            return
        outer = self.scope.get(name)
        if self.optional and name not in self.local and isinstance(outer, Entity):
            edge = outer.type.kind == "edge"
            self.on.append(outer.id == entity.id if edge else V.same_node(outer.id, outer.place, entity.id, entity.place))
            self.local[name] = replace(outer, id=entity.id, place=entity.place)
        else:
            self.local[name] = entity

    def end(self, pattern: NodePattern) -> _End:
        name = pattern.variable
        outer = self.scope.get(name) if name else None
        if name and (name in self.local or outer is not None):
            first = self.declared.get(name)
            if (pattern.labels or pattern.properties) and (first is None or (first.labels, first.properties) != (pattern.labels, pattern.properties)):
                raise compile_error("VariableAlreadyBound", f"{name} stands for something already")
        elif name:
            self.declared[name] = pattern
        entity = self.bound(name, "node")
        if entity is not None:
            return _End(pattern, entity.frames, entity)
        if outer is not None and isinstance(outer, Entity):
            return _End(NodePattern(name, None, None), outer.frames)
        return _End(pattern, frozenset(i for i, f in enumerate(self.graph.nodes) if f.labels is None or label_holds(pattern.labels, f.labels)))

    def needs_scan(self, e: _End, complete: bool) -> bool:
        """Whether more is asked of a node than that an edge ends there."""
        p, name = e.pattern, e.pattern.variable
        if self.optional and name and isinstance(self.scope.get(name), Entity):
            return False
        if p.properties or not complete or p.labels is not None and any(self.graph.nodes[i].labels is None for i in e.frames):
            return True
        u = self.used.get(name) if name else None
        everything = "*" in self.used and name is not None
        if everything or u is not None and (u.whole or u.properties):
            return True
        return u is not None and u.labels and len(e.frames) > 1 or u is not None and u.labels and any(self.graph.nodes[i].labels is None for i in e.frames)

    # -- scans --

    def scan(self, frames: Sequence[Frame], keys: Mapping[str, bool], labels: Node | None) -> tuple[DataFrame, dict[str, Column], Column, dict[str, Value]]:
        """The rows of frames under fresh names: table, key columns, labels, properties.

        ``keys``: which columns, and whether as ids; else they are the keys of the one table.
        """
        types: dict[str, Type] = {}
        for f in frames:
            for n, t in f.properties.items():
                types[n] = V.unify(types.get(n, V.NULL), t)
        b = self.bindings
        names = {k: b.fresh() for k in (*keys, LABELS)} | {"." + n: b.fresh() for n in types}
        own = [c for c in frames[0].df.columns if c.startswith(OWN)] if len(frames) == 1 else []
        names |= {c: b.fresh() for c in own}
        out = None
        for f in frames:
            df = f.df
            if f.labels is None and labels is not None:
                df = df.where(label_filter(labels, F.col(LABELS)))
            ids = [(key_column(f, k) if as_id else F.col(k)).alias(names[k]) for k, as_id in keys.items()]
            part = df.select(*ids, f.label_column().alias(names[LABELS]), *[typed_property(f.properties, n, t).alias(names["." + n]) for n, t in types.items()], *[F.col(f"`{c}`").alias(names[c]) for c in own])
            out = part if out is None else out.unionByName(part)
        fixed = frames[0].label_column() if len(frames) == 1 and frames[0].labels is not None else F.col(names[LABELS])
        return out, {k: F.col(names[k]) for k in (*keys, *own)}, fixed, {n: Value(t, F.col(names["." + n])) for n, t in types.items()}

    def scan_node(self, e: _End) -> tuple[DataFrame, Entity]:
        frames = [self.graph.nodes[i] for i in sorted(e.frames)]
        place = frames[0].place if len(frames) == 1 else None
        df, keys, labels, properties = self.scan(frames, {ID: place is None}, e.pattern.labels) if frames else self.nothing([ID])
        entity = Entity(Type("node", fields=tuple(sorted((n, v.type) for n, v in properties.items()))), id=keys[ID], labels=labels, properties=properties, frames=e.frames, place=place)
        df = self.with_properties(df, entity, e.pattern.properties)
        return df, entity

    def nothing(self, keys: Sequence[str]) -> tuple[DataFrame, dict[str, Column], Column, dict[str, Value]]:
        """No frame can have what is asked for."""
        names = {k: self.bindings.fresh() for k in (*keys, LABELS)}
        ddl = ", ".join(f"{n} {'array<string>' if k == LABELS else 'bigint' if k != ID or SOURCE not in keys else 'string'}" for k, n in names.items())
        return self.bindings.spark.createDataFrame([], ddl), {k: F.col(names[k]) for k in keys}, F.col(names[LABELS]), {}

    def with_properties(self, df: DataFrame, entity: Entity, wanted: MapLiteral | None) -> DataFrame:
        """Filters by the pattern's properties; those that need other variables wait for the join."""
        for k, x in zip(wanted.keys, wanted.values) if wanted else ():
            if any(isinstance(c, Variable) for c in x.walk()):
                self.later.append(lambda k=k, x=x: is_true(V.equal(V.member(entity, k), self.expressions({**self.scope, **self.local}).value(x))))
            else:
                df = df.where(is_true(V.equal(V.member(entity, k), self.expressions({}).value(x))))
        return df

    # -- patterns --

    def expect(self, chains: Sequence[Chain]) -> None:
        """Notes which frames each edge of the clause may come from, and whether paths are named."""
        for c in chains:
            self.paths |= c.path is not None
            for e in c.edges:
                self.candidates.append({i for i, f in enumerate(self.graph.edges) if f.labels is None or label_holds(e.labels, f.labels)})

    def needs_identity(self, p: EdgePattern, frames: Sequence[int]) -> bool:
        """Whether it matters which edge was found: to the query, or for edges to be distinct."""
        u = self.used.get(p.variable) if p.variable else None
        asked = p.variable is not None and ("*" in self.used or p.variable in self.scope) or u is not None and (u.whole or u.labels or u.id)
        return asked or self.paths or sum(not c.isdisjoint(frames) for c in self.candidates) > 1

    def chain(self, c: Chain) -> None:
        ends = [self.end(p) for p in c.nodes]
        if not c.edges:
            if ends[0].entity is None and not (self.optional and isinstance(self.scope.get(c.nodes[0].variable or ""), Entity)):
                df, entity = self.scan_node(ends[0])
                self.join(df, [])
                self.set(c.nodes[0].variable, entity)
            return
        # begin where something is bound already, so that each edge joins to what is there
        known = [self.is_bound(e) for e in ends]
        if not any(known) and self.optional:
            known = [self.outer(e) is not None for e in ends]
            # what is joined before it meets the outer rows is cut down to their nodes first
            self.narrowed = len(c.edges) > 1 or any(not f.complete for f in self.graph.edges)
        begin = known.index(True) if any(known) else 0
        order = [*range(begin, len(c.edges)), *range(begin - 1, -1, -1)]
        for i in order:
            self.step(c.edges[i], ends, i)
        if c.path is not None:
            made = Path(Type("path"), start=self.entity_of(ends[0]), edge=self.edges[-1], end=self.entity_of(ends[1]))
            self.local[c.path] = made

    def outer(self, e: _End) -> Entity | None:
        """The node of the outer rows that an end of an optional pattern is."""
        v = self.scope.get(e.pattern.variable) if e.pattern.variable else None
        return v if self.optional and isinstance(v, Entity) and v.type.kind == "node" and e.pattern.variable not in self.local else None

    def narrow(self, df: DataFrame, ends: Sequence[tuple[Column, int | None, _End]]) -> DataFrame:
        """Edges of which an end is a node of the outer rows, one by one semi-joined with those."""
        for side, place, e in ends:
            if (v := self.outer(e)) is not None:
                name = self.bindings.fresh()
                nodes = self.bindings.table().where(v.id.isNotNull()).select(v.id.alias(name))
                df = df.join(nodes, V.same_node(side, place, F.col(name), v.place), "left_semi")
        return df

    def is_bound(self, e: _End) -> bool:
        return e.entity is not None or e.pattern.variable is not None and e.pattern.variable in self.local

    def entity_of(self, e: _End) -> Entity:
        if e.entity is None and e.pattern.variable in self.local:
            e.entity = self.local[e.pattern.variable]
        return e.entity

    def step(self, edge: EdgePattern, ends: list[_End], i: int) -> None:
        left, right = ends[i], ends[i + 1]
        bound = self.bound(edge.variable, "edge")
        owned: dict[str, Entity] = {}
        if bound is None:
            df, entity, complete, reach, owned = self.scan_edge(edge, left, right)
            on = [V.same_node(side, place, e.entity.id, e.entity.place) for side, place, e in ((entity.source, entity.source_place, left), (entity.target, entity.target_place, right)) if self.entity_of(e) is not None]
            if left.pattern.variable is not None and left.pattern.variable == right.pattern.variable:
                df = df.where(V.same_node(entity.source, entity.source_place, entity.target, entity.target_place))
            for side, e in ((SOURCE, left), (TARGET, right)):
                if self.entity_of(e) is None and side in owned:
                    df = self.with_properties(df, owned[side], e.pattern.properties)
            if self.narrowed:
                df = self.narrow(df, ((entity.source, entity.source_place, left), (entity.target, entity.target_place, right)))
            self.join(df, on)
        else:
            complete, reach = True, (left.frames, right.frames)
            s, t = V.coded(bound.source, bound.source_place), V.coded(bound.target, bound.target_place)
            ways = {"->": [(s, t)], "<-": [(t, s)], "--": [(s, t), (t, s)]}[edge.direction]
            name = self.bindings.fresh()
            pairs = F.array(*[F.struct(a.alias("l"), b.alias("r")) for a, b in ways])
            self.df = self.df.select("*", F.explode(F.array_distinct(pairs)).alias(name))
            entity = replace(bound, source=F.col(name)["l"], target=F.col(name)["r"], source_place=None, target_place=None)
            for side, e in ((entity.source, left), (entity.target, right)):
                if self.entity_of(e) is not None:
                    self.keep(V.same_node(side, None, e.entity.id, e.entity.place))
        for other in self.edges:
            if other.frames & entity.frames or not other.frames:
                self.keep(other.id != entity.id)
        self.edges.append(entity)
        if bound is None:
            self.set(edge.variable, entity)
        sides = ((SOURCE, entity.source, entity.source_place, left, reach[0]), (TARGET, entity.target, entity.target_place, right, reach[1]))
        for end, side, place, e, reached in sides:
            if self.entity_of(e) is not None:
                continue
            e.frames = e.frames & reached
            if not self.needs_scan(e, complete):
                only = [self.graph.nodes[f] for f in e.frames]
                labels = only[0].label_column() if len(only) == 1 and only[0].labels is not None else F.lit(None).cast("array<string>")
                e.entity = Entity(Type("node"), id=side, labels=labels, frames=e.frames, place=place)
            elif end in owned:
                e.entity = owned[end]
            else:
                df, e.entity = self.scan_node(e)
                self.join(df, [V.same_node(e.entity.id, e.entity.place, side, place)])
            self.set(e.pattern.variable, e.entity)
            if e.pattern.variable in self.local:
                e.entity = self.local[e.pattern.variable]

    def scan_edge(self, p: EdgePattern, left: _End, right: _End) -> tuple[DataFrame, Entity, bool, tuple[frozenset[int], frozenset[int]], dict[str, Entity]]:
        """Edges with their ends as the pattern reads them: source is its left, target its right.

        Also whether all ends exist, the node frames that the left and right ends can be in, and the
        node that each row is the row of, by its end.
        """
        forth, back = [], []
        for i, f in enumerate(self.graph.edges):
            if f.labels is not None and not label_holds(p.labels, f.labels):
                continue
            if p.direction != "<-" and f.sources & left.frames and f.targets & right.frames:
                forth.append(i)
            if p.direction != "->" and f.targets & left.frames and f.sources & right.frames:
                back.append(i)
        used = sorted({*forth, *back})
        if not used:
            df, keys, labels, properties = self.nothing([ID, SOURCE, TARGET])
            return df, Entity(Type("edge"), id=keys[ID], labels=labels, source=keys[SOURCE], target=keys[TARGET]), True, (left.frames, right.frames), {}
        identified = self.needs_identity(p, used)

        def frame(i: int) -> EdgeFrame:
            f = self.graph.edges[i]
            return f if identified or f.light is None else replace(f, df=f.light)

        frames: list[EdgeFrame] = [frame(i) for i in forth]
        for i in back:
            f = frame(i)
            # a self-loop is found once, in the forward direction
            loops = V.same_node(F.col(SOURCE), f.source_place, F.col(TARGET), f.target_place)
            df = f.df.where(~loops) if i in forth and f.sources & f.targets else f.df
            turned = {SOURCE: TARGET, TARGET: SOURCE}
            df = df.select(*[F.col(f"`{c}`").alias(turned.get(c, c)) for c in df.columns])
            frames.append(replace(f, df=df, source_place=f.target_place, target_place=f.source_place, owner=turned.get(f.owner)))
        places = [{f.source_place for f in frames}, {f.target_place for f in frames}]
        s, t = (min(x) if len(x) == 1 and None not in x else None for x in places)
        df, keys, labels, properties = self.scan(frames, {ID: False, SOURCE: s is None, TARGET: t is None}, p.labels)
        entity = Entity(
            Type("edge", fields=tuple(sorted((n, v.type) for n, v in properties.items()))), id=keys[ID], labels=labels, properties=properties, frames=frozenset(used), source=keys[SOURCE], target=keys[TARGET], source_place=s, target_place=t
        )
        edges = self.graph.edges
        lefts = frozenset().union(*[edges[i].sources for i in forth], *[edges[i].targets for i in back])
        rights = frozenset().union(*[edges[i].targets for i in forth], *[edges[i].sources for i in back])
        owned: dict[str, Entity] = {}
        if len(frames) == 1 and frames[0].owner is not None:
            end = frames[0].owner
            place = s if end == SOURCE else t
            node = self.graph.nodes[place]
            held = {n: Value(x, keys[OWN + n]) for n, x in node.properties.items()}
            owned[end] = Entity(Type("node", fields=tuple(sorted(node.properties.items()))), id=keys[end], labels=node.label_column(), properties=held, frames=frozenset([place]), place=place)
        return self.with_properties(df, entity, p.properties), entity, all(edges[i].complete for i in used), (lefts, rights), owned


class Reader:
    """The reading clauses of one query."""

    def __init__(self, spark: SparkSession, graph: PropertyGraph, parameters: Mapping[str, Any], used: Mapping[str, Use]) -> None:
        self.spark, self.graph, self.parameters, self.used = spark, graph, parameters, used
        self.bindings = Bindings(spark)
        self.declared: dict[str, NodePattern] = {}

    def expressions(self, scope: Mapping[str, Value] | None = None, known: Mapping[Node, Value] | None = None, lost: Sequence[str] = ()) -> Expressions:
        return Expressions(self.bindings.scope if scope is None else scope, self.parameters, known, lost)

    def match(self, clause: Match) -> None:
        if clause.where is not None and has_aggregate(clause.where):
            raise compile_error("InvalidAggregation", "aggregates have no place here")
        b = self.bindings
        m = Matcher(b, self.graph, self.used, self.expressions, self.declared, clause.optional)
        m.expect(clause.patterns)
        for c in clause.patterns:
            m.chain(c)
        scope = {**b.scope, **{k: v for k, v in m.local.items() if not (clause.optional and k in b.scope)}}
        conditions = [c() for c in m.later]
        if clause.where is not None:
            conditions.append(is_true(self.expressions(scope).value(clause.where)))
        if not clause.optional:
            b.df = m.df if m.df is not None else b.table()
            for c in conditions:
                b.df = b.df.where(c)
        elif m.df is not None:
            on = F.lit(True)
            for c in (*m.on, *conditions):
                on = on & c
            b.df = b.table().join(m.df, on, "left")
        b.scope = scope

    def unwind(self, clause: Unwind) -> None:
        b, v = self.bindings, self.expressions().value(clause.item.expression)
        v = V.plain(v)
        name = b.fresh()
        if v.type.kind == "null":
            b.df = b.table().where(F.lit(False)).select("*", F.lit(None).alias(name))
            b.scope[clause.item.name] = Value(V.NULL, F.col(name))
            return
        if v.type == V.VARIANT:
            items = V.variant_list(v)
            v = Value(items.type, F.coalesce(items.column, F.filter(F.array(v.column), lambda x: x.isNotNull())))
        # a list gives a row per element; anything else gives one, null none
        many = v.column if v.type.kind == "list" else F.filter(F.array(v.column), lambda x: x.isNotNull())
        b.df = b.table().select("*", F.explode(many).alias(name))
        b.scope = {**b.scope, clause.item.name: Value(v.type.element if v.type.kind == "list" else v.type, F.col(name))}

    # -- projections --

    def project(self, star: bool, items: Sequence[Item], where: Node | None, modifiers: Modifiers) -> None:
        """WITH and RETURN: the scope becomes the items."""
        b = self.bindings
        listed = [*([Item(Variable(n), n, True) for n in b.scope] if star else []), *items]
        names = [i.name for i in listed]
        for n in names:
            if names.count(n) > 1:
                raise compile_error("ColumnNameConflict", f"two columns are called {n}")
        if where is not None and has_aggregate(where):
            raise compile_error("InvalidAggregation", "aggregates have no place here")
        outer = dict(b.scope)
        if any(has_aggregate(i.expression) for i in listed):
            made = self.aggregated(listed)
            visible: dict[str, Value] = dict(made)
            lost: Sequence[str] = ()
        else:
            values = [self.expressions().value(i.expression) for i in listed]
            free = [v for v in values if not isinstance(v, (Entity, Path)) and not v.constant]
            columns = iter(b.bind([v.column for v in free]))
            made = {i.name: replace(v, column=next(columns)) if not isinstance(v, (Entity, Path)) and not v.constant else v for i, v in zip(listed, values)}
            visible, lost = {**outer, **made}, ()
        known = {i.expression: made[i.name] for i in listed if not isinstance(i.expression, (Literal, Variable))}
        if where is not None:
            b.df = b.table().where(is_true(self.expressions(visible, known, lost).value(where)))
        self.modify(modifiers, visible, known)
        b.scope = made

    def modify(self, modifiers: Modifiers, visible: Mapping[str, Value], known: Mapping[Node, Value]) -> None:
        b = self.bindings
        keys = []
        for k in modifiers.order:
            if has_aggregate(k.expression) and k.expression not in known:
                raise Internal["MissingAggregations"]()
            v = self.expressions(visible, known).value(k.expression)
            if v.type.kind == "null" or v.constant:
                continue
            c = _sortable(v)
            keys.append(c.desc_nulls_first() if k.descending else c.asc_nulls_last())
        if keys:
            b.df = b.table().orderBy(*keys)
        skip, limit = (None if x is None else self.row_count(x) for x in (modifiers.skip, modifiers.limit))
        if skip:
            b.df = b.table().offset(skip)
        if limit is not None:
            b.df = b.table().limit(limit)

    def row_count(self, n: Node) -> int:
        if any(isinstance(c, (Variable, LabelTest)) for c in n.walk()):
            raise compile_error("NonConstantExpression", "a number of rows can't depend on what is matched")
        v = self.expressions({}).value(n)
        if v.type.kind != "int":
            raise compile_error("InvalidArgumentType", f"a number of rows can't be {v.type}")
        count = v.literal if v.constant and v.literal is not None else self.spark.range(1).select(v.column).head()[0]
        if count < 0:
            raise run_error("NegativeIntegerArgument", "a number of rows can't be negative")
        return count

    def aggregated(self, items: Sequence[Item]) -> dict[str, Value]:
        """Items without aggregates are the keys that the others are grouped by."""
        b = self.bindings
        inside = self.expressions()
        keys: list[Column] = []
        carried: list[Column] = []
        results: dict[Node, Value] = {}

        def grouped(v: Value) -> Value:
            v = V.settled(v)
            if isinstance(v, Path):
                return replace(v, start=grouped(v.start), edge=grouped(v.edge), end=grouped(v.end))
            if isinstance(v, Entity):
                # what belongs to an entity is the same in all rows of it
                def carry(c: Column | None) -> Column | None:
                    if c is None:
                        return None
                    name = b.fresh()
                    carried.append(F.first(c).alias(name))
                    return F.col(name)

                name = b.fresh()
                keys.append(v.id.alias(name))
                return replace(v, id=F.col(name), labels=carry(v.labels), source=carry(v.source), target=carry(v.target), properties={k: replace(p, column=carry(p.column)) for k, p in v.properties.items()})
            if v.constant or v.type.kind == "null":
                return v
            name = b.fresh()
            keys.append(v.column.alias(name))
            return replace(v, column=F.col(name))

        for i in items:
            if not has_aggregate(i.expression):
                results[i.expression] = grouped(inside.value(i.expression))
        n_keys = sum(not has_aggregate(i.expression) for i in items)
        for i in items:
            for n in i.expression.walk():
                if isinstance(n, Call) and n.name in AGGREGATES and n not in results:
                    if any(has_aggregate(a) for a in n.args):
                        raise compile_error("InvalidAggregation", "an aggregation within an aggregation")
                    v = aggregate(n.name, [inside.value(a) for a in n.args])
                    name = b.fresh()
                    carried.append(v.column.alias(name))
                    results[n] = replace(v, column=F.col(name))
        if n_keys and not keys:
            keys.append(F.lit(True).alias(b.fresh()))  # grouped by constants: no rows in, no rows out
        b.df = b.table().groupBy(*keys).agg(*carried) if keys else b.table().agg(*carried)
        outside = Expressions({}, self.parameters, results, list(b.scope))
        values = {i.name: outside.value(i.expression) for i in items}
        return {n: v if isinstance(v, (Entity, Path)) or v.constant or any(v is r for r in results.values()) else b.bind_value(v) for n, v in values.items()}

    def result(self) -> DataFrame:
        b = self.bindings
        return b.table().select(*[V.as_column(v).alias(n) for n, v in b.scope.items()])


def _sortable(v: Value) -> Column:
    """Entities are ordered by what they hold, maps by the number of their members first."""
    v = V.settled(v)
    if isinstance(v, Path):
        return _sortable(v.edge)
    if v.type.kind in ("node", "edge"):
        return V.as_column(v)["properties"] if v.type.fields or isinstance(v, Entity) and v.properties else V.identity(v)
    if v.type.kind == "map" and v.type.fields:
        return F.when(v.column.isNotNull(), F.struct(scalar.call("size", [v]).column.alias("size"), v.column.alias("members")))
    return v.column
