"""Writing clauses: each gives a new graph and leaves the old one as it was.

What a clause writes is as large as what it changes: created rows, changed rows and deleted ids are
materialised in the shared checkpoint folder (ids must not change when they are read again), and
frames become their old rows with these appended, joined or left out when they are read. Tables
that weren't changed stay scans of their files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverlane.graph import ID, LABELS, OWN, SOURCE, TARGET, Change, EdgeFrame, Frame, key_column, opened, typed_property
from quiverlane.lang import values as V
from quiverlane.lang.errors import Internal, compile_error, run_error
from quiverlane.lang.lowering import Reader
from quiverlane.lang.syntax import Create, Delete, EdgePattern, Label, LabelAnd, MapLiteral, Node, NodePattern, RemoveLabels, RemoveValue, SetLabels, SetValue, Update
from quiverlane.lang.values import Entity, Type, Value
from quiverlane.runtime import cut


def _labels(expression: Node | None) -> tuple[str, ...]:
    if expression is None:
        return ()
    if isinstance(expression, Label):
        return (expression.name,)
    if isinstance(expression, LabelAnd):
        return tuple(x for p in expression.parts for x in _labels(p))
    raise compile_error("InvalidArgumentType", "alternative labels can't be created")


class Writer(Reader):
    """Adds the writing clauses to a query; ``graph`` is replaced by each."""

    wrote = False

    def _replace(self, kind: str, changed: Mapping[int, Frame], next_id: int | None = None) -> None:
        """Puts new frames in the places of old ones."""
        g = self.graph
        frames = tuple(changed.get(i, f) for i, f in enumerate(getattr(g, kind)))
        g = replace(g, **{kind: frames}, next_id=g.next_id if next_id is None else next_id)
        if kind == "nodes":
            # edges that carried a node's columns must not show the old ones
            places = set(changed)
            edges = tuple(replace(e, owner=None, light=None, df=e.df.drop(*[c for c in e.df.columns if c.startswith(OWN)])) if e.owner and (e.source_place if e.owner == SOURCE else e.target_place) in places else e for e in g.edges)
            g = replace(g, edges=edges)
        self.graph, self.wrote = g, True

    # -- CREATE --

    def create(self, clause: Create) -> None:
        b = self.bindings
        self.graph = opened(self.graph, self.spark)
        made: list[tuple[str | None, str, tuple[str, ...], dict[str, Value], tuple | None]] = []
        ids: dict[int, Column] = {}
        table = b.table()
        row, base = b.fresh(), self.graph.next_id
        b.df = table.select("*", F.monotonically_increasing_id().alias(row))
        scope = dict(b.scope)
        total = sum(len(c.nodes) + len(c.edges) for c in clause.patterns)
        columns: list[Column] = []
        names: list[str] = []

        def new_column(c: Column) -> Column:
            names.append(b.fresh())
            columns.append(c.alias(names[-1]))
            return F.col(names[-1])

        def properties(p: MapLiteral | None) -> dict[str, Value]:
            found = {}
            for k, x in zip(p.keys, p.values) if p else ():
                v = V.plain(self.expressions(scope).value(x))
                if v.type.kind != "null":
                    found[k] = replace(v, column=new_column(V.as_column(v)), constant=False)
            return found

        def identity(n: int, edge: bool) -> Column:
            number = F.col(row) * total + (base + n)
            return new_column(F.concat_ws(":", F.lit("c"), number) if edge else V.coded(number, V.FRAMES - 1))

        place = frozenset([len(self.graph.nodes) - 1])

        def node(p: NodePattern, n: int) -> tuple[Column, frozenset[int]]:
            if p.variable and p.variable in scope:
                v = scope[p.variable]
                if v.type.kind != "node":
                    raise compile_error("VariableTypeConflict", f"{p.variable} is a {v.type}, where a node is needed")
                if p.labels or p.properties:
                    raise compile_error("VariableAlreadyBound", f"{p.variable} stands for something already")
                return V.identity(v), v.frames if isinstance(v, Entity) and v.frames else frozenset(range(len(self.graph.nodes)))
            held, labels, id = properties(p.properties), _labels(p.labels), identity(n, False)
            made.append((p.variable, "node", labels, held, None))
            ids[len(made) - 1] = id
            if p.variable:
                scope[p.variable] = self._entity("node", id, labels, held, place)
            return id, place

        n = 0
        for c in clause.patterns:
            if not c.edges and c.nodes[0].variable in scope:
                raise compile_error("VariableAlreadyBound", f"{c.nodes[0].variable} stands for something already")
            ends = []
            for p in c.nodes:
                ends.append(node(p, n))
                n += 1
            for e, left, right in zip(c.edges, ends, ends[1:]):
                self._check_edge(e, scope)
                source, target = (right, left) if e.direction == "<-" else (left, right)
                held, labels, id = properties(e.properties), _labels(e.labels), identity(n, True)
                n += 1
                made.append((e.variable, "edge", labels, held, (source, target)))
                ids[len(made) - 1] = id
                if e.variable:
                    scope[e.variable] = replace(self._entity("edge", id, labels, held, frozenset([len(self.graph.edges) - 1])), source=source[0], target=target[0])
        # properties may refer to nodes that the same clause creates, so columns are added one by one
        df = b.df
        for c in columns:
            df = df.select("*", c)
        b.df = cut(df)
        most = b.df.agg(F.max(row)).head()[0]
        nodes, edges = self.graph.nodes[-1], self.graph.edges[-1]
        for i, (_, kind, labels, held, ends) in enumerate(made):
            labelled = F.array(*[F.lit(x) for x in labels]).cast("array<string>").alias(LABELS)
            own = [v.column.alias(k) for k, v in held.items()]
            types = {k: v.type for k, v in held.items()}
            if kind == "node":
                nodes = _appended(nodes, b.df.select(ids[i].alias(ID), labelled, *own), types, [ID])
            else:
                (source, left), (target, right) = ends
                rows = b.df.where(source.isNotNull() & target.isNotNull()).select(ids[i].alias(ID), source.alias(SOURCE), target.alias(TARGET), labelled, *own)
                edges = replace(_appended(edges, rows, types, [ID, SOURCE, TARGET]), sources=edges.sources | left, targets=edges.targets | right)
        b.scope = scope
        self._replace("nodes", {len(self.graph.nodes) - 1: nodes})
        self._replace("edges", {len(self.graph.edges) - 1: edges}, base + ((most if most is not None else -1) + 1) * total)

    def _entity(self, kind: str, id: Column, labels: Sequence[str], held: Mapping[str, Value], frames: frozenset[int]) -> Entity:
        labelled = F.array(*[F.lit(x) for x in labels]).cast("array<string>")
        return Entity(Type(kind, fields=tuple(sorted((k, v.type) for k, v in held.items()))), id=id, labels=labelled, properties=held, frames=frames)

    def _check_edge(self, e: EdgePattern, scope: Mapping[str, Value]) -> None:
        if e.direction == "--":
            raise compile_error("RequiresDirectedRelationship", "a created edge needs a direction, -> or <-")
        if len(_labels(e.labels)) != 1:
            raise compile_error("NoSingleRelationshipType")
        if e.variable and e.variable in scope:
            raise compile_error("VariableAlreadyBound", f"{e.variable} stands for something already")

    # -- SET and REMOVE --

    def update(self, clause: Update) -> None:
        for action in clause.actions:
            name = action.variable
            if name not in self.bindings.scope:
                raise compile_error("UndefinedVariable", f"nothing is called {name} here")
            v = self.bindings.scope[name]
            if v.type.kind == "null":
                continue
            if not isinstance(v, Entity):
                raise run_error("InvalidArgumentType", f"{v.type} can't be changed")
            changed = self._bound_again(self._changed(v, action))
            self.bindings.scope = {**self.bindings.scope, name: changed}
            if isinstance(action, (SetLabels, RemoveLabels)):
                touched: set[str] = set()
            else:
                touched = {action.path[0]} if action.path else {*v.properties, *changed.properties}
            self._store(changed, touched, isinstance(action, (SetLabels, RemoveLabels)))

    def _changed(self, v: Entity, action: Node) -> Entity:
        if isinstance(action, SetLabels):
            return replace(v, labels=F.concat(v.labels, F.array(*[F.lit(x) for x in action.labels])))
        if isinstance(action, RemoveLabels):
            gone = F.array(*[F.lit(x) for x in action.labels])
            return replace(v, labels=F.filter(v.labels, lambda x: ~F.array_contains(gone, x)))
        if isinstance(action, RemoveValue):
            return _with(v, _assigned(V.map_value(v.properties), action.path, None, False))
        assert isinstance(action, SetValue)
        value = V.plain(self.expressions().value(action.value))
        if not action.path and value.type.kind in ("node", "edge"):
            value = Value(V.map_of(value.type.members, sparse=True), value.column["properties"])
        if (not action.path or action.merge) and value.type.kind not in ("map", "null"):
            raise run_error("InvalidArgumentType", f"a map is needed, not {value.type}")
        return _with(v, _assigned(V.map_value(v.properties), action.path, value, action.merge))

    def _bound_again(self, v: Entity) -> Entity:
        names = sorted(v.properties)
        columns = self.bindings.bind([v.labels, *[v.properties[k].column for k in names]])
        held = {k: replace(v.properties[k], column=c, constant=False) for k, c in zip(names, columns[1:])}
        return replace(v, labels=columns[0], properties=held, type=Type(v.type.kind, fields=tuple((k, held[k].type) for k in names)))

    def _store(self, v: Entity, touched: set[str], labels: bool) -> None:
        """Writes the touched properties, or the labels, of entities. Of several rows with one
        entity, the last one counts."""
        kind = "nodes" if v.type.kind == "node" else "edges"
        keys = [ID] if kind == "nodes" else [ID, SOURCE, TARGET]
        new = {k: v.properties[k] for k in touched if k in v.properties}
        state = F.struct(*([v.labels.alias(LABELS)] if labels else []), *[p.column.alias(k) for k, p in new.items()], F.lit(True).alias("__set"))
        rows = self.bindings.table().where(v.id.isNotNull()).select(V.identity(v).alias("__of"), state.alias("__new"), F.monotonically_increasing_id().alias("__row"))
        rows = cut(rows.groupBy("__of").agg(F.max_by("__new", "__row").alias("__new")))
        changed: dict[int, Frame] = {}
        for i in v.frames or range(len(getattr(self.graph, kind))):
            frame: Frame = getattr(self.graph, kind)[i]
            types = {k: V.unify(frame.properties.get(k, V.NULL), new[k].type if k in new else V.NULL) for k in {**frame.properties, **new}}
            types = _distinct_names({k: t for k, t in types.items() if t.kind != "null"})
            hit = F.col("__of").isNotNull()

            def column(k: str, t: Type, frame: Frame = frame, hit: Column = hit) -> Column:
                old = typed_property(frame.properties, k, t)
                if k not in touched:
                    return old.alias(k)
                now = V.cast(F.col("__new")[k], new[k].type, t) if k in new else F.lit(None).cast(V.spark_type(t))
                return F.when(hit, now).otherwise(old).alias(k)

            held = [F.when(hit, F.col("__new")[LABELS]).otherwise(frame.label_column()).alias(LABELS)] if labels else [F.col(LABELS)] if frame.labels is None else []
            own = [F.col(f"`{c}`") for c in frame.df.columns if c.startswith(OWN)]
            df = frame.df.join(rows, key_column(frame, ID) == F.col("__of"), "left").select(*keys, *held, *[column(k, t) for k, t in types.items()], *own)
            log = frame.logged(Change(gone=rows.select("__of"), key=ID), Change(rows=df.join(rows.select("__of"), key_column(frame, ID) == F.col("__of"), "left_semi")))
            changed[i] = replace(frame, df=df, labels=None if labels else frame.labels, properties=types, layers=frame.layers + 1, log=log, **_heavy(frame))
        self._replace(kind, changed)

    # -- DELETE --

    def delete(self, clause: Delete) -> None:
        gone: dict[str, list[tuple[DataFrame, frozenset[int]]]] = {"nodes": [], "edges": []}
        for x in clause.expressions:
            v = self.expressions().value(x)
            if v.type.kind == "null":
                continue
            if v.type.kind not in ("node", "edge"):
                raise compile_error("InvalidDelete", "only nodes and edges can be deleted")
            kind = v.type.kind + "s"
            frames = v.frames if isinstance(v, Entity) and v.frames else frozenset(range(len(getattr(self.graph, kind))))
            ids = self.bindings.table().select(V.identity(v).alias("__of")).where("__of is not null").distinct()
            gone[kind].append((cut(ids), frames))
        for ids, frames in gone["edges"]:
            self._without("edges", frames, ids, [ID])
        for ids, frames in gone["nodes"]:
            for i, f in enumerate(self.graph.edges):
                for side, reach in ((SOURCE, f.sources), (TARGET, f.targets)):
                    if not reach & frames:
                        continue
                    if clause.detach:
                        self._without("edges", frozenset([i]), ids, [side])
                    elif not self.graph.edges[i].df.join(ids, key_column(self.graph.edges[i], side) == F.col("__of"), "left_semi").isEmpty():
                        raise run_error("DeleteConnectedNode", "a node has edges; DETACH DELETE deletes them with it")
        for ids, frames in gone["nodes"]:
            self._without("nodes", frames, ids, [ID])

    def _without(self, kind: str, frames: frozenset[int], ids: DataFrame, keys: Sequence[str]) -> None:
        changed = {}
        for i in frames:
            frame: Frame = getattr(self.graph, kind)[i]
            df = frame.df
            for k in keys:
                df = df.join(ids, key_column(frame, k) == F.col("__of"), "left_anti")
            log = frame.logged(*[Change(gone=ids, key=k) for k in keys])
            changed[i] = replace(frame, df=df, layers=frame.layers + 1, log=log, **_heavy(frame))
        self._replace(kind, changed)


def _appended(frame: Frame, rows: DataFrame, types: Mapping[str, Type], keys: Sequence[str]) -> Frame:
    """A frame with more rows; a property that they disagree on becomes a tagged struct."""
    united = _distinct_names({k: V.unify(frame.properties.get(k, V.NULL), types.get(k, V.NULL)) for k in {**frame.properties, **types}})

    def part(df: DataFrame, held: Mapping[str, Type]) -> DataFrame:
        return df.select(*keys, LABELS, *[typed_property(held, k, t).alias(k) for k, t in united.items()])

    new = part(rows, types)
    df = part(frame.df, frame.properties).unionByName(new)
    return replace(frame, df=df, properties=united, layers=frame.layers + 1, log=frame.logged(Change(rows=new)))


def _heavy(frame: Frame) -> dict[str, None]:
    """Changes are to rows with ids, so there is no frame without them any more."""
    return {"light": None} if isinstance(frame, EdgeFrame) else {}


def _distinct_names(types: Mapping[str, Type]) -> Mapping[str, Type]:
    """Columns are found without regard to case, so names must not differ in case only."""
    if len({k.lower() for k in types}) < len(types):
        raise Internal["Unimplemented"](f"properties that differ in letter case only: {', '.join(sorted(types))}")
    return types


def _with(v: Entity, properties: Value) -> Entity:
    return replace(v, properties={k: Value(t, properties.column[k]) for k, t in properties.type.fields if t.kind != "null"})


def _assigned(held: Value, path: Sequence[str], value: Value | None, merge: bool) -> Value:
    """A map with the value at a path replaced (None: removed); maps on the way are made."""
    members = {k: Value(t, held.column[k]) for k, t in held.type.fields} if held.type.kind == "map" else {}
    if path:
        inner = members.get(path[0], V.literal(None))
        if value is None and inner.type.kind not in ("map", "null") and len(path) > 1:
            return held
        if len(path) > 1 or merge:
            if value is None and inner.type.kind == "null":
                return held
            members[path[0]] = _assigned(inner, path[1:], value, merge)
        elif value is None:
            members.pop(path[0], None)
        else:
            members[path[0]] = value
    elif value is not None and value.type.kind == "map":
        new = {k: Value(t, value.column[k]) for k, t in value.type.fields}
        members = {**members, **new} if merge else new
    elif not merge:
        members = {}
    return V.map_value(members, sparse=True)
