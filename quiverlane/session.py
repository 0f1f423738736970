"""Connections: named graphs, queries against them, and their results.

    connection = connect(spark)
    connection.execute_oc_query("CREATE (:A {x: 1})")
    connection.execute_oc_query("MATCH (n) WHERE n.x = $x RETURN n", {"$x": 1})
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from quiverlane.graph import ID, LABELS, SOURCE, TARGET, Change, EdgeFrame, Frame, NodeFrame, PropertyGraph, empty_graph, typed_property
from quiverlane.lang import values as V
from quiverlane.lang.errors import Internal, Store, run_error
from quiverlane.lang.parser import parse
from quiverlane.lang.syntax import Create, CreateGraph, Delete, Match, Node, Procedure, Return, Unwind, Update, UseGraph, With
from quiverlane.lang.usage import uses
from quiverlane.lang.values import Type
from quiverlane.lang.writing import Writer
from quiverlane.runtime import cut

DEFAULT = "default"
#: Changes to a frame that are applied when it is read; beyond, its rows are written down.
MOST_LAYERS = 8


class Result:
    """The rows of a query. ``df`` is lazy; ``rows()`` brings them to the driver as plain values."""

    def __init__(self, df: DataFrame, types: Mapping[str, Type]) -> None:
        self.df, self.types = df, dict(types)

    def rows(self) -> list[list[Any]]:
        """A header and the rows: entities as dictionaries, missing properties left out."""
        kinds = list(self.types.values())
        try:
            found = self.df.collect()
        except PySparkException as e:
            raise as_query_error(e) from e
        return [list(self.types), *[[to_python(x, t) for x, t in zip(row, kinds)] for row in found]]


#: Conditions of Spark that a query's values cause.
VALUE_ERRORS = ("CAST_INVALID_INPUT", "CAST_OVERFLOW", "DIVIDE_BY_ZERO", "REMAINDER_BY_ZERO", "ARITHMETIC_OVERFLOW", "BINARY_ARITHMETIC_OVERFLOW")


def as_query_error(e: Exception) -> Exception:
    """The error of this package that an error of Spark stands for, if it is one of the query's values."""
    if told := re.search(r"RunTime: (\w+)(?:: ([^\n]*?))?(?: SQLSTATE|\n|$)", str(e)):
        return run_error(told[1], told[2] or "")
    caused = next((c for c in VALUE_ERRORS if f"[{c}" in str(e)), None)
    return run_error("InvalidArgument", f"[{caused}]") if caused else e


def to_python(x: Any, t: Type) -> Any:
    if x is None:
        return None
    if t == V.VARIANT:
        return x.toPython()
    if t.kind == "any":
        if x["k"] == V.RANKS["int"]:
            return x["d"] if x["i"] is None else x["i"]
        if x["k"] == V.RANKS["bool"]:
            return x["b"]
        return x["s"] if x["k"] in (V.RANKS["str"], V.RANKS["native"]) else json.loads(x["s"])
    if t.kind == "list":
        return [to_python(e, t.element) for e in x]
    if t.kind == "map":
        return {k: to_python(x[k], m) for k, m in t.fields if x[k] is not None or not t.sparse}
    if t.kind in ("node", "edge"):
        held = {k: to_python(x["properties"][k], m) for k, m in t.fields}
        return {"type": t.kind, "key": x["id"], "labels": list(x["labels"] or ()), "properties": {k: v for k, v in held.items() if v is not None}}
    if t.kind == "path":
        inner = {k: Type("edge" if k == "edge" else "node", fields=t.members[k].fields) for k in ("source", "edge", "destination")}
        parts = {k: to_python(x[k], m) for k, m in inner.items()}
        return {**parts["edge"], "type": "path", "source": parts["source"], "destination": parts["destination"]}
    return x


class _Graphs(dict):
    """Graphs by name; one that is given as a function is opened when it is first asked for."""

    def __getitem__(self, name: str) -> PropertyGraph:
        held = super().__getitem__(name)
        if callable(held):
            self[name] = held = held()
        return held


class Connection:
    """Named graphs that queries read and write. Each query between semicolons takes effect as a
    whole or not at all, and begins in the graph ``default``."""

    def __init__(self, spark: SparkSession, graphs: Mapping[str, PropertyGraph | Callable[[], PropertyGraph]] | None = None, store: ParquetStore | None = None) -> None:
        self.spark, self.store = spark, store
        self.graphs = _Graphs({**(store.load(spark) if store else {}), **(graphs or {})})
        if DEFAULT not in self.graphs:
            self.graphs[DEFAULT] = empty_graph(spark)

    # -- queries --

    def run(self, query: str, parameters: Mapping[str, Any] | None = None) -> list[Result | None]:
        """The result of each query of a text; None for a query that returns nothing."""
        return [self._run(q, parameters or {}) for q in parse(query)]

    def execute(self, query: str, parameters: Mapping[str, Any] | None = None) -> DataFrame | None:
        """The rows of the last query of a text as a lazy DataFrame."""
        result = self.run(query, parameters)[-1]
        return None if result is None else result.df

    def execute_oc_query(self, query: str, bindings: Mapping[str, Any] | None = None) -> Any:
        """Rows as plain values: a list of the header and the rows, None without RETURN, and for
        several results a dictionary of them."""
        results = [None if r is None else r.rows() for r in self.run(query, bindings)]
        return results[0] if len(results) == 1 else {"type": "results", "results": results}

    def _run(self, statements: Sequence[Node], parameters: Mapping[str, Any]) -> Result | None:
        name = DEFAULT
        graphs = _Graphs(self.graphs)
        query = Writer(self.spark, graphs[name], parameters, uses(statements))
        touched: set[str] = set()
        result: Result | None = None
        for s in statements:
            if isinstance(s, (CreateGraph, UseGraph)):
                graphs[name] = query.graph
                touched |= {name} if query.wrote else set()
                if isinstance(s, CreateGraph):
                    if s.name in graphs:
                        raise run_error("DuplicatedGraph", f"there is a graph {s.name} already")
                    graphs[s.name] = empty_graph(self.spark)
                    touched.add(s.name)
                elif s.name not in graphs:
                    raise run_error("UnknownGraph", f"there is no graph {s.name}")
                name = s.name
                query.graph = graphs[name]
                query.wrote = False
            elif isinstance(s, Match):
                query.match(s)
            elif isinstance(s, Unwind):
                query.unwind(s)
            elif isinstance(s, With):
                query.project(s.star, s.items, s.where, s.modifiers)
            elif isinstance(s, Create):
                query.create(s)
            elif isinstance(s, Update):
                query.update(s)
            elif isinstance(s, Delete):
                query.delete(s)
            elif isinstance(s, Procedure):
                if not ("." + s.name).endswith(".internal.stats"):
                    raise Internal["Unimplemented"](s.name)
                result = statistics(graphs[DEFAULT] if name != DEFAULT else query.graph)
                break
            elif isinstance(s, Return):
                query.project(s.star, s.items, None, s.modifiers)
                result = Result(query.result(), {n: _result_type(v) for n, v in query.bindings.scope.items()})
                break
        graphs[name] = query.graph
        touched |= {name} if query.wrote else set()
        for t in touched:
            graphs[t] = self._committed(t, graphs[t])
        if touched:
            if self.store:
                self.store.commit(self.spark, list(graphs))
            self.graphs = graphs
        return result

    def _committed(self, name: str, graph: PropertyGraph) -> PropertyGraph:
        """The graph as later queries read it; frames that many changes are piled on are written down."""
        if self.store:
            return self.store.written(self.spark, name, graph.flattened(self.spark))

        def settled(frame: Frame) -> Frame:
            return replace(frame, df=cut(frame.df), layers=0) if frame.layers > MOST_LAYERS else frame

        return replace(graph, nodes=tuple(map(settled, graph.nodes)), edges=tuple(map(settled, graph.edges)))

    # -- graphs --

    def graphs_list(self) -> list[str]:
        return sorted(self.graphs)

    def delete_graph(self, name: str) -> None:
        if name not in self.graphs:
            raise Store["UnknownGraph"](f"there is no graph {name}")
        graphs = _Graphs({n: g for n, g in self.graphs.items() if n != name})
        if self.store:
            self.store.manifest.pop(name, None)
            self.store.commit(self.spark, sorted({*graphs, DEFAULT}))
        graphs.setdefault(DEFAULT, empty_graph(self.spark))
        self.graphs = graphs


def _result_type(v: V.Value) -> Type:
    if isinstance(v, V.Path):
        return Type("path", fields=(("destination", v.end.type), ("edge", v.edge.type), ("source", v.start.type)))
    return v.type


def statistics(graph: PropertyGraph) -> Result:
    """Numbers of nodes, edges, distinct node labels and properties that aren't null."""

    def held(f) -> list:
        return [F.count(F.when(F.col(f"`{p}`").isNotNull(), 1)) for p in f.properties]

    def total(counts: list):
        out = F.lit(0).cast("bigint")
        for c in counts:
            out = out + c
        return out

    columns = "nodes_count bigint, edges_count bigint, properties_count bigint"
    parts = [f.df.agg(F.count(F.lit(1)).alias("nodes_count"), F.lit(0).cast("bigint").alias("edges_count"), total(held(f)).alias("properties_count")) for f in graph.nodes]
    parts += [f.df.agg(F.lit(0).cast("bigint").alias("nodes_count"), F.count(F.lit(1)).alias("edges_count"), total(held(f)).alias("properties_count")) for f in graph.edges]
    spark = (graph.nodes or graph.edges)[0].df.sparkSession
    counts = spark.createDataFrame([], columns)
    labels = spark.createDataFrame([], "label string")
    for p in parts:
        counts = counts.unionByName(p)
    for f in graph.nodes:
        # fixed labels count where the frame has a row
        own = f.df.select(F.explode(LABELS).alias("label")) if f.labels is None else f.df.limit(1).select(F.explode(f.label_column()).alias("label"))
        labels = labels.unionByName(own)
    n_labels = labels.agg(F.count_distinct("label").alias("n")).scalar()
    summed = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("nodes_count", "edges_count", "properties_count")]
    names = ["nodes_count", "edges_count", "labels_nodes_count", "properties_count"]
    df = counts.agg(*summed).select("nodes_count", "edges_count", n_labels.alias("labels_nodes_count"), "properties_count")
    return Result(df, {n: V.INT for n in names})


class ParquetStore:
    """Graphs as Parquet in a folder.

    A graph is a list of segments for its nodes and one for its edges, each rows that came or keys
    whose earlier rows are gone; a commit writes what changed as new segments. Which segments a graph
    has is told by numbered manifests. A commit takes effect when the next number is written, and
    fails if another session wrote it before; a reader takes the highest one that is complete. So
    all of a commit is seen or nothing of it, wherever it is cut off.
    """

    #: Segments of a graph's nodes or edges; beyond, they are written together.
    MOST_SEGMENTS = 16
    #: Manifests that are left for readers of earlier states.
    KEPT = 20

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")
        self.manifest: dict[str, dict[str, Any]] = {}
        self.number = 0
        #: As of the last commit.
        self.committed: dict[str, dict[str, Any]] = {}

    def _files(self, spark: SparkSession):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, spark: SparkSession) -> list[int]:
        """The numbers of all manifests, the highest first."""
        path, fs = self._files(spark)
        names = [f.getPath().getName() for f in fs.listStatus(path(self.folder))] if fs.exists(path(self.folder)) else []
        return sorted((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), reverse=True)

    def _path(self, number: int) -> str:
        return f"{self.folder}/manifest-{number:012d}.json"

    def load(self, spark: SparkSession) -> dict[str, PropertyGraph]:
        numbers = self._numbers(spark)
        self.number = numbers[0] if numbers else 0
        for n in numbers:
            text = "".join(r.value for r in spark.read.text(self._path(n), wholetext=True).collect())
            try:
                self.manifest = json.loads(text)
            except ValueError:
                continue  # its commit was cut off
            self.committed = self.manifest
            return {name: self._read(spark, m) for name, m in self.manifest.items()}
        return {}

    def _read(self, spark: SparkSession, m: Mapping[str, Any]) -> PropertyGraph:
        one = frozenset([0])
        node = NodeFrame(*self._merged(spark, m["nodes"], [ID]), open=True, log=())
        edge = EdgeFrame(*self._merged(spark, m["edges"], [ID, SOURCE, TARGET]), open=True, log=(), sources=one, targets=one)
        return PropertyGraph((node,), (edge,), m["next_id"])

    def _merged(self, spark: SparkSession, segments: Sequence[Mapping[str, str]], keys: Sequence[str]) -> tuple[DataFrame, None, dict[str, Type]]:
        parts = [(s, spark.read.parquet(f"{self.folder}/{s['folder']}")) for s in segments]
        types: dict[str, Type] = {}
        held = [{f.name: V.type_of(f.dataType) for f in df.schema.fields if f.name not in (*keys, LABELS)} if s["key"] == "" else {} for s, df in parts]
        for h in held:
            for n, t in h.items():
                types[n] = V.unify(types.get(n, V.NULL), t)
        out: DataFrame | None = None
        for (s, df), h in zip(parts, held):
            if s["key"]:
                out = out.join(df, F.col(s["key"]) == F.col("__of"), "left_anti")
            else:
                rows = df.select(*keys, LABELS, *[typed_property(h, n, t).alias(n) for n, t in types.items()])
                out = rows if out is None else out.unionByName(rows)
        return out, None, types

    def written(self, spark: SparkSession, name: str, graph: PropertyGraph) -> PropertyGraph:
        """Writes what changed in a graph, or all of one that isn't from this store."""
        before = self.manifest.get(name)
        entry: dict[str, Any] = {"next_id": graph.next_id}
        for kind, frame, keys in (("nodes", graph.nodes[0], [ID]), ("edges", graph.edges[0], [ID, SOURCE, TARGET])):
            old = before[kind] if before else []
            log = frame.log
            if not old or log is None or len(old) + len(log) > self.MOST_SEGMENTS:
                old, log = [], (Change(rows=frame.df),)
            entry[kind] = [*old, *[self._segment(c, kind, keys) for c in log]]
        self.manifest = {**self.manifest, name: entry}
        return self._read(spark, entry)

    def _segment(self, change: Change, kind: str, keys: Sequence[str]) -> dict[str, str]:
        folder = f"{kind}-{uuid.uuid4().hex}"
        if change.rows is None:
            rows = change.gone.select("__of")
        else:
            # a property that is null everywhere has no type to be written with
            names = [f.name for f in change.rows.schema.fields if f.name not in (*keys, LABELS) and not isinstance(f.dataType, NullType)]
            rows = change.rows.select(*keys, LABELS, *[F.col(f"`{n}`") for n in names])
        # few rows are one file, many are files of the usual size
        rows.hint("rebalance").write.parquet(f"{self.folder}/{folder}")
        return {"folder": folder, "key": change.key}

    def commit(self, spark: SparkSession, names: Sequence[str]) -> None:
        """Makes what was written the state of the graphs of these names; others are gone."""
        for n in names:
            if n not in self.manifest:
                self.written(spark, n, empty_graph(spark))
        self.manifest = {n: m for n, m in self.manifest.items() if n in names}
        path, fs = self._files(spark)
        number = self.number + 1
        try:
            out = fs.create(path(self._path(number)), False)
        except Exception as e:
            self.manifest = self.committed
            raise Store["OpeningError"](f"another session committed number {number} to {self.folder}") from e
        out.write(bytearray(json.dumps(self.manifest).encode()))
        out.close()
        self.number, self.committed = number, self.manifest
        for n in self._numbers(spark)[self.KEPT :]:
            fs.delete(path(self._path(n)), False)


#: What graphs can be kept in.
BACKENDS = ("parquet", "memory")


def connect(spark: SparkSession, path: str | None = None, backend: str | None = None, graphs: Mapping[str, PropertyGraph] | None = None) -> Connection:
    """A connection to the graphs kept in the folder ``path``, or to graphs of this session only."""
    if backend is not None and backend not in BACKENDS:
        raise Store["UnknownBackend"](f"graphs can be kept in {' or '.join(BACKENDS)}, not in {backend}")
    if backend == "parquet" and path is None:
        raise Store["OpeningError"]("a folder is needed to keep graphs in")
    store = ParquetStore(path) if path is not None and backend != "memory" else None
    return Connection(spark, graphs, store)


