"""Property graphs over DataFrames.

A graph is a list of *node frames* and *edge frames*. A frame that was built from a table has fixed
labels and typed property columns, so a pattern's labels choose tables, and filters and column
pruning reach their scans. A frame of nodes or edges that queries created has a column of labels;
properties of mixed types are tagged structs there.

A node is known by its table's integer key and the place of the table, so joins are on the tables'
own columns as long as a pattern's ends have one table each. Edge ids are texts and only computed
where a query tells edges apart. An edge that is a foreign key in a table of nodes carries that
table's columns, so following it doesn't join the table with itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlane.lang import values as V
from quiverlane.lang.values import Type

ID, LABELS, SOURCE, TARGET = "__id", "__labels", "__source", "__target"
#: Prefix of the columns of the node that an edge's row belongs to.
OWN = "__own_"


@dataclass(frozen=True)
class Change:
    rows: DataFrame | None = None
    gone: DataFrame | None = None
    key: str = ""


@dataclass(frozen=True)
class Frame:
    """``labels``: those of every row, or None where the frame has a column of them."""

    df: DataFrame
    labels: tuple[str, ...] | None
    properties: dict[str, Type]
    #: Changes that reading the frame applies: rows appended, joined or left out.
    layers: int = 0
    #: Whether created rows may be appended.
    open: bool = False
    #: What was changed since the frame was read from a store, None if it wasn't read from one: rows that
    #: came and their types, or values (``__of``) of a key column whose rows are gone.
    log: tuple[Change, ...] | None = None

    def logged(self, *changes: Change) -> tuple[Change, ...] | None:
        return None if self.log is None else (*self.log, *changes)

    def label_column(self) -> Column:
        return F.col(LABELS) if self.labels is None else F.array(*[F.lit(x) for x in self.labels]).cast("array<string>")


@dataclass(frozen=True)
class NodeFrame(Frame):
    """``place``: that of the frame, if its ids are the keys of a table (``table``, ``key``)."""

    place: int | None = None
    table: DataFrame | None = None
    key: str = ""


@dataclass(frozen=True)
class EdgeFrame(Frame):
    """``sources``, ``targets``: the node frames that its ends are in. ``complete``: all ends exist.

    ``source_place``, ``target_place``: the frame whose keys the ends are, or None for ids.
    ``owner``: SOURCE or TARGET, if a row is also the row of that node; its properties are then in
    the columns that begin with OWN. ``light``: the frame without ids, where they cost something.
    """

    sources: frozenset[int] = frozenset()
    targets: frozenset[int] = frozenset()
    complete: bool = True
    source_place: int | None = None
    target_place: int | None = None
    owner: str | None = None
    light: DataFrame | None = None


@dataclass(frozen=True)
class PropertyGraph:
    nodes: tuple[NodeFrame, ...] = ()
    edges: tuple[EdgeFrame, ...] = ()
    #: The next id of a created node or edge.
    next_id: int = 0
    _places: dict[str, int] = field(default_factory=dict)

    # -- from tables -----------------------------------------------------------------------

    def with_nodes(self, label: str | Sequence[str], df: DataFrame, key: str, properties: Sequence[str] | None = None) -> PropertyGraph:
        """Adds a table of nodes. ``key`` is an integer column, unique and not null; all columns
        are properties unless some are named."""
        labels = (label,) if isinstance(label, str) else tuple(label)
        names = list(df.columns if properties is None else properties)
        place = len(self.nodes)
        if place >= V.FRAMES - 1:
            raise ValueError(f"a graph has at most {V.FRAMES - 1} tables of nodes")
        made = df.select(F.col(key).cast("bigint").alias(ID), *[_property(df, n) for n in names])
        frame = NodeFrame(made, labels, {n: V.type_of(made.schema[n].dataType) for n in names}, place=place, table=df, key=key)
        return replace(self, nodes=(*self.nodes, frame), _places=self._places | {labels[0]: place})

    def with_edges(self, label: str, df: DataFrame, source: tuple[str, str], target: tuple[str, str], key: str | None = None, properties: Sequence[str] = (), complete: bool = True) -> PropertyGraph:
        """Adds a table of edges. ``source`` and ``target`` are a node label and the column that refers
        to its key; rows where one is null are no edges.

        ``key`` is a unique column. Without it, edges are told apart by file and row, which needs a
        table that is read from files. ``complete=False`` where a reference may lead nowhere.
        """
        s, t = self._places[source[0]], self._places[target[0]]
        place = len(self.edges)
        # a table of nodes whose own key is one end: each of its rows is also that node
        owners = [(end, self.nodes[i]) for end, i, column in ((SOURCE, s, source[1]), (TARGET, t, target[1])) if self.nodes[i].table is df and self.nodes[i].key == column]
        owner, node = owners[0] if owners else (None, None)
        own = [_property(df, n).alias(OWN + n) for n in node.properties] if node else []
        ends = df.where(F.col(source[1]).isNotNull() & F.col(target[1]).isNotNull())
        columns = [F.col(source[1]).cast("bigint").alias(SOURCE), F.col(target[1]).cast("bigint").alias(TARGET), *[_property(df, n) for n in properties], *own]
        light = None
        if key is None:
            try:
                made = ends.select(F.concat_ws(":", F.lit(place), F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias(ID), *columns)
            except AnalysisException as e:
                raise ValueError("edges without a key have to be read from files") from e
            light = ends.select(F.lit(None).cast("string").alias(ID), *columns)
        else:
            made = ends.select(F.concat_ws(":", F.lit(place), F.col(key)).alias(ID), *columns)
        frame = EdgeFrame(made, (label,), {n: V.type_of(made.schema[n].dataType) for n in properties}, sources=frozenset([s]), targets=frozenset([t]), complete=complete, source_place=s, target_place=t, owner=owner, light=light)
        return replace(self, edges=(*self.edges, frame))

    # -- as one table of nodes and one of edges -----------------------------------------------

    def flattened(self, spark: SparkSession) -> PropertyGraph:
        """The same graph in one node frame and one edge frame with label columns, as stores keep it."""
        nodes, edges = self.nodes, self.edges
        if len(nodes) == len(edges) == 1 and nodes[0].open and edges[0].open and edges[0].sources <= {0} and edges[0].targets <= {0}:
            return self
        one = frozenset([0])
        node = NodeFrame(*_united(nodes or (empty_nodes(spark),), [ID]), open=True)
        edge = EdgeFrame(*_united(edges or (empty_edges(spark),), [ID, SOURCE, TARGET]), open=True, sources=one, targets=one, complete=all(e.complete for e in edges))
        return PropertyGraph((node,), (edge,), self.next_id)


def _property(df: DataFrame, name: str) -> Column:
    kind = V.type_of(df.schema[name].dataType).kind
    c = F.col(f"`{name}`")
    return (c.cast("bigint") if kind == "int" else c.cast("double") if kind == "float" else c).alias(name)


def empty_nodes(spark: SparkSession) -> NodeFrame:
    return NodeFrame(spark.createDataFrame([], f"{ID} bigint, {LABELS} array<string>"), None, {}, open=True)


def empty_edges(spark: SparkSession) -> EdgeFrame:
    return EdgeFrame(spark.createDataFrame([], f"{ID} string, {SOURCE} bigint, {TARGET} bigint, {LABELS} array<string>"), None, {}, open=True)


def has_open_frames(g: PropertyGraph) -> bool:
    return bool(g.nodes) and bool(g.edges) and g.nodes[-1].open and g.edges[-1].open


def opened(g: PropertyGraph, spark: SparkSession) -> PropertyGraph:
    """The graph with frames at the ends of its lists that created rows can be appended to."""
    if has_open_frames(g):
        return g
    return replace(g, nodes=(*g.nodes, empty_nodes(spark)), edges=(*g.edges, empty_edges(spark)))


def empty_graph(spark: SparkSession) -> PropertyGraph:
    return PropertyGraph((empty_nodes(spark),), (empty_edges(spark),))


def _united(frames: Sequence[Frame], keys: Sequence[str]) -> tuple[DataFrame, None, dict[str, Type]]:
    types: dict[str, Type] = {}
    for f in frames:
        for n, t in f.properties.items():
            types[n] = V.unify(types.get(n, V.NULL), t)
    parts = [f.df.select(*[key_column(f, k).alias(k) for k in keys], f.label_column().alias(LABELS), *[typed_property(f.properties, n, t).alias(n) for n, t in types.items()]) for f in frames]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, None, types


def key_column(f: Frame, key: str) -> Column:
    """A key column of a frame as ids."""
    places = {ID: f.place} if isinstance(f, NodeFrame) else {SOURCE: f.source_place, TARGET: f.target_place}
    return V.coded(F.col(key), places.get(key))


def typed_property(held: Mapping[str, Type], name: str, to: Type) -> Column:
    """A property column as a type that its own was unified into; null if the frame hasn't it."""
    if name in held:
        return V.cast(F.col(f"`{name}`"), held[name], to)
    return F.lit(None).cast(V.spark_type(to))
