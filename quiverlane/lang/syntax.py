"""The syntax tree of a query."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import Any


@dataclass(frozen=True)
class Node:
    """Any part of the tree."""

    def children(self) -> Iterator[Node]:
        for f in fields(self):
            yield from _nodes(getattr(self, f.name))

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children():
            yield from c.walk()


def _nodes(value: Any) -> Iterator[Node]:
    if isinstance(value, Node):
        yield value
    elif isinstance(value, (list, tuple)):
        for v in value:
            yield from _nodes(v)


# -- expressions ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Literal(Node):
    value: Any  # None, bool, int, float or str


@dataclass(frozen=True)
class ListLiteral(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class MapLiteral(Node):
    keys: tuple[str, ...]
    values: tuple[Node, ...]


@dataclass(frozen=True)
class Parameter(Node):
    name: str


@dataclass(frozen=True)
class Variable(Node):
    name: str


@dataclass(frozen=True)
class Member(Node):
    of: Node
    path: tuple[str, ...]


@dataclass(frozen=True)
class Index(Node):
    of: Node
    index: Node


@dataclass(frozen=True)
class Slice(Node):
    of: Node
    start: Node | None
    end: Node | None


@dataclass(frozen=True)
class Unary(Node):
    op: str  # NOT, -
    of: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class IsNull(Node):
    of: Node
    negated: bool


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class LabelTest(Node):
    variable: str
    labels: tuple[str, ...]


# -- patterns ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Label(Node):
    name: str


@dataclass(frozen=True)
class LabelAnd(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class LabelOr(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class NodePattern(Node):
    variable: str | None
    labels: Node | None
    properties: MapLiteral | None


@dataclass(frozen=True)
class EdgePattern(Node):
    variable: str | None
    labels: Node | None
    properties: MapLiteral | None
    direction: str  # ->, <- or --


@dataclass(frozen=True)
class Chain(Node):
    nodes: tuple[NodePattern, ...]
    edges: tuple[EdgePattern, ...]
    path: str | None = None


# -- statements ----------------------------------------------------------------------------


@dataclass(frozen=True)
class CreateGraph(Node):
    name: str


@dataclass(frozen=True)
class UseGraph(Node):
    name: str


@dataclass(frozen=True)
class Create(Node):
    patterns: tuple[Chain, ...]


@dataclass(frozen=True)
class Match(Node):
    patterns: tuple[Chain, ...]
    where: Node | None
    optional: bool


@dataclass(frozen=True)
class Item(Node):
    expression: Node
    name: str
    aliased: bool


@dataclass(frozen=True)
class SortKey(Node):
    expression: Node
    descending: bool


@dataclass(frozen=True)
class Modifiers(Node):
    order: tuple[SortKey, ...] = ()
    skip: Node | None = None
    limit: Node | None = None


@dataclass(frozen=True)
class Return(Node):
    star: bool
    items: tuple[Item, ...]
    modifiers: Modifiers


@dataclass(frozen=True)
class With(Node):
    star: bool
    items: tuple[Item, ...]
    where: Node | None
    modifiers: Modifiers


@dataclass(frozen=True)
class Unwind(Node):
    item: Item


@dataclass(frozen=True)
class Procedure(Node):
    name: str


@dataclass(frozen=True)
class Delete(Node):
    expressions: tuple[Node, ...]
    detach: bool


@dataclass(frozen=True)
class SetValue(Node):
    variable: str
    path: tuple[str, ...]
    value: Node
    merge: bool  # +=


@dataclass(frozen=True)
class SetLabels(Node):
    variable: str
    labels: tuple[str, ...]


@dataclass(frozen=True)
class RemoveValue(Node):
    variable: str
    path: tuple[str, ...]


@dataclass(frozen=True)
class RemoveLabels(Node):
    variable: str
    labels: tuple[str, ...]


@dataclass(frozen=True)
class Update(Node):
    actions: tuple[Node, ...]
