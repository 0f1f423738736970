"""Nested records as flat tables that keep the link from child to parent.

``flatten_objects`` turns the texts of a column into one row per object that is an element of an
array, at any depth. A batch of texts becomes a tape of tokens (functions/json_tape.py): the
parent index of a token plays the part of list offsets, keys and paths are propagated from parents
to children by a vectorised take, one level at a time, and no row is parsed on its own.

Defined results: texts that aren't strictly JSON, null texts and texts of anything but a map give
no rows; a JSON string which itself is the text of a map counts as that map. Nulls and scalars in
an array count for the index. All members of a repeated name are kept. An input row whose key is
null is kept with a null key. Repeated keys aren't reduced here, see :func:`latest_rows`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlane.functions.json_tape import CLOSE_LIST, CLOSE_MAP, COLON, COMMA, IN_LIST, IN_MAP, KEY, OPEN_LIST, OPEN_MAP, STRING, TOP, Tape
from quiverlane.runtime import with_workers

#: Bytes of text that are flattened at once; a longer text is flattened alone.
CHUNK_BYTES = 4 << 20


def latest_rows(table: DataFrame, key: str, columns: list[str], at: str) -> DataFrame:
    """One row per non-null key: ``columns`` of its latest row (ties: the greatest values)."""
    rest = [c for c in columns if c != key]
    best = F.max(F.struct(F.col(at).alias("__at"), *rest)).alias("__best")
    return table.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"__best.{c}").alias(c) for c in rest])


def object_rows(keys: pa.Array, texts: pa.Array, members: bool) -> Iterator[pa.RecordBatch]:
    """The rows of one chunk of texts, in one batch for the plain ones and one for the wrapped."""
    tape = Tape(texts)
    yield _rows(tape, keys, members)
    alone = np.zeros(len(texts), bool)
    top = np.flatnonzero((tape.kind == STRING) & (tape.container == TOP))
    alone[tape.text[top]] = True
    alone &= tape.valid
    if alone.any():
        top = top[alone[tape.text[top]]]
        bodies = tape.names(top)
        yield _rows(Tape(bodies), keys.take(pa.array(tape.text[top])), members)


def _rows(tape: Tape, keys: pa.Array, members: bool) -> pa.RecordBatch:
    kind, parent, container = tape.kind, tape.parent, tape.container
    opens = (kind == OPEN_MAP) | (kind == OPEN_LIST)
    rooted = np.zeros(len(tape.valid), bool)
    rooted[tape.text[(kind == OPEN_MAP) & (container == TOP)]] = True
    use = tape.valid & rooted
    nodes = np.flatnonzero(opens & use[tape.text])
    # the node that each opening bracket is, and the node that holds it
    node_of = np.full(len(kind) + 1, -1)
    node_of[nodes] = np.arange(len(nodes))
    up = node_of[np.where(parent[nodes] < 0, len(kind), parent[nodes])]
    level = tape.level[nodes]
    emitted = (kind[nodes] == OPEN_MAP) & (container[nodes] == IN_LIST)
    segment = _segments(tape, nodes)
    owner = np.full(len(nodes), -1)
    spot = np.zeros(len(nodes), np.int64)  # where the path of a node stands in ``paths``
    made: list[pa.Array] = []
    filled = 0
    # level by level: the path of a child is its parent's path and its own segment
    for depth in range(int(level.max()) + 1 if len(nodes) else 0):
        here = np.flatnonzero(level == depth)
        if depth == 0:
            made.append(pa.array(["$"] * len(here), pa.large_string()))
        else:
            made.append(_joined(made[-1].take(pa.array(spot[up[here]] - base)), segment.take(pa.array(here))))
            owner[here] = np.where(emitted[here], here, owner[up[here]])
        spot[here] = filled + np.arange(len(here))
        base, filled = filled, filled + len(here)
    paths = pa.concat_arrays([*made, pa.array(["$"], pa.large_string())])
    out = np.flatnonzero(emitted)
    child = paths.take(pa.array(spot[out]))
    held = owner[up[out]]
    parents = paths.take(pa.array(np.where(held < 0, filled, spot[held])))
    text = tape.text[nodes[out]]
    columns = [keys.take(pa.array(text)), parents.cast(pa.string()), child.cast(pa.string())]
    names = ["key", "parent_path", "child_path"]
    if members:
        columns += [pa.array(tape.index[nodes[out]].astype(np.int32)), _scalar_members(tape, nodes[out])]
        names += ["ordinal", "members"]
    return pa.record_batch(columns, names)


def _joined(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*[pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in parts], pa.scalar("", pa.large_string()))


def _segments(tape: Tape, nodes: np.ndarray) -> pa.Array:
    """``.name`` of map members and ``[i]`` of array elements."""
    in_list, in_map = tape.container[nodes] == IN_LIST, tape.container[nodes] == IN_MAP
    index = _joined("[", pa.array(tape.index[nodes]).cast(pa.large_string()), "]")
    names = pa.nulls(len(nodes), pa.large_string())
    members = np.flatnonzero(in_map)
    if len(members):
        # the name stands two tokens before its value
        dotted = _joined(".", tape.names(nodes[members] - 2))
        names = pc.replace_with_mask(names, pa.array(in_map), dotted)
    return pc.if_else(pa.array(in_list), index, names)


def _scalar_members(tape: Tape, objects: np.ndarray) -> pa.Array:
    """Per object, a map from the names of its members that aren't containers to their JSON texts.

    Of a repeated name the last member counts.
    """
    n = len(tape.kind)
    row = np.full(n + 1, -1)
    row[objects] = np.arange(len(objects))
    of = row[np.where(tape.parent < 0, n, tape.parent)]
    k = tape.kind
    value = np.flatnonzero((of >= 0) & ~np.isin(k, [KEY, COLON, COMMA, OPEN_MAP, OPEN_LIST, CLOSE_MAP, CLOSE_LIST]))
    names, texts = tape.names(value - 2), tape.raw(value)
    order = np.lexsort((np.arange(len(value)), of[value]))
    offsets = np.searchsorted(of[value][order], np.arange(len(objects) + 1))
    ids = np.asarray(pc.dictionary_encode(names).indices) if len(value) else np.zeros(0, np.int64)
    # drop all but the last member of each name
    last = np.ones(len(value), bool)
    if len(value):
        by = np.lexsort((np.arange(len(value)), ids, of[value]))
        same = (of[value][by][1:] == of[value][by][:-1]) & (ids[by][1:] == ids[by][:-1])
        last[by[:-1][same]] = False
        order = order[last[order]]
        offsets = np.searchsorted(of[value][order], np.arange(len(objects) + 1))
    taken = pa.array(order)
    return pa.MapArray.from_arrays(pa.array(offsets.astype(np.int32)), names.take(taken).cast(pa.string()), texts.take(taken).cast(pa.string()))


def chunks(sizes: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row spans of at most ``most`` bytes, but at least one row."""
    at, total = 0, np.cumsum(sizes)
    while at < len(sizes):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, "right")))
        yield at, to
        at = to


def flatten_objects(table: DataFrame, key: str, text: str, *, members: bool = False) -> DataFrame:
    """``<key>, parent_path, child_path`` and with ``members`` also ``ordinal, members``, per object in an array."""
    of = table.schema[key].dataType.simpleString()
    schema = f"key {of}, parent_path string, child_path string" + (", ordinal int, members map<string,string>" if members else "")

    def flatten(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for i, j in chunks(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
                for out in object_rows(keys.slice(i, j - i), texts.slice(i, j - i), members):
                    if out.num_rows:
                        yield out

    return with_workers(table.select(F.col(key), F.col(text))).mapInArrow(flatten, schema).withColumnRenamed("key", key)
