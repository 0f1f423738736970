"""Labels written as text: ``["A", "B"]`` or ``:A:B``."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlane.functions.json_tape import OPEN_LIST, STRING, TOP, Tape
from quiverlane.runtime import with_workers


def label_lists(texts: pa.Array) -> pa.ListArray:
    """The labels of each text, in order and repeated as they stand.

    The string members of a strictly valid JSON array; for a text that starts with a colon the
    non-empty pieces between colons; none for any other text, nor for null.
    """
    n = len(texts)
    colon = pc.fill_null(pc.starts_with(texts, ":"), False)
    pieces = pc.split_pattern(texts.filter(colon), ":")
    owners = np.repeat(np.flatnonzero(colon.to_numpy(zero_copy_only=False)), pc.list_value_length(pieces).to_numpy(zero_copy_only=False))
    names = pieces.flatten()
    some = pc.not_equal(names, "")
    owners, names = owners[some.to_numpy(zero_copy_only=False)], names.filter(some).cast(pa.large_string())

    tape = Tape(texts)
    listed = np.zeros(n, bool)
    listed[tape.text[(tape.kind == OPEN_LIST) & (tape.container == TOP)]] = True
    members = np.flatnonzero((tape.kind == STRING) & (tape.level == 1) & (tape.valid & listed)[tape.text])
    owners = np.concatenate([owners, tape.text[members]])
    names = pa.concat_arrays([names, tape.names(members).cast(pa.large_string())])
    order = np.argsort(owners, kind="stable")
    offsets = np.searchsorted(owners[order], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(order)).cast(pa.string()))


def parse_labels(table: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, labels``: the list of labels of each row."""
    of = table.schema[key].dataType.simpleString()

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), label_lists(batch.column(1).cast(pa.string()))], ["key", "labels"])

    return with_workers(table.select(F.col(key), F.col(text))).mapInArrow(parse, f"key {of}, labels array<string>").withColumnRenamed("key", key)
