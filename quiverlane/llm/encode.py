"""Token ids and token counts of whole texts.

Defined results: a null and an empty text have no tokens (an empty list, a count of 0). Strings of
special tokens in a text are ordinary text. Rows are kept as they are, repeated ones and those
with a null key included.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlane.llm import bpe
from quiverlane.runtime import spread

#: The vocabulary that the queries use.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a public vocabulary lies: below $TOKENIZERS_DIR, in the installed package of them, or
    where that package is linked to. Executors need the file at the same place."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(folder, name)
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join("/opt/tokenizers", name)
    return public_tokenizers.path(name)


def encode_texts(docs: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """``<key>, ids``: the token ids of each text by the vocabulary file, without special tokens."""
    of = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.loaded(vocabulary)
        for batch in batches:
            at = 0
            for ids in model.encode(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(at, len(ids)), ids], ["key", "ids"])
                at += len(ids)

    return spread(docs.select(F.col(key), F.col(text))).mapInArrow(encode, f"key {of}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(docs: DataFrame, text: str, vocabulary: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the number of tokens of each text."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.loaded(vocabulary)
        for batch in batches:
            sizes = pa.array(model.count(batch.column(0)), pa.int64())
            yield pa.record_batch([*batch.columns[1:], sizes], [*keep, "n_tokens"])

    return spread(docs.select(F.col(text).alias("__text"), *keep)).mapInArrow(count, f"{fields}, n_tokens bigint")
