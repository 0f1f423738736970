"""Kernels over variable-length slices of one buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all slices one after the other, and the offsets of the slices in them."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    index = np.arange(offsets[-1], dtype=np.int64)
    index += np.repeat(starts.astype(np.int64) - offsets[:-1], lengths)
    return index, offsets


def take_slices(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.LargeStringArray:
    """The slices of a UTF-8 buffer as an Arrow array."""
    index, offsets = ragged_index(starts, lengths)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[index])))


def text_buffer(texts: pa.Array, separator: bytes = b"\0") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts with a separator after each, and the start of each text.

    Nulls count as empty. The last entry of the starts is the length of the buffer.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    starts = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths + len(separator), out=starts[1:])
    out = np.empty(starts[-1], np.uint8)
    if len(lengths):
        keep = np.ones(len(out), bool)
        for k, b in enumerate(separator):
            at = starts[1:] - len(separator) + k
            out[at] = b
            keep[at] = False
        out[keep] = data[offsets[0] : offsets[-1]]
    return out, starts
