"""JSON texts as columns of tokens, without a parser that goes through rows.

``Tape`` holds the tokens of a whole batch of texts: kind, place, level, parent and, within an
array, the index. Each is computed for all tokens at once from the byte buffer of an Arrow string
column: strings are found by the parity of unescaped quotes, levels by a running sum of brackets,
parents by one search among the opening brackets ordered by level, and a text is valid if each of
its tokens may follow the token before it inside its container. Strictly RFC 8259: double quotes,
no trailing commas, no comments, no NaN.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quiverlane.functions.ragged import take_slices, text_buffer

START, OPEN_MAP, CLOSE_MAP, OPEN_LIST, CLOSE_LIST, COLON, COMMA, KEY, STRING, SCALAR = range(10)
TOP, IN_MAP, IN_LIST = range(3)

#: RFC 8259's scalars other than strings.
SCALARS = r"^(-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null)$"

_VALUE_END = (STRING, SCALAR, CLOSE_MAP, CLOSE_LIST)
_VALUE_START = (STRING, SCALAR, OPEN_MAP, OPEN_LIST)


def _grammar() -> np.ndarray:
    """may[container, token before, token]"""
    may = np.zeros((3, 10, 10), bool)
    may[TOP, START, list(_VALUE_START)] = True
    for before in (OPEN_LIST, COMMA):
        may[IN_LIST, before, list(_VALUE_START)] = True
    may[IN_MAP, COLON, list(_VALUE_START)] = True
    may[IN_MAP, [OPEN_MAP, COMMA], KEY] = True
    may[IN_MAP, KEY, COLON] = True
    for end in _VALUE_END:
        may[IN_MAP, end, [COMMA, CLOSE_MAP]] = True
        may[IN_LIST, end, [COMMA, CLOSE_LIST]] = True
    may[IN_MAP, OPEN_MAP, CLOSE_MAP] = True
    may[IN_LIST, OPEN_LIST, CLOSE_LIST] = True
    return may


_MAY = _grammar()
_KIND = np.zeros(256, np.int8)
for _c, _k in zip(b"{}[]:,", (OPEN_MAP, CLOSE_MAP, OPEN_LIST, CLOSE_LIST, COLON, COMMA)):
    _KIND[_c] = _k
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
_ESCAPABLE = np.zeros(256, bool)
_ESCAPABLE[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True


class Tape:
    """Tokens of a batch of texts in order of place. ``valid``: by text, whether it is JSON."""

    def __init__(self, texts: pa.Array) -> None:
        b, starts = text_buffer(texts)
        n = len(texts)
        self.data, self.starts = b, starts
        escaped = _escaped(b)
        quote = (b == 0x22) & ~escaped
        quotes = np.zeros(len(b) + 1, np.int64)
        np.cumsum(quote, out=quotes[1:])
        lengths = np.diff(starts)
        # parity counted from the start of each text; inside: after the opening quote, up to before the closing one
        base = np.repeat(quotes[starts[:-1]], lengths)
        odd = ((quotes[:-1] - base) & 1).astype(bool)
        inside = odd & ~quote
        ends = starts[1:] - 1
        bad = np.zeros(n, bool)
        bad |= ((quotes[ends] - quotes[starts[:-1]]) & 1).astype(bool)

        separator = np.zeros(len(b), bool)
        separator[ends] = True
        outside = ~odd & ~quote & ~separator
        kind = np.where(outside, _KIND[b], 0)
        plain = outside & (kind == 0) & ~_SPACE[b]
        opening = quote & ~odd
        run = plain.copy()
        run[1:] &= ~plain[:-1]
        at = np.flatnonzero((kind > 0) | opening | run)
        self.at = at
        self.text = np.searchsorted(starts, at, "right") - 1
        k = kind[at].astype(np.int64)
        k[opening[at]] = STRING
        k[run[at]] = SCALAR

        # what is wrong within strings, or outside of them
        wrong = inside & (b < 0x20)
        esc = np.flatnonzero(escaped & odd)
        bad[np.searchsorted(starts, np.flatnonzero(wrong), "right") - 1] = True
        if len(esc):
            ok = _ESCAPABLE[b[esc]]
            u = esc[b[esc] == 0x75]
            padded = np.concatenate([b, np.zeros(4, np.uint8)])
            hexed = _HEX[padded[u + 1]] & _HEX[padded[u + 2]] & _HEX[padded[u + 3]] & _HEX[padded[u + 4]]
            bad[np.searchsorted(starts, np.concatenate([esc[~ok], u[~hexed]]), "right") - 1] = True

        # ends of strings and scalars
        end = at + 1
        closing = np.flatnonzero(quote & odd)
        s = k == STRING
        where = np.searchsorted(closing, at[s])
        end[s] = np.append(closing, len(b))[where] + 1
        v = np.flatnonzero(k == SCALAR)
        if len(v):
            stops = np.flatnonzero(~plain)
            end[v] = stops[np.searchsorted(stops, at[v])]
            scalars = pc.dictionary_encode(take_slices(b, at[v], end[v] - at[v]))
            fits = pc.match_substring_regex(scalars.dictionary, SCALARS).to_numpy(zero_copy_only=False)
            bad[self.text[v[~fits[scalars.indices.to_numpy()]]]] = True
        self.end = end

        first = np.ones(len(at), bool)
        first[1:] = self.text[1:] != self.text[:-1]
        step = np.where((k == OPEN_MAP) | (k == OPEN_LIST), 1, 0) - np.where((k == CLOSE_MAP) | (k == CLOSE_LIST), 1, 0)
        total = np.cumsum(step)
        head = np.flatnonzero(first)
        begun = np.repeat(total[head] - step[head], np.diff(np.append(head, len(at)))) if len(at) else total
        after = total - begun
        level = np.where(step > 0, after - 1, after)  # brackets have the level of what holds them
        bad[self.text[level < 0]] = True
        if len(at):
            last = np.append(head[1:], len(at)) - 1
            bad[self.text[last[after[last] != 0]]] = True
        empty = np.ones(n, bool)
        empty[self.text] = False
        bad |= empty

        big = len(at) + 1
        opener = np.flatnonzero(step > 0)
        order = np.argsort(level[opener], kind="stable")
        keys = (level[opener] * big + opener)[order]

        def opened(at_level: np.ndarray, before: np.ndarray) -> np.ndarray:
            """The last opening bracket of the level before a token, or -1."""
            i = np.searchsorted(keys, at_level * big + before) - 1
            found = np.where(i >= 0, opener[order][np.maximum(i, 0)], -1) if len(opener) else np.full(len(at_level), -1)
            return np.where((found >= 0) & (level[np.maximum(found, 0)] == at_level), found, -1)

        index = np.arange(len(at))
        holder = opened(level - 1, index)
        holder[level <= 0] = -1
        close = step < 0
        matched = opened(level, index)
        of = np.where(close, matched, holder)
        container = np.where(of < 0, TOP, np.where(k[np.maximum(of, 0)] == OPEN_MAP, IN_MAP, IN_LIST)) if len(at) else k
        before = np.where(first, START, np.roll(k, 1)) if len(at) else k
        key = (k == STRING) & (container == IN_MAP) & ((before == OPEN_MAP) | (before == COMMA))
        k[key] = KEY
        before = np.where(first, START, np.roll(k, 1)) if len(at) else k
        bad[self.text[~_MAY[container, before, k]]] = True

        self.kind, self.level, self.parent, self.valid = k, level, holder, ~bad
        self.container = np.where(holder < 0, TOP, np.where(k[np.maximum(holder, 0)] == OPEN_MAP, IN_MAP, IN_LIST)) if len(at) else k
        self.index = self._indices()

    def _indices(self) -> np.ndarray:
        """For what an array holds, its place among the elements; else 0."""
        n = len(self.at)
        if not n:
            return np.zeros(0, np.int64)
        order = np.argsort(self.parent, kind="stable")
        comma = (self.kind[order] == COMMA).astype(np.int64)
        seen = np.cumsum(comma)
        group = self.parent[order]
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        base = np.repeat(seen[head] - comma[head], np.diff(np.append(head, n)))
        out = np.empty(n, np.int64)
        out[order] = seen - base
        return out

    def names(self, tokens: np.ndarray) -> pa.Array:
        """The decoded text of string tokens."""
        coded = pc.dictionary_encode(take_slices(self.data, self.at[tokens] + 1, self.end[tokens] - self.at[tokens] - 2))
        return pc.take(decoded(coded.dictionary), coded.indices)

    def raw(self, tokens: np.ndarray) -> pa.LargeStringArray:
        """The text of tokens as it stands."""
        return take_slices(self.data, self.at[tokens], self.end[tokens] - self.at[tokens])


def decoded(bodies: pa.Array) -> pa.Array:
    """The contents of JSON strings given without their quotes; halves of surrogate pairs become question marks."""
    slashed = pc.match_substring(bodies, "\\")
    if not pc.any(slashed).as_py():
        return bodies
    texts = json.loads("[" + ",".join(f'"{x}"' for x in bodies.filter(slashed).to_pylist()) + "]")
    plain = pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.large_string())
    return pc.replace_with_mask(bodies, slashed, plain)


def _escaped(b: np.ndarray) -> np.ndarray:
    """Bytes after an odd run of backslashes."""
    out = np.zeros(len(b), bool)
    at = np.flatnonzero(b == 0x5C)
    if len(at):
        new = np.append(True, np.diff(at) != 1)
        head = np.flatnonzero(new)
        nth = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
        after = at[nth % 2 == 0] + 1
        out[after[after < len(b)]] = True
    return out
