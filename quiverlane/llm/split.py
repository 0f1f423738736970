"""The pre-tokens of byte-level BPE, found for all characters of a batch at once.

The pattern is public: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
A piece begins where the class of characters (letter, number, space, other) changes, with two
corrections: the last blank before a piece belongs to it, any other last white space stands alone;
and an apostrophe that begins a piece takes a contraction's letters from the piece after it.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

LETTER, NUMBER, OTHER, SPACE = range(4)

#: Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def piece_starts(points: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each code point; ``text_start``: whether a text begins there."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[points]
    start = text_start.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    after = np.flatnonzero(space[:-1] & ~space[1:] & ~text_start[1:]) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False

    quote = np.flatnonzero(points == 0x27)
    quote = quote[start[quote]]
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~text_start[quote + 1]]
    if len(quote):
        ends = np.concatenate([points, np.zeros(3, points.dtype)])
        same = np.concatenate([(kind == LETTER) & ~text_start, np.zeros(3, bool)])
        a, b = ends[quote + 1], np.where(same[quote + 2], ends[quote + 2], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        start[quote[one | two] + 1] = False
        rest = np.concatenate([quote[one] + 2, quote[two] + 3])
        start[rest[same[rest]]] = True
    return start
