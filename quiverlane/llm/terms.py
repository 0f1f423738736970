"""How often every distinct value, and every sequence of values, occurs and in how many records.

Records are cut into blocks of whole records. The values of a block become one sequence of codes
with a separator after each record, whose suffixes a suffix array sorts to their ends (doubled
ranks). Suffixes that begin with the same n-gram are neighbours there, so n-grams are the *intervals*
of neighbours with a common prefix: an interval whose suffixes share v codes, inside one that shares
u < v, stands for its prefixes of u + 1 to v codes, which all occur as often as it has suffixes. The
records of an interval are its suffixes less the duplicates: a suffix whose predecessor of the same
record is in the interval too. Each such pair belongs to the smallest interval that holds both and
so to all around it, which running sums count. As records aren't split, the counts of blocks add
up; a value that a third of all records carry is one row per block by then.

Defined results: null values break a sequence, like the end of the record, and are not counted. A
record without values counts only for the number of records.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlane.runtime import with_workers

#: Values of a block, as a bound on memory; a longer record is a block of its own.
BLOCK = 400_000


def _left(codes: np.ndarray) -> np.ndarray:
    """Codes from each position to the end of its record."""
    ends = np.flatnonzero(codes == 0)
    return ends[np.searchsorted(ends, np.arange(len(codes)))] - np.arange(len(codes))


def suffix_array(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ``codes`` that aren't empty, sorted to the end of their record, ties in order of
    position; and the length of the prefix that each shares with the one before it.

    0 is the separator; what comes after one doesn't count.
    """
    left = _left(codes)
    ranks = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]
    reach = 1
    while reach < left.max(initial=0):
        rank = ranks[-1]
        after = np.zeros_like(rank)
        after[:-reach] = rank[reach:]
        # a suffix that has ended within its reach isn't told apart by what follows
        after[left < reach] = 0
        pair = rank * (int(rank.max(initial=0)) + 1) + after
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        reach *= 2
    order = np.argsort(ranks[-1], kind="stable")
    order = order[left[order] > 0]
    shared = np.zeros(len(order), np.int64)
    a, b = order[1:].copy(), order[:-1].copy()
    for k in reversed(range(len(ranks))):
        # equal ranks share 2**k codes, or all up to the end of both
        inside = np.flatnonzero((a < len(codes)) & (b < len(codes)))
        same = inside[ranks[k][a[inside]] == ranks[k][b[inside]]]
        a[same] += 1 << k
        b[same] += 1 << k
    shared[1:] = np.minimum(a - order[1:], np.minimum(left[order[1:]], left[order[:-1]]))
    return order, shared


class Minima:
    """Range minima of an array by a sparse table, and the nearest smaller places."""

    def __init__(self, values: np.ndarray) -> None:
        self.values, self.table = values, [values]
        while 2 << (len(self.table) - 1) <= len(values):
            below, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(below[:-half], below[half:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """min(values[first..last]) of ranges that aren't empty."""
        level = np.frexp(last - first + 1)[1] - 1
        out = np.empty(len(first), self.values.dtype)
        for k in range(len(self.table)):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][first[at]], self.table[k][last[at] - (1 << k) + 1])
        return out

    def smaller_before(self, at: np.ndarray, than: np.ndarray) -> np.ndarray:
        """The last place before each ``at`` with a value below ``than``; there must be one."""
        end = at.copy()
        for k in reversed(range(len(self.table))):
            can = np.flatnonzero(end >= 1 << k)
            go = can[self.table[k][end[can] - (1 << k)] >= than[can]]
            end[go] -= 1 << k
        return end - 1

    def smaller_after(self, at: np.ndarray, than: np.ndarray) -> np.ndarray:
        """The first place after each ``at`` with a value below ``than``, or the end."""
        begin = at + 1
        for k in reversed(range(len(self.table))):
            can = np.flatnonzero(begin + (1 << k) <= len(self.values))
            go = can[self.table[k][begin[can]] >= than[can]]
            begin[go] += 1 << k
        return begin


def intervals(codes: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All n-grams as intervals: a position, the least and the greatest n, occurrences and records."""
    order, shared = suffix_array(codes)
    n = len(order)
    if not n:
        return (np.zeros(0, np.int64),) * 5
    left = _left(codes)[order]
    # the place with the smallest shared prefix between each suffix and its record's previous one
    by_record = np.lexsort((np.arange(n), record[order]))
    again = np.flatnonzero(record[order][by_record][1:] == record[order][by_record][:-1])
    here, there = by_record[again + 1], by_record[again]
    lowest = Minima(shared << 32 | np.arange(n)).of(there + 1, here) & 0xFFFFFFFF
    pairs = np.concatenate([[0], np.cumsum(np.bincount(lowest, minlength=n))])
    # an interval of several suffixes is known by the first of its places with the least shared prefix
    minima = Minima(shared)
    at = np.flatnonzero(shared > 0)
    value = shared[at]
    before = minima.smaller_before(at, value)
    first = minima.smaller_before(at, value + 1) == before
    at, value, before = at[first], value[first], before[first]
    after = minima.smaller_after(at, value)
    around = np.maximum(shared[before], np.where(after < n, shared[np.minimum(after, n - 1)], 0))
    occurrences = after - before
    records = occurrences - (pairs[after] - pairs[before + 1])
    # a suffix alone has the n-grams that neither neighbour shares
    alone = np.maximum(shared, np.append(shared[1:], 0))
    some = np.flatnonzero(left > alone)
    one = np.ones(len(some), np.int64)
    parts = ((order[before], order[some]), (around + 1, alone[some] + 1), (value, left[some]), (occurrences, one), (records, one))
    return tuple(np.concatenate(p) for p in parts)


def _block(values: pa.ListArray, most_n: int | None) -> Iterator[pa.RecordBatch]:
    values = values.filter(pc.is_valid(values))
    coded = pc.dictionary_encode(values.flatten())
    if not len(coded):
        return
    lengths = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(lengths)), lengths)
    codes = np.zeros(len(of) + len(lengths), np.int64)
    record = np.repeat(np.arange(len(lengths)), lengths + 1)
    codes[np.arange(len(of)) + of] = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    place, least, greatest, occurrences, records = intervals(codes, record)
    for n in range(1, min(int(greatest.max(initial=0)), most_n or len(codes)) + 1):
        held = np.flatnonzero((least <= n) & (n <= greatest))
        step = max(1, BLOCK // n)
        for i in range(0, len(held), step):
            part = held[i : i + step]
            flat = coded.dictionary.take(pa.array((codes[(place[part, None] + np.arange(n)).ravel()] - 1)))
            grams = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n, dtype=np.int32)), flat)
            yield pa.record_batch([grams, pa.array(occurrences[part]), pa.array(records[part])], ["ngram", "n_occurrences", "n_records"])


def count_ngrams(records: DataFrame, values: str, most_n: int | None = 1) -> DataFrame:
    """``ngram`` (an array), ``n_occurrences``, ``n_records`` of all n-grams of 1 to ``most_n`` values.

    None: of all lengths that occur; a record of n distinct values has n (n + 1) / 2 of them.

    Each row of ``records`` is one record, ``values`` its array of strings.
    """
    if most_n is not None and most_n < 1:
        raise ValueError("n-grams have at least one value")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        size = 0
        for batch in batches:
            column, at = batch.column(0), 0
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            while at < len(column):
                to = max(at + 1, int(np.searchsorted(sizes, BLOCK - size + (sizes[at - 1] if at else 0), "right")))
                held.append(column.slice(at, to - at))
                size += int(sizes[to - 1] - (sizes[at - 1] if at else 0))
                at = to
                if size >= BLOCK or at < len(column):
                    yield from _block(pa.concat_arrays(held), most_n)
                    held, size = [], 0
        if held:
            yield from _block(pa.concat_arrays(held), most_n)

    parts = with_workers(records.select(F.col(values).alias("v"))).mapInArrow(count, "ngram array<string>, n_occurrences bigint, n_records bigint")
    return parts.groupBy("ngram").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))


def count_values(records: DataFrame, values: str) -> DataFrame:
    """``value, n_occurrences, n_records`` of all distinct values: the intervals that hold n = 1."""
    return count_ngrams(records, values, 1).select(F.col("ngram")[0].alias("value"), "n_occurrences", "n_records")


def banded(counts: DataFrame, n_records, rare_below: int, common_above: float) -> DataFrame:
    """Adds ``band``: rare, common or null. ``n_records``: a column, the number of all records."""
    band = F.when(F.col("n_records") < rare_below, F.lit("rare")).when(F.col("n_records") > F.lit(common_above) * n_records, F.lit("common"))
    return counts.withColumn("band", band)
