"""Per-key results without the imbalance that a few heavy keys cause.

``salted_aggregate`` finds the heavy keys with a mergeable sketch of fixed size, gives each row of
a heavy key one of ``salts`` salts, aggregates per (key, salt) and merges the partial results per
key. A key with a third of all rows thus becomes ``salts`` groups of a ninety-sixth each; other
keys keep one group, so the shuffle doesn't grow by the number of salts.

Salts are drawn from the row's place in its input partition (or, for distinct counts, from the
value), so a task that is run again draws the same ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Salts that a heavy key is spread over.
SALTS = 32
#: Items that the sketch returns, and counters that it holds: no more heavy keys than HEAVY_KEYS are broadcast.
HEAVY_KEYS, COUNTERS = 1000, 16384
#: Part of all rows from which a key is heavy.
HEAVY_SHARE = 0.001


@dataclass(frozen=True)
class Agg:
    """A result column: ``kind`` is count (non-null values), rows, sum, min, max, avg or distinct."""

    name: str
    kind: str
    value: Column | None = None


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = HEAVY_SHARE) -> DataFrame:
    """Heavy keys, at most HEAVY_KEYS of them: ``__key`` (a hash of the key).

    The sketch overestimates a count by at most (rows / COUNTERS), and two keys may share a hash;
    either only means that a key is salted needlessly, results don't depend on it.
    """
    sketch = df.select(F.xxhash64(*keys).alias("__key")).agg(F.expr(f"approx_top_k(__key, {HEAVY_KEYS}, {COUNTERS})").alias("top"), F.count(F.lit(1)).alias("n"))
    return sketch.select("n", F.explode("top").alias("t")).where(F.col("t.count") > F.col("n") * share).select(F.col("t.item").alias("__key"))


def salted_aggregate(df: DataFrame, keys: Sequence[str], aggs: Sequence[Agg], *, salts: int = SALTS, share: float = HEAVY_SHARE) -> DataFrame:
    """``keys`` and one column per aggregate, one row per distinct key (nulls are a key of their own).

    An empty table gives no rows. Sums, minima, maxima and averages skip nulls and are null if
    there is nothing else; counts are then 0. NaN and ties follow Spark's own aggregates. Columns
    of ``df`` that aren't named are not read; result names may equal theirs.
    """
    keys = list(keys)
    values = [a.value if a.value is not None else F.lit(1) for a in aggs]
    rows = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[v.alias(f"__v{i}") for i, v in enumerate(values)])
    ks = [f"__k{i}" for i in range(len(keys))]
    heavy = F.broadcast(heavy_keys(df, keys, share).select(F.col("__key"), F.lit(True).alias("__heavy")))
    marked = rows.withColumn("__place", F.monotonically_increasing_id()).withColumn("__key", F.xxhash64(*ks)).join(heavy, "__key", "left")
    plain = [i for i, a in enumerate(aggs) if a.kind != "distinct"]

    def salted(by: Column) -> DataFrame:
        return marked.withColumn("__salt", F.when(F.col("__heavy"), F.pmod(by, F.lit(salts))).otherwise(F.lit(0)).cast("int"))

    merged: DataFrame | None = None
    if plain or not aggs:
        first, second = [], []
        for i in plain:
            a, v = aggs[i], F.col(f"__v{i}")
            if a.kind in ("count", "rows"):
                first.append(F.count(v if a.kind == "count" else F.lit(1)).alias(f"__a{i}"))
                second.append(F.sum(f"__a{i}").alias(a.name))
            elif a.kind == "avg":
                first += [F.sum(v.cast("double")).alias(f"__a{i}"), F.count(v).alias(f"__n{i}")]
                second.append((F.sum(f"__a{i}") / F.nullif(F.sum(f"__n{i}"), F.lit(0))).alias(a.name))
            elif a.kind in ("sum", "min", "max"):
                f = {"sum": F.sum, "min": F.min, "max": F.max}[a.kind]
                first.append(f(v).alias(f"__a{i}"))
                second.append(f(f"__a{i}").alias(a.name))
            else:
                raise ValueError(f"no aggregate is called {a.kind}")
        merged = salted(F.col("__place")).groupBy(*ks, "__salt").agg(*(first or [F.count(F.lit(1)).alias("__a")])).groupBy(*ks).agg(*(second or [F.lit(0).alias("__none")]))
        if not aggs:
            merged = merged.drop("__none")
    for i, a in enumerate(aggs):
        if a.kind != "distinct":
            continue
        # the salt follows from the value, so the values of different salts differ and their counts add up
        part = salted(F.xxhash64(f"__v{i}")).groupBy(*ks, "__salt").agg(F.count_distinct(f"__v{i}").alias("__d")).groupBy(*ks).agg(F.sum("__d").alias(a.name))
        if merged is None:
            merged = part
        else:
            same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in ks]
            merged = merged.alias("l").join(part.alias("r"), same).select("l.*", f"r.{a.name}")
    return merged.select(*[F.col(k).alias(name) for k, name in zip(ks, keys)], *[a.name for a in aggs])
