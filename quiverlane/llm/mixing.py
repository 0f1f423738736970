"""A mix of sources that meets target shares of the total size.

1. Texts are counted by (source, exact number of tokens); nothing else of them is needed to plan.
2. ``fit_budget`` fits each source's budget, its share of all tokens: whole repetitions first, then
   a subset of the documents whose sizes add up to the rest. The subset is drawn at random by
   length with a seed; what the draw misses is a bounded knapsack over the documents left and those
   drawn, solved by dynamic programming over the sums around the budget.
3. ``mix`` picks as many documents of each length as the plan says, in the order of a seeded hash.
   A length that a third of all documents share is split into buckets of the hash; only the one
   bucket in which the number is reached is ranked.

Defined results: sources are compared without outer blanks and in lower case; documents of other
sources or of none count for the total only. Equal sources among the targets are one (shares add
up, the larger cap holds); a null share is 0, a null cap 1. A source is short if its cap times its
tokens is less than its share of all tokens; it is then repeated as often as the cap allows.
Documents without tokens are never picked. Where no subset meets the budget exactly, the largest
reachable sum below it counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quiverlane.runtime import cut, with_workers

#: Buckets of the seeded hash that the documents of one length are split into.
BUCKETS = 256


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many of the ``counts`` items of each length to take so that the sizes add up to
    ``budget``, or else to the largest sum below it that any choice gives. All lengths are positive.

    A choice drawn at random comes within one item of the budget; the knapsack then finds what to add
    to it and take back from it. Where some choice meets a sum, one does that is reached from the
    draw by fewer than 2 m single changes, m being the largest length: ordered so that the sum on
    the way stays within m of its goal, changes between two equal sums could be left out. So what is
    taken back is at most m * m, and sums further than that from the budget aren't looked at. Of
    texts of many lengths the first few thousand sums do; it is where no choice meets the budget
    that all m * m of them are needed to know it.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    if budget >= int((lengths * counts).sum()):
        return counts.copy()
    some = (counts > 0) & (lengths <= budget)
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not some.any():
        return take
    # sums are multiples of the lengths' common divisor
    by = int(np.gcd.reduce(lengths[some]))
    take[some] = _fitted(lengths[some] // by, counts[some], budget // by, np.random.default_rng(seed))
    return take


def _fitted(lengths: np.ndarray, counts: np.ndarray, budget: int, random: np.random.Generator) -> np.ndarray:
    total, most = int((lengths * counts).sum()), int(lengths.max())
    if budget >= total:
        return counts.copy()
    order = random.permutation(len(lengths))
    take = _drawn(lengths, counts, budget, random, order)
    start = int((take * lengths).sum()) - budget
    reach, furthest = 4 * most, most * (most + 1)
    while True:
        low, high = max(-budget, -min(reach, furthest)), min(total - budget, min(reach, furthest))
        change, at = _knapsack(lengths, take, counts, start, low, high, order)
        if at == 0 or reach >= furthest or (low == -budget and high == total - budget):
            return take + change
        reach *= 4


def _drawn(lengths: np.ndarray, counts: np.ndarray, budget: int, random: np.random.Generator, order: np.ndarray) -> np.ndarray:
    """Of each length the same part, rounded at random, then made to miss the budget by less than one item."""
    expected = counts * (budget / int((lengths * counts).sum()))
    take = np.minimum(np.floor(expected).astype(np.int64) + (random.random(len(counts)) < expected % 1), counts)
    while (over := int((take * lengths).sum()) - budget) > 0:
        # give back one of each length in random order, as few as needed
        have = order[take[order] > 0]
        take[have[: int(np.searchsorted(np.cumsum(lengths[have]), over)) + 1]] -= 1
    while True:
        left = order[take[order] < counts[order]]
        fits = int(np.searchsorted(np.cumsum(lengths[left]), budget - int((take * lengths).sum()), "right"))
        take[left[:fits]] += 1
        if fits < len(left):
            return take


def _knapsack(lengths: np.ndarray, take: np.ndarray, counts: np.ndarray, start: int, low: int, high: int, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Bounded knapsack: what to add to a choice (``take`` of ``counts``) and take back from it, so that
    its excess ``start`` becomes 0, or else the largest one below that is reached between ``low`` and
    ``high``; and that excess."""
    change = np.zeros(len(lengths), np.int64)
    reached = np.zeros(high - low + 1, bool)
    reached[start - low] = True
    by = np.full(len(reached), -1, np.int32)  # the bundle that first reached a sum
    bundles: list[tuple[int, int]] = []
    # bundles of 1, 2, 4, ... items give every number of them; small changes of many lengths come first
    most = (high - low) // lengths
    left = {1: np.minimum(counts - take, most), -1: np.minimum(take, most)}
    size = 1
    while not reached[-low] and any((x > 0).any() for x in left.values()):
        for k in order:
            for sign in (1, -1):
                n = min(size, int(left[sign][k]))
                if n == 0:
                    continue
                left[sign][k] -= n
                step = n * int(lengths[k])
                if sign > 0:
                    new = np.flatnonzero(reached[:-step] & ~reached[step:]) + step
                else:
                    new = np.flatnonzero(reached[step:] & ~reached[:-step])
                reached[new] = True
                by[new] = len(bundles)
                bundles.append((int(k), sign * n))
            if reached[-low]:
                break
        size *= 2
    end = at = int(np.flatnonzero(reached[: 1 - low])[-1])
    while at != start - low:
        k, n = bundles[by[at]]
        change[k] += n
        at -= n * int(lengths[k])
    return change, end + low


def _source(name: str) -> Column:
    return F.lower(F.trim(name))


PLAN = "source string, target_share double, max_repeats bigint, budget bigint, short boolean, n_tokens bigint, n_documents bigint, repeats bigint, extra bigint"


def plan_mix(sizes: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Per target source and length: every document ``repeats`` times, and ``extra`` of them once more.

    ``sizes`` is ``source, n_tokens`` of all documents, ``targets`` is ``source, target_share,
    max_repeats``. A source without documents has one row with a null length.
    """
    goals = targets.select(_source("source").alias("source"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"), F.coalesce(F.col("max_repeats").cast("bigint"), F.lit(1)).alias("max_repeats"))
    goals = goals.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    counted = sizes.groupBy(_source("source").alias("source"), "n_tokens").agg(F.count(F.lit(1)).alias("n_documents"))
    total = F.coalesce(sizes.agg(F.sum("n_tokens").alias("n")).scalar(), F.lit(0)).cast("bigint")
    joined = goals.join(counted, "source", "left").select("*", total.alias("total"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n_tokens")
        share, cap, whole = float(rows.target_share.iloc[0]), max(0, int(rows.max_repeats.iloc[0])), int(rows.total.iloc[0])
        n_tokens, n = rows.n_tokens.fillna(0).to_numpy(np.int64), rows.n_documents.fillna(0).to_numpy(np.int64)
        have, budget = int((n_tokens * n).sum()), int(round(share * whole))
        short = cap * have < share * whole
        full, extra = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        some = n_tokens > 0
        times = cap if cap * have <= budget else budget // have if have else 0
        full[some] = times
        if times < cap and have:
            extra[some] = fit_budget(n_tokens[some], n[some], budget - times * have, seed)
        return pd.DataFrame({"source": rows.source, "target_share": share, "max_repeats": cap, "budget": budget, "short": short, "n_tokens": rows.n_tokens.astype("Int64"), "n_documents": n, "repeats": full, "extra": extra})

    # a group holds the distinct lengths of one source, not its documents
    return with_workers(joined).groupBy("source").applyInPandas(fit, PLAN)


def mix_shares(plan: DataFrame) -> DataFrame:
    """Per target source: what it has, what the mix takes of it, and the share of the mix that this is."""
    size = F.coalesce(F.col("n_tokens"), F.lit(0))
    per = plan.groupBy("source", "target_share", "max_repeats", "budget", "short").agg(
        F.sum(size * F.col("n_documents")).alias("source_tokens"),
        F.sum(size * (F.col("n_documents") * F.col("repeats") + F.col("extra"))).alias("mix_tokens"),
    )
    # one row per target source
    whole = F.sum("mix_tokens").over(Window.partitionBy(F.lit(0)))
    return per.withColumn("actual_share", F.when(whole > 0, F.col("mix_tokens") / whole).otherwise(F.lit(0.0)))


def mix(sizes: DataFrame, plan: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """``<key>, source, n_tokens, repeats`` of the documents in the mix; ``sizes`` has ``<key>, source, n_tokens``."""
    plan = plan.where("repeats > 0 or extra > 0").select("source", "n_tokens", "repeats", "extra")
    drawn = sizes.select(F.col(key), _source("source").alias("source"), "n_tokens").withColumn("draw", F.xxhash64(F.lit(seed), F.col(key)))
    drawn = drawn.withColumn("bucket", F.pmod(F.shiftright("draw", 32), F.lit(BUCKETS)).cast("int"))
    before = Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = drawn.groupBy("source", "n_tokens", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    wanted = buckets.join(plan, ["source", "n_tokens"]).select("source", "n_tokens", "bucket", "repeats", F.least(F.greatest(F.col("extra") - F.col("before"), F.lit(0)), F.col("n")).alias("of_bucket"), "n")
    rows = drawn.join(wanted, ["source", "n_tokens", "bucket"])
    ranked = rows.where("of_bucket > 0 and of_bucket < n").withColumn("nth", F.row_number().over(Window.partitionBy("source", "n_tokens", "bucket").orderBy("draw", key)))
    whole = rows.where("of_bucket = 0 or of_bucket = n").withColumn("nth", F.lit(1))
    both = whole.unionByName(ranked).withColumn("repeats", F.col("repeats") + (F.col("nth") <= F.col("of_bucket")).cast("bigint"))
    return both.where("repeats > 0").select(key, "source", "n_tokens", "repeats")


def kept_sizes(sizes: DataFrame) -> DataFrame:
    """Sizes that are planned and drawn from again and again, so counted once."""
    return cut(sizes)


