import random

import numpy as np
import pytest

from quiverlane.llm import mixing

SIZES = "doc_id long, source string, n_tokens long, budget string"
TARGETS = "source string, target_share double, max_repeats int"


@pytest.mark.parametrize("seed", range(30))
def test_budgets_are_met_exactly_where_that_is_possible(seed):
    rnd = random.Random(seed)
    lengths = np.array(sorted(rnd.sample(range(1, 400), rnd.randint(1, 60))))
    counts = np.array([rnd.randint(1, 6) for _ in lengths])
    total = int((lengths * counts).sum())
    budget = rnd.randint(0, total + 5)
    take = mixing.fit_budget(lengths, counts, budget, seed)
    assert ((0 <= take) & (take <= counts)).all()
    assert int((take * lengths).sum()) <= budget
    if len(lengths) > 25 and 400 < budget < total - 400:
        assert int((take * lengths).sum()) == budget
    if budget >= total:
        assert (take == counts).all()


def sums_of(lengths, counts):
    sums = {0}
    for n, c in zip(lengths, counts):
        sums = {s + int(n) * k for s in sums for k in range(c + 1)}
    return sums


@pytest.mark.parametrize("seed", range(6))
def test_few_lengths_by_brute_force(seed):
    rnd = random.Random(seed)
    for i in range(150):
        lengths = np.array(sorted(rnd.sample(range(1, rnd.choice([12, 30, 90])), rnd.randint(1, 5))))
        counts = np.array([rnd.choice([0, 1, 2, 3, rnd.randint(1, 40)]) for _ in lengths])
        sums = sums_of(lengths, counts)
        for budget in {0, 1, rnd.randint(0, max(sums) + 2), rnd.choice(sorted(sums))}:
            take = mixing.fit_budget(lengths, counts, budget, i)
            assert (take >= 0).all() and (take <= counts).all()
            assert int((take * lengths).sum()) == max(s for s in sums if s <= budget)


@pytest.mark.parametrize("lengths, counts, budget, met", [([1, 2], [1, 1000], 1000, 1000), ([10, 15], [2000, 1], 15000, 15000), ([7, 500], [1, 2000], 500000, 500000), ([6, 10, 15], [4000, 4000, 4000], 60001, 60001), ([1000, 1001], [9000, 2], 500500, 500002), ([3, 5], [10**9, 10**9], 4 * 10**9 + 1, 4 * 10**9 + 1)])
def test_budgets_that_few_choices_meet(lengths, counts, budget, met):
    for seed in range(40):
        take = mixing.fit_budget(np.array(lengths), np.array(counts), budget, seed)
        assert int((take * lengths).sum()) == met and (take >= 0).all() and (take <= counts).all()


def test_the_draw_is_spread_over_lengths():
    lengths, counts = np.arange(1, 201), np.full(200, 100)
    budget = int((lengths * counts).sum()) // 3
    take = mixing.fit_budget(lengths, counts, budget, 7)
    assert int((take * lengths).sum()) == budget and take.min() > 20 and take.max() < 50


def plan(spark, sizes, targets, seed=3):
    df = spark.createDataFrame([(*s, "clash") for s in sizes], SIZES)
    made = mixing.plan_mix(df, spark.createDataFrame(targets, TARGETS), seed).cache()
    shares = {r.source: r for r in mixing.mix_shares(made).collect()}
    picked = mixing.mix(df, made, "doc_id", seed).collect()
    for source, r in shares.items():
        assert r.mix_tokens == sum(p.n_tokens * p.repeats for p in picked if p.source == source)
    return shares, picked


def test_a_mix(spark):
    rnd = random.Random(5)
    sizes = [(i, rnd.choice(["Big", "big ", "BIG"]), rnd.randint(1, 300)) for i in range(3000)] + [(9000 + i, "small", 10) for i in range(50)] + [(9900, None, 1000), (9901, "other", 500), (9902, "big", 0), (9903, "big", None)]
    total = sum(s[2] or 0 for s in sizes)
    targets = [("big", 0.5, 1), (" Small", 0.002, 3), ("short", 0.1, 9), ("tiny", 0.0, 1)]
    shares, picked = plan(spark, sizes, targets)
    assert shares["big"].mix_tokens == round(0.5 * total) and not shares["big"].short
    assert shares["small"].short == (3 * 500 < 0.002 * total) and not shares["small"].short
    assert shares["small"].mix_tokens in range(round(0.002 * total) - 10, round(0.002 * total) + 1)
    assert shares["short"].short and shares["short"].mix_tokens == 0 and not shares["tiny"].short
    assert abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9
    assert len({p.doc_id for p in picked}) == len(picked) and all(p.repeats <= 3 and p.n_tokens > 0 for p in picked)
    again, same = plan(spark, sizes, targets)
    assert sorted(map(tuple, same)) == sorted(map(tuple, picked))


def test_repeats_reach_the_cap_and_no_further(spark):
    shares, picked = plan(spark, [(i, "a", 7) for i in range(10)] + [(99, "b", 930)], [("a", 0.5, 4), ("b", 0.5, 1)])
    assert shares["a"].short and {p.repeats for p in picked if p.source == "a"} == {4}
    assert shares["b"].mix_tokens == 0  # its one document is larger than its budget


def test_one_length_for_all(spark):
    shares, picked = plan(spark, [(i, "a", 10) for i in range(4000)], [("a", 0.3, 1)])
    assert shares["a"].mix_tokens == 12000 and len(picked) == 1200


def test_targets_that_are_equal(spark):
    shares, _ = plan(spark, [(i, "a", 1) for i in range(100)], [("a", 0.25, 1), ("A ", 0.25, 2), ("a", None, None), (None, 0.5, 1)])
    assert len(shares) == 1 and shares["a"].target_share == 0.5 and shares["a"].max_repeats == 2 and shares["a"].mix_tokens == 50


def test_empty_tables(spark):
    shares, picked = plan(spark, [], [("a", 0.5, 1)])
    assert not picked and not shares["a"].short and shares["a"].actual_share == 0.0
    shares, picked = plan(spark, [(1, "a", 5)], [])
    assert not shares and not picked
