import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quiverlane.operators.salted import Agg, heavy_keys, salted_aggregate

SCHEMA = "k long, g string, v double, n string"


def aggs():
    v = F.col("v")
    return [Agg("n", "rows"), Agg("some", "count", v), Agg("total", "sum", v), Agg("least", "min", v), Agg("most", "max", v), Agg("mean", "avg", v), Agg("kinds", "distinct", v)]


def brute(rows):
    groups = defaultdict(list)
    for k, g, v, _ in rows:
        groups[k, g].append(v)
    out = {}
    for key, vs in groups.items():
        known = [v for v in vs if v is not None]
        out[key] = (len(vs), len(known), sum(known) if known else None, min(known, default=None), max(known, default=None), sum(known) / len(known) if known else None, len(set(known)))
    return out


@pytest.mark.parametrize("share", [0.001, 0.2, 1.0])
def test_against_brute_force(spark, share):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 1, 1, None, *range(20)]), rnd.choice(["a", None]), rnd.choice([None, 1.0, 2.0, 3.5]), "clash") for _ in range(2000)]
    got = salted_aggregate(spark.createDataFrame(rows, SCHEMA).repartition(5), ["k", "g"], aggs(), salts=7, share=share).collect()
    assert {(r.k, r.g): tuple(r)[2:] for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_copies_of_one_row(spark):
    df = spark.createDataFrame([(1, "a", 1.0, "x")], SCHEMA).crossJoin(spark.range(5000)).select("k", "g", "v", "n")
    (row,) = salted_aggregate(df, ["k"], aggs()).collect()
    assert tuple(row) == (1, 5000, 5000, 5000.0, 1.0, 1.0, 1.0, 1)


def test_heavy_keys_are_found(spark):
    df = spark.range(10000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    assert heavy_keys(df, ["k"], 0.1).count() == 1


def test_empty_table(spark):
    assert salted_aggregate(spark.createDataFrame([], SCHEMA), ["k"], aggs()).collect() == []


def test_unknown_aggregate(spark):
    with pytest.raises(ValueError, match="median"):
        salted_aggregate(spark.createDataFrame([], SCHEMA), ["k"], [Agg("x", "median", F.col("v"))])
