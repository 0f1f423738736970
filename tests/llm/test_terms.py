import json
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quiverlane.llm import labels, terms


def brute(records, most):
    found, held = Counter(), defaultdict(set)
    for i, r in enumerate(records):
        for a in range(len(r or ())):
            for n in range(1, most + 1):
                g = tuple(r[a : a + n])
                if len(g) == n and None not in g:
                    found[g] += 1
                    held[g].add(i)
    return {g: (c, len(held[g])) for g, c in found.items()}


@pytest.mark.parametrize("most", [1, 2, 3, 7])
def test_blocks_against_brute_force(most):
    rnd = random.Random(most)
    for _ in range(60):
        alphabet = rnd.choice([["a"], ["a", "b"], ["a", "b", "c", None]])
        records = [rnd.choice([None, [rnd.choice(alphabet) for _ in range(rnd.randint(0, 9))]]) for _ in range(rnd.randint(0, 12))]
        got = {}
        for batch in terms._block(pa.array(records, pa.list_(pa.string())), most):
            for r in batch.to_pylist():
                assert tuple(r["ngram"]) not in got
                got[tuple(r["ngram"])] = (r["n_occurrences"], r["n_records"])
        assert got == brute(records, most)


def test_blocks_add_up(spark, monkeypatch):
    rnd = random.Random(0)
    records = [[rnd.choice("aaabcd") for _ in range(rnd.randint(0, 8))] for _ in range(500)] + [["a"] * 400, None]
    df = spark.createDataFrame([(r,) for r in records], "labels array<string>").repartition(5)
    monkeypatch.setattr(terms, "BLOCK", 50)
    got = {tuple(r.ngram): (r.n_occurrences, r.n_records) for r in terms.count_ngrams(df, "labels", 2).collect()}
    assert got == brute(records, 2)


def test_all_lengths(spark, monkeypatch):
    rnd = random.Random(1)
    records = [[rnd.choice(["a", "b", None]) for _ in range(rnd.randint(0, 12))] for _ in range(40)] + [[rnd.choice("ab") for _ in range(300)], None]
    df = spark.createDataFrame([(r,) for r in records], "labels array<string>").repartition(3)
    monkeypatch.setattr(terms, "BLOCK", 500)
    got = {tuple(r.ngram): (r.n_occurrences, r.n_records) for r in terms.count_ngrams(df, "labels", None).collect()}
    assert got == brute(records, 300)


def test_intervals_hold_every_ngram_once():
    rnd = random.Random(4)
    for _ in range(40):
        records = [[rnd.choice([0, 1, 1, 2]) for _ in range(rnd.randint(0, 15))] for _ in range(rnd.randint(1, 9))]
        codes = np.array([c for r in records for c in [*(x + 1 for x in r), 0]])
        record = np.repeat(np.arange(len(records)), [len(r) + 1 for r in records])
        got = {}
        for at, least, greatest, occurrences, held in zip(*terms.intervals(codes, record)):
            for n in range(least, greatest + 1):
                gram = tuple(codes[at : at + n] - 1)
                assert gram not in got
                got[gram] = (occurrences, held)
        assert got == brute(records, 20)


def test_lengths_have_no_bound(spark):
    df = spark.createDataFrame([(["a"] * 700,), (["a"] * 650,)], "labels array<string>")
    counts = {len(r.ngram): (r.n_occurrences, r.n_records) for r in terms.count_ngrams(df, "labels", 660).collect()}
    assert counts == {n: (701 - n + max(0, 651 - n), 2 if n <= 650 else 1) for n in range(1, 661)}


def test_bands(spark):
    df = spark.createDataFrame([(["hot", f"x{i % 30}"],) for i in range(100)], "labels array<string>")
    counts = terms.banded(terms.count_values(df, "labels"), F.lit(100), 4, 0.4).collect()
    assert {r.value: r.band for r in counts if r.band} == {"hot": "common", **{f"x{i}": "rare" for i in range(10, 30)}}


def test_empty_table(spark):
    df = spark.createDataFrame([], "labels array<string>")
    assert terms.count_ngrams(df, "labels", 3).collect() == []
    with pytest.raises(ValueError):
        terms.count_ngrams(df, "labels", 0)


def parsed(text):
    if text is None:
        return []
    if text.startswith(":"):
        return [x for x in text.split(":") if x]
    try:
        value = json.loads(text)
    except ValueError:
        return []
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


def test_labels(data):
    texts = [None, "", ":", ":a::b:", "a:b", " :a", ' ["x"]', '["\\u0041",1,["n"],{"k":"v"},null]', "[]", '{"a":"b"}', '"a"', '["A"', ":a b:ü", '["a","a"]'] + pq.read_table(f"{data}/nodes.parquet", columns=["labels"])["labels"].to_pylist()
    assert labels.label_lists(pa.array(texts, pa.string())).to_pylist() == [parsed(t) for t in texts]


def test_labels_over_a_table(spark):
    df = spark.createDataFrame([(1, ":a:b", 0), (None, '["c"]', 0), (2, None, 0)], "id long, labels string, key int")
    assert sorted((r.id or 0, r.labels) for r in labels.parse_labels(df, "id", "labels").collect()) == [(0, ["c"]), (1, ["a", "b"]), (2, [])]
