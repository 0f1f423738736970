import json
import random
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quiverlane.operators import nested


def strict(text):
    def refuse(name):
        raise ValueError(name)

    return json.loads(text, parse_constant=refuse)


def brute(text):
    """Row by row, the paths of all objects in arrays with their index and scalar members."""
    try:
        value = strict(text)
        if isinstance(value, str):
            value = strict(value)
    except (ValueError, TypeError):
        return []
    if not isinstance(value, dict):
        return []
    out = []

    def walk(x, path, owner, index):
        if isinstance(x, dict):
            if index is not None:
                out.append((owner, path, index, {k: v for k, v in x.items() if not isinstance(v, (dict, list))}))
                owner = path
            for k, y in x.items():
                walk(y, f"{path}.{k}", owner, None)
        elif isinstance(x, list):
            for i, y in enumerate(x):
                walk(y, f"{path}[{i}]", owner, i)

    walk(value, "$", "$", None)
    return out


def flattened(texts):
    got = {}
    for batch in nested.object_rows(pa.array(range(len(texts))), pa.array(texts, pa.string()), True):
        for r in batch.to_pylist():
            members = {k: strict(v) for k, v in r["members"]}
            got.setdefault(r["key"], []).append((r["parent_path"], r["child_path"], r["ordinal"], members))
    return got


def key(x):
    return x[1], x[2], repr(sorted(x[3].items(), key=repr))


CASES = [
    None, "", " ", "{}", "[]", "null", "1", "[{}]", '{"a":[{}]}', ' {"a" :\t[ {"b":"x\\"{[y"} ] } \n', '{"a":[[{"b":[{}]}]]}', '{"a":[1,{},null,{}]}', '"{\\"a\\":[{}]}"', '"[{}]"', '"\\"{}\\""',
    '{"a\\u00e9\\n":[{}]}', '{"größe":[{"x":1.5e3}]}', '{"":[{}]}', '{"a.b":[{"c":{"d":[{}]}}]}', '{"a":[{"b":true,"c":null,"d":"x\\u0041","e":-0.5}]}', '{"x":"\\\\","y":[{}]}', '{"x":"\\\\\\"","y":[{}]}', '{"a":[{}],"b":"\\ud83d\\ude00"}',
    # not JSON
    '{"a":[{}]', '{"a":[{},]}', "{'a':[{}]}", '{"a":NaN}', '{"a":01}', '{"a":"\\x"}', '{"a":"\\u12G4"}', '{"a":[{}]}}', '{{"a":1}}', '{"a":[}]', '{"a"}', '{"a":}', "{,}", '"', '"abc', '{"a":"b\nc"}', '{"a":1 2}', '{"a":[{}] "b":1}', '{"a":-}', '{"a":tru}', '{"a":[{}]} {"a":[{}]}', '﻿{"a":[{}]}', '{"a":[{}]} ', "nullnull", '{"a":\\"b"}', "\0", '{"a":[{}]}\0',
]


def check(texts):
    got = flattened(texts)
    for i, text in enumerate(texts):
        assert sorted(got.get(i, []), key=key) == sorted(brute(text) if text is not None else [], key=key), text


def test_cases():
    check(CASES)


@pytest.mark.parametrize("seed", range(3))
def test_broken_texts(data, seed):
    rnd = random.Random(seed)
    good = [t for t in pq.read_table(f"{data}/nodes.parquet", columns=["properties"])["properties"].to_pylist() if t]
    texts = list(good)
    for text in good:
        chars = list(text)
        for _ in range(rnd.randint(1, 3)):
            i = rnd.randrange(len(chars) + 1)
            chars[i : i + rnd.randint(0, 2)] = rnd.choice(["", *'{}[],:"\\1a e\n'])
        texts.append("".join(chars))
    check(texts)


def test_deep_and_long_texts():
    check(['{"a":' * 60 + "[{}]" + "}" * 60, '{"a":' + "[" * 80 + "{}" + "]" * 80 + "}", '{"a":[' + ",".join(['{"b":"' + "x" * 50 + '"}'] * 20000) + "]}"])


def test_repeated_names():
    got = flattened(['{"a":[{"k":1,"k":2}],"a":[{}]}'])
    assert sorted(x[:3] for x in got[0]) == [("$", "$.a[0]", 0), ("$", "$.a[0]", 0)]
    assert {"k": 2} in [x[3] for x in got[0]]


def test_over_a_table(spark):
    rows = [(1, '{"a":[{}]}', "clash"), (1, '{"a":[{}]}', "clash"), (2, None, "x"), (None, '{"b":[{"c":[{}]}]}', "x")]
    df = spark.createDataFrame(rows, "id long, properties string, parent_path string")
    found = sorted(tuple(r) for r in nested.flatten_objects(df, "id", "properties").where("id is not null").collect())
    assert found == [(1, "$", "$.a[0]"), (1, "$", "$.a[0]")]
    assert nested.flatten_objects(df, "id", "properties", members=True).where("id is null").count() == 2
    assert nested.flatten_objects(df.limit(0), "id", "properties").collect() == []


def test_latest_rows(spark):
    day = [datetime(2023, 1, d) for d in (1, 2, 3)]
    rows = [(1, "old", day[0], "x"), (1, "new", day[2], "x"), (2, "b", day[1], "x"), (2, "c", day[1], "x"), (None, "n", day[0], "x"), (3, None, day[0], "x")]
    df = spark.createDataFrame(rows, "id long, properties string, loaded_at timestamp_ntz, __at string")
    assert sorted(tuple(r) for r in nested.latest_rows(df, "id", ["properties"], "loaded_at").collect()) == [(1, "new"), (2, "c"), (3, None)]
