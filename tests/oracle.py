"""Compares a query's rows with those of its SQL twin, as multisets."""

import glob
import math
import os
from collections import Counter

import duckdb


def connection(directory):
    con = duckdb.connect()
    for f in glob.glob(f"{directory}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f if os.path.isfile(f) else f + '/*'}')")
    return con


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v if isinstance(v, (int, str, type(None))) else str(v)


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    mine = Counter(tuple(value(r[c]) for c in columns) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert mine == Counter(tuple(value(r[i]) for i in at) for r in result.fetchall())
