import random
from datetime import datetime, timedelta

import pytest

from quiverlane.operators import references as R

T0 = datetime(2023, 1, 1)
RECORDS = "id long, left_id long, right_id long, loaded_at timestamp_ntz, node_id string, fate string"  # clashing extra columns
EVENTS = "node_id long, at timestamp_ntz"


def at(days):
    return None if days is None else T0 + timedelta(days=days)


def brute(records, loads, deaths):
    out = []
    known = {n for n, t in loads if t is not None}
    by_id = {}
    for i, left, right, t, *_ in records:
        old = by_id.get(i)
        times = [x for x in (t, old and old[2]) if x is not None]
        by_id[i] = (left if left is not None else old and old[0], right if right is not None else old and old[1], min(times) if times else None)
    for i, (left, right, t) in by_id.items():
        for field, node in (("left_id", left), ("right_id", right)):
            if node is None:
                continue
            born = [x for n, x in loads if n == node and x is not None]
            if node not in known:
                fate = "missing"
            elif t is None:
                continue
            elif not [x for x in born if x <= t]:
                fate = "late"
            else:
                died = [x for n, x in deaths if n == node and x is not None and x <= t]
                fate = "deleted" if died and max(died) >= max(x for x in born if x <= t) else None
            if fate:
                out.append(("edges", i, field, fate))
    return sorted(out)


def run(spark, records, loads, deaths):
    refs = R.earliest_references(spark.createDataFrame(records, RECORDS), "edges", "id", ["left_id", "right_id"], "loaded_at")
    args = refs, spark.createDataFrame(loads, EVENTS), spark.createDataFrame(deaths, EVENTS)
    found = R.orphan_references(*args)
    counted = {(r.ref_table, r.ref_field, r.period, r.fate): r.n_references for r in R.orphan_counts(*args).collect()}
    rows = found.collect()
    assert sum(counted.values()) == len(rows)
    return sorted((r.ref_table, r.ref_id, r.ref_field, r.fate) for r in rows)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    records = []
    for i in range(150):
        row = (i, rnd.choice([None, *range(12)]), rnd.randrange(12), at(rnd.choice([None, *range(0, 120, 5)])), "x", "y")
        records += [row] * rnd.choice([1, 1, 2])
        if rnd.random() < 0.2:
            records.append((*row[:3], at(rnd.randrange(0, 120, 5)), "x", "y"))
    loads = [(rnd.randrange(10), at(rnd.randrange(0, 120, 5))) for _ in range(25)] + [(None, at(1)), (3, None)]
    deaths = [(rnd.randrange(11), at(rnd.randrange(0, 120, 5))) for _ in range(25)] * 2 + [(None, at(1)), (3, None)]
    assert run(spark, records, loads, deaths) == brute(records, loads, deaths)


def test_ties(spark):
    records = [(1, 7, None, at(10), "", ""), (2, 7, None, at(20), "", ""), (3, 7, None, at(19), "", "")]
    # a deletion at the time of a load deletes it; a load at the time of the reference counts
    assert run(spark, records, [(7, at(10)), (7, at(20))], [(7, at(10))]) == [("edges", 1, "left_id", "deleted"), ("edges", 3, "left_id", "deleted")]


def test_a_hot_key(spark):
    records = [(i, 1, None, at(i % 100), "", "") for i in range(3000)]
    found = run(spark, records, [(1, at(50))], [(1, at(80))])
    assert (sum(f[3] == "late" for f in found), sum(f[3] == "deleted" for f in found)) == (1500, 600)


def test_records_without_an_id(spark):
    assert run(spark, [(None, 2, 3, at(1), "", ""), (4, 2, None, at(1), "", "")], [], []) == [("edges", 4, "left_id", "missing")]


def test_empty_tables(spark):
    assert run(spark, [], [], []) == []
    assert run(spark, [(1, 2, None, at(1), "", "")], [], []) == [("edges", 1, "left_id", "missing")]


def test_many_deletions_of_one_key_in_a_day(spark):
    hours = [at(i / 240) for i in range(480)]
    records = [(i, 1, None, t + timedelta(minutes=1), "", "") for i, t in enumerate(hours)]
    loads = [(1, t) for t in hours[::3]]
    deaths = [(1, t) for t in hours[1::3]]
    assert run(spark, records, loads, deaths) == brute(records, loads, deaths)
