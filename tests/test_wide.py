from datetime import datetime, timedelta

import pytest

from quiverlane.operators import wide
from quiverlane.operators.wide import Attribute

T0 = datetime(2023, 1, 1)
SCHEMA = "row_no long, node_id long, prop_name string, prop_text string, loaded_at timestamp_ntz, value string, faults string"
CATALOG = [Attribute("age", "Integer"), Attribute("Score", "Float"), Attribute("ok", "Boolean"), Attribute("name", "String"), Attribute("label", "String", True), Attribute("years", "Integer", True)]


def table(spark, cells):
    """Rows of (node, name, text), later ones loaded later."""
    rows = [(i, n, p, t, T0 + timedelta(hours=i), "clash", "clash") for i, (n, p, t) in enumerate(cells)]
    return spark.createDataFrame(rows, SCHEMA)


def row(spark, cells):
    (r,) = wide.wide_table(table(spark, cells), CATALOG).collect()
    return r


@pytest.mark.parametrize(
    "name, text, value",
    [
        ("age", "+22", 22), ("age", " -7 ", -7), ("age", "9223372036854775807", 2**63 - 1), ("age", "9223372036854775808", None), ("age", "1.0", None), ("age", "", None), ("age", "٣", None), ("age", "1\n", None), ("age", "0x1", None),
        ("score", "7.4e+00", 7.4), ("score", ".5", 0.5), ("score", "5.", 5.0), ("score", "-0", 0.0), ("score", "1e999", float("inf")), ("score", "1d", None), ("score", "NaN", None), ("score", ".", None), ("score", "1 2", None), ("score", "e5", None),
        ("OK ", "TRUE", True), ("ok", "false", False), ("ok", "yes", None), ("ok", "1", None), ("name", "  x y ", "x y"), ("name", "", ""), ("name", "null", "null"),
    ],
)
def test_readable_texts(spark, name, text, value):
    r = row(spark, [(1, name, text)])
    column = {"score": "Score", "OK ": "ok"}.get(name, name)
    assert r[column] == value
    assert r.faults == ({} if value is not None else {column: "unreadable"})
    assert r.unread == ({} if value is not None else {column: text.strip(" ")})


def test_the_latest_readable_value_counts(spark):
    r = row(spark, [(1, "age", "5"), (1, "Age", "+6"), (1, "age", "x"), (1, "age", None), (1, "score", "1.0"), (1, "score", "1"), (1, "other", "1"), (1, None, "1"), (None, "age", "7")])
    assert (r.age, r.Score, r.ok, r.label) == (6, 1.0, None, [])
    assert r.faults == {"age": "conflict"} and r.unread == {"age": "x"}


def test_ties_in_time(spark):
    same = [(2, 1, "age", "5", T0, "", ""), (9, 1, "age", "4", T0, "", ""), (1, 1, "age", "6", None, "", "")]
    (r,) = wide.wide_table(spark.createDataFrame(same, SCHEMA), CATALOG).collect()
    assert r.age == 4


def test_attributes_with_many_values(spark):
    r = row(spark, [(1, "label", "b"), (1, "label", " a"), (1, "label", "b"), (1, "label", None), (1, "years", "12"), (1, "years", "+12"), (1, "years", "x"), (1, "years", "3")])
    assert r.label == ["a", "b"] and r.years == [3, 12] and r.faults == {} and r.unread == {"years": "x"}


def test_entities_without_values_keep_a_row(spark):
    r = row(spark, [(5, "age", None)])
    assert (r.node_id, r.age, r.faults) == (5, None, {})


def test_copies_and_hot_entities(spark):
    cells = [(1, "age", str(i % 2)) for i in range(3000)] + [(i, "name", "x") for i in range(2, 50)]
    df = table(spark, cells)
    found = wide.unsettled_cells(df.unionByName(df), CATALOG).collect()
    assert [tuple(r) for r in found] == [(1, "age", "conflict")]
    assert wide.wide_table(df, CATALOG).count() == 49


def test_empty_tables(spark):
    assert wide.wide_table(table(spark, []), CATALOG).collect() == []
    assert wide.unsettled_cells(table(spark, []), CATALOG).collect() == []


def test_catalog(spark):
    df = spark.createDataFrame([("Age ", "Integer", False), ("age", "Float", False), (None, "Float", False)], "prop_name string, value_kind string, is_multi boolean")
    assert wide.catalog_of(df) == [Attribute("Age ", "Integer")]
    with pytest.raises(ValueError, match="kind"):
        wide.catalog_of(spark.createDataFrame([("a", "Date", False)], df.schema))
    with pytest.raises(ValueError, match="node_id"):
        wide.wide_table(table(spark, []), [Attribute("node_id", "Integer")])
