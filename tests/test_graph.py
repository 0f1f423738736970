import pytest
from pyspark.sql import functions as F

from quiverlane.graph import PropertyGraph
from quiverlane.session import connect
from quiverlane.sources.store import label_array


def test_edges_without_a_key_need_files(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    graph = PropertyGraph().with_nodes("N", nodes, "id")
    with pytest.raises(ValueError, match="files"):
        graph.with_edges("E", nodes.groupBy("id").count(), ("N", "id"), ("N", "count"))


def test_references_that_lead_nowhere(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    edges = spark.createDataFrame([(1, 1, 2), (2, 1, 9), (3, None, 2)], "k long, s long, t long")
    graph = PropertyGraph().with_nodes("N", nodes, "id").with_edges("E", edges, ("N", "s"), ("N", "t"), "k", complete=False)
    connection = connect(spark, graphs={"default": graph})
    assert connection.execute_oc_query("MATCH (a)-[e:E]->(b) RETURN count(*)") == [["count(*)"], [1]]


def test_a_table_with_several_labels_and_types(spark):
    nodes = spark.createDataFrame([(1, 2.5, True, ["x"], "2024-01-01")], "id int, d float, b boolean, l array<string>, t string").withColumn("t", F.to_date("t"))
    connection = connect(spark, graphs={"default": PropertyGraph().with_nodes(("A", "B"), nodes, "id")})
    assert connection.execute_oc_query("MATCH (n:A:B) RETURN n.d + 1 AS d, n.b AS b, n.l[0] AS l, n.t = n.t AS t")[1] == [3.5, True, "x", True]


def test_foreign_keys_are_not_joined_to_their_own_table(spark, tmp_path):
    spark.createDataFrame([(i, i % 3, str(i)) for i in range(9)], "id long, up long, name string").write.parquet(str(tmp_path / "c"))
    spark.createDataFrame([(i,) for i in range(3)], "id long").write.parquet(str(tmp_path / "p"))
    child, parent = spark.read.parquet(str(tmp_path / "c")), spark.read.parquet(str(tmp_path / "p"))
    graph = PropertyGraph().with_nodes("P", parent, "id").with_nodes("C", child, "id").with_edges("UP", child, ("C", "id"), ("P", "up"), "id")
    df = connect(spark, graphs={"default": graph}).execute("MATCH (c:C)-[:UP]->(p:P {id: 1}) RETURN c.name AS name")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "EqualTo(up,1)" in plan
    assert sorted(r.name for r in df.collect()) == ["1", "4", "7"]
    alone = connect(spark, graphs={"default": graph}).execute("MATCH (c:C)-[:UP]->() RETURN c.name AS name")
    assert alone._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1 and alone.count() == 9


def test_label_texts(spark):
    texts = [None, "", ":", ":a::b:", "a:b", '["x", 1, null, ["n"]]', "[]", '{"a":"b"}', '["A"', '["\\u0041","A"]']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.l for r in df.select("i", label_array(F.col("t")).alias("l")).orderBy("i").collect()]
    assert got == [[], [], [], ["a", "b"], [], ["x"], [], [], [], ["A", "A"]]
