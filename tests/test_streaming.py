import pytest
from pyspark.sql import functions as F

from quiverlane.graph import PropertyGraph
from quiverlane.lang.errors import QueryError
from quiverlane.streaming.match import stream_query, with_streamed_edges

TEXT = "MATCH (u:User)-[e:SENT]->(v:User) WHERE u.age >= $least AND e.amount > 1 RETURN u.name AS sender, v.name AS receiver, e.amount AS amount, e.at AS at"


@pytest.fixture
def streamed(spark, tmp_path):
    users = spark.createDataFrame([(1, "ann", 30), (2, "bob", 10), (3, "cy", 50)], "id long, name string, age int")
    edges = spark.createDataFrame([(1, 1, 2, 5.0, "2024-01-01 00:01:00"), (2, 2, 1, 5.0, "2024-01-01 00:02:00"), (3, 3, 1, 7.0, "2024-01-01 00:03:00"), (4, 3, 9, 7.0, "2024-01-01 00:04:00"), (5, 1, None, 7.0, "2024-01-01 00:04:00"), (6, 1, 3, 1.0, "2024-01-01 00:04:00")], "id long, a long, b long, amount double, at string")
    edges.withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "edges"))
    stream = spark.readStream.schema("id long, a long, b long, amount double, at timestamp").parquet(str(tmp_path / "edges"))
    return with_streamed_edges(PropertyGraph().with_nodes("User", users, "id"), "SENT", stream, ("User", "a"), ("User", "b"), "id")


def finished(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted(map(tuple, spark.table(name).collect()))


def test_matches_of_a_stream(spark, streamed):
    df = stream_query(streamed, TEXT, {"$least": 18})
    assert df.isStreaming
    assert finished(spark, df.drop("at"), "matches", "append") == [("ann", "bob", 5.0), ("cy", "ann", 7.0)]


def test_windows_over_matches(spark, streamed):
    df = stream_query(streamed, TEXT, {"least": 18}).withWatermark("at", "1 minute").groupBy(F.window("at", "1 hour"), "receiver").agg(F.sum("amount").alias("total"))
    assert finished(spark, df.select("receiver", "total"), "totals", "complete") == [("ann", 7.0), ("bob", 5.0)]


@pytest.mark.parametrize("text", ["MATCH (u)-[e:SENT]->(v) RETURN count(*)", "MATCH (u)-[e:SENT]->(v) RETURN u.name AS n ORDER BY n", "OPTIONAL MATCH (u)-->(v) RETURN u", "CREATE (n)"])
def test_what_needs_all_edges_is_refused(streamed, text):
    with pytest.raises(QueryError, match="Unimplemented"):
        stream_query(streamed, text)
