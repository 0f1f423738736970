import json
from datetime import datetime

import pytest

from quiverlane.session import connect
from quiverlane.sources.store import store_graph, store_graphs

DAY = [datetime(2024, 1, d) for d in range(1, 10)]
NODES = [
    (1, "g", '["A"]', '{"age": 3, "profile": {"langs": ["de"], "none": []}, "größe": 1, "it\'s": "x"}', DAY[0]),
    (2, "g", ":A", json.dumps(json.dumps({"age": 4, "more info": [1, 2], "gone": None, "thread": [1]})), DAY[0]),
    (3, "h", None, '{"age": 5, "thread": {"by": "me", "list": [7, null, "x"]}}', DAY[0]),
    (4, None, None, "[1]", DAY[0]),
    (5, "h", None, '{"age"', DAY[0]),
    (6, "h", None, None, DAY[0]),
    # deleted; deleted and loaded again; deleted at the time of its load; loaded twice before
    (21, "g", ":Gone", '{"age": 90}', DAY[0]),
    (22, "g", ":Back", '{"index": 1}', DAY[0]),
    (22, "g", ":Back", '{"index": 1}', DAY[4]),
    (23, "g", ":Gone", '{"age": 91}', DAY[1]),
    (24, "h", ":Gone", '{"age": 92}', DAY[0]),
    (24, "h", ":Gone", '{"age": 92}', DAY[1]),
]
SHARED = [(11, ":Unit", '{"index": 9}', DAY[0])]
TOMBSTONES = [(1, 21, DAY[1], True), (1, 21, DAY[1], True), (2, 22, DAY[1], None), (3, 23, DAY[1], False), (4, 24, DAY[2], True), (5, 999, DAY[2], True), (6, None, DAY[2], True), (7, 1, None, True)]
EDGES = [
    (1, "g", 1, 2, '{"weight": 1.5, "sum": 7}'),
    (2, "g", 2, 3, '{"weight": "heavy"}'),
    (3, "h", 3, 1, '{"weight": 2}'),
    (4, "g", 1, 9, '{"sum": 8}'),
    (5, "g", 21, 1, '{"sum": 9}'),
    (6, "g", 1, 23, '{"sum": 9}'),
    (7, "g", 22, 11, json.dumps('{"sum": 4}')),
    (8, "g", None, 1, '{"sum": 9}'),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("store"))

    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")

    table("nodes", NODES, "id long, graph_name string, labels string, properties string, loaded_at timestamp_ntz")
    table("shared_nodes", SHARED, "id long, labels string, properties string, loaded_at timestamp_ntz")
    table("node_tombstones", TOMBSTONES, "tombstone_id long, node_id long, deleted_at timestamp_ntz, detach boolean")
    table("edges", [(i, g, None, p, a, b) for i, g, a, b, p in EDGES], "id long, graph_name string, labels string, properties string, left_id long, right_id long")
    table("graph_catalog", [(n,) for n in ("default", "g", "h", "empty", None)], "graph_name string")
    return d


@pytest.fixture(scope="module")
def graph(spark, folder):
    return connect(spark, graphs={"default": store_graph(spark, folder)})


@pytest.fixture(scope="module")
def graphs(spark, folder):
    return connect(spark, graphs=store_graphs(spark, folder))


def rows(graph, text):
    return sorted(map(tuple, graph.execute(text).collect()))


def plain(graph, text):
    return graph.execute_oc_query(text)[1:]


def test_all_names_are_read(graph):
    assert rows(graph, "MATCH (n) UNWIND keys(n) AS k RETURN k, count(*) AS n") == sorted([("age", 3), ("profile", 1), ("größe", 1), ("it's", 1), ("more info", 1), ("thread", 2), ("index", 2)])
    assert rows(graph, "MATCH (n) WHERE n.age > 3 RETURN n.age AS age") == [(4,), (5,)]
    assert rows(graph, "MATCH (n) WHERE n.profile IS NOT NULL RETURN n.profile.langs AS langs") == [(["de"],)]


def test_values_of_several_types(graph):
    assert rows(graph, "MATCH ()-[e]->() UNWIND keys(e) AS k RETURN k, count(*) AS n") == [("sum", 2), ("weight", 3)]
    assert rows(graph, "MATCH ()-[e]->() WHERE e.weight > 1.6 RETURN count(e) AS n") == [(1,)]
    assert rows(graph, "MATCH ()-[e]->() WHERE e.weight = 'heavy' RETURN count(e) AS n") == [(1,)]


def test_lists_and_maps_of_several_types(graph):
    assert rows(graph, "MATCH (n) WHERE n.thread.by = 'me' RETURN n.age AS age, n.thread['list'][0] = 7 AS seven, size(n.thread) AS n, size(n.thread.list) AS l") == [(5, True, 2, 3)]
    assert plain(graph, "MATCH (n) WHERE n.thread IS NOT NULL AND n.age = 4 RETURN n.thread") == [[[1]]]
    assert plain(graph, "MATCH (n) WHERE n.age = 5 RETURN n.thread, keys(n.thread)") == [[{"by": "me", "list": [7, None, "x"]}, ["by", "list"]]]
    assert plain(graph, "MATCH (n) WHERE n.age = 5 UNWIND n.thread.list AS x RETURN x") == [[7], [None], ["x"]]
    assert plain(graph, "MATCH (n) WHERE n.age = 5 RETURN n.thread.list[1] IS NULL, n.thread.list[0] + 1, toString(n.thread.by), n.thread.none IS NULL, 'x' IN n.thread.list, n.thread.list[1..][1]") == [[True, 8, "me", True, True, "x"]]
    assert sorted(plain(graph, "MATCH (n) WHERE n.thread IS NOT NULL RETURN n.thread.by AS by, count(*) AS n"), key=str) == [["me", 1], [None, 1]]
    assert plain(graph, "MATCH (n) WHERE n.thread IS NOT NULL RETURN n.age AS age ORDER BY n.thread.by DESC") == [[4], [5]]
    assert plain(graph, "MATCH (n) WHERE n.age = 4 RETURN n")[0][0]["properties"] == {"age": 4, "more info": [1, 2], "thread": [1]}


def test_deleted_nodes_match_nothing(graph):
    assert plain(graph, "MATCH (n:Gone) RETURN count(*)") == [[0]]
    assert plain(graph, "MATCH (n:Back) RETURN n.index") == [[1]]
    assert plain(graph, "MATCH (n) RETURN count(*)") == [[8]]
    assert sorted(plain(graph, "MATCH ()-[e]->() WHERE e.sum > 0 RETURN e.sum")) == [[4], [7]]


def test_named_graphs(graphs):
    assert graphs.graphs_list() == ["default", "empty", "g", "h"]
    assert sorted(plain(graphs, "USE g MATCH (n) RETURN coalesce(n.age, n.index)")) == [[1], [3], [4], [9]]
    assert sorted(plain(graphs, "USE g MATCH (a)-[e]->(b) RETURN e.sum")) == [[4], [7]]
    assert plain(graphs, "USE h MATCH (a)-[e]->(b) RETURN e.weight") == []
    assert plain(graphs, "MATCH (n) RETURN count(*)") == [[2]]
    assert plain(graphs, "USE empty MATCH (n) RETURN labels(n)") == [[["Unit"]]]
    graphs.execute_oc_query("USE g MATCH (n {age: 3}) SET n.age = 30 CREATE (:New {x: 1})-[:TO]->(n)")
    assert plain(graphs, "USE g MATCH (a:New)-[:TO]->(b) RETURN a.x, b.age") == [[1, 30]]
    assert plain(graphs, "USE h MATCH (n) WHERE n.age > 4 RETURN n.age") == [[5]]


def test_empty_store(spark, tmp_path):
    node = "id long, graph_name string, labels string, properties string, loaded_at timestamp_ntz"
    for name, schema in (("nodes", node), ("shared_nodes", node.replace("graph_name string, ", "")), ("node_tombstones", "node_id long, deleted_at timestamp_ntz"), ("edges", node.replace("loaded_at timestamp_ntz", "left_id long, right_id long")), ("graph_catalog", "graph_name string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    c = connect(spark, graphs=store_graphs(spark, str(tmp_path)))
    assert plain(c, "MATCH (n) OPTIONAL MATCH (n)-[e]->(m) RETURN n, keys(e), m.x") == []
    assert c.graphs_list() == ["default"]
