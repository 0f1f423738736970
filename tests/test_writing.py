import pytest

from quiverlane.lang.errors import QueryError
from quiverlane.session import connect
from tests.test_clauses import bag, graph, rows


def counts(connection):
    return connection.execute_oc_query("CALL internal.stats()")[1]


def test_create(spark):
    c = graph(spark)
    assert counts(c) == [0, 0, 0, 0]
    c.execute_oc_query("CREATE ()")
    assert counts(c) == [1, 0, 0, 0]
    assert c.execute_oc_query("CREATE (n {id: 12, name: 'foo'}) RETURN n.id AS id, n.name AS p") == [["id", "p"], [12, "foo"]]
    c.execute_oc_query("UNWIND [1, 2, 3] AS i CREATE (:A {i: i})-[:R {w: i * 2}]->(:B {i: i, gone: null})")
    assert counts(c) == [8, 3, 2, 11]
    assert bag(c, "MATCH (a:A)-[r:R]->(b:B) RETURN a.i, r.w, b.i") == rows([1, 2, 1], [2, 4, 2], [3, 6, 3])
    c.execute_oc_query("MATCH (a:A {i: 1}), (b:B {i: 3}) CREATE (a)<-[:BACK]-(b)")
    assert bag(c, "MATCH (b)-[:BACK]->(a) RETURN a.i, b.i") == rows([1, 3])
    assert bag(c, "CREATE (x:X {n: 1}), (y:Y {n: x.n + 1}) RETURN x.n, y.n") == rows([1, 2])


def test_ids_stay_apart(spark):
    c = graph(spark, "CREATE (:A)", "CREATE (:A)", "MATCH (a:A) CREATE (:B)")
    _, *ids = c.execute_oc_query("MATCH (n) RETURN n")
    assert len({n["key"] for (n,) in ids}) == 4


def test_set_and_remove(spark):
    c = graph(spark, "CREATE (:A {x: 1, y: 'old'}), (:A {x: 2})")
    assert bag(c, "MATCH (n:A) SET n.y = n.x * 10, n.z = 'new' RETURN n.x, n.y, n.z") == rows([1, 10, "new"], [2, 20, "new"])
    assert bag(c, "MATCH (n:A) RETURN n.x, n.y, n.z") == rows([1, 10, "new"], [2, 20, "new"])
    c.execute_oc_query("MATCH (n:A {x: 1}) SET n = {only: true}")
    assert bag(c, "MATCH (n:A) RETURN properties(n).only, n.x, keys(n)") == rows([True, None, ["only"]], [None, 2, ["x", "y", "z"]])
    c.execute_oc_query("MATCH (n:A {x: 2}) SET n += {y: null, k: {a: 1}} SET n.k.b = 2, n.k += {c: 3} REMOVE n.k.a, n.nothing.at.all")
    assert bag(c, "MATCH (n {x: 2}) RETURN n.k, n.y") == rows([{"b": 2, "c": 3}, None])
    c.execute_oc_query("MATCH (n {x: 2}) SET n:L:M SET (n).q = 1 REMOVE n:A")
    assert bag(c, "MATCH (n:L) RETURN labels(n), n.q") == rows([["L", "M"], 1])
    c.execute_oc_query("MATCH (a {x: 2}), (b {only: true}) CREATE (a)-[:E {w: 1}]->(b)")
    c.execute_oc_query("MATCH ()-[e:E]->() SET e.w = e.w + 1, e.v = 'v'")
    assert bag(c, "MATCH ()-[e:E]->() RETURN e.w, e.v") == rows([2, "v"])
    c.execute_oc_query("MATCH (a {x: 2}), (b {only: true}) SET a = b")
    assert bag(c, "MATCH (n {only: true}) RETURN n.x, n.k") == rows([None, None], [None, None])


def test_set_on_null_does_nothing(spark):
    c = graph(spark, "CREATE (:A)", "OPTIONAL MATCH (n:Nobody) SET n.x = 1")
    assert counts(c) == [1, 0, 1, 0]


def test_several_rows_of_one_node(spark):
    c = graph(spark, "CREATE (:A {x: 0})", "MATCH (n:A) UNWIND [5, 5] AS i SET n.x = i")
    assert bag(c, "MATCH (n:A) RETURN n.x") == rows([5])


def test_delete(spark):
    star = "CREATE (h:Hub), (h)-[:S]->(:Leaf {i: 1}), (h)-[:S]->(:Leaf {i: 2}), (h)-[:S]->(:Leaf {i: 3})"
    c = graph(spark, star)
    with pytest.raises(QueryError, match="DeleteConnectedNode"):
        c.execute_oc_query("MATCH (h:Hub) DELETE h")
    assert counts(c)[:2] == [4, 3]
    assert bag(c, "MATCH (h:Hub)-[r]->(l {i: 1}) DELETE r, l RETURN l.i") == rows([1])
    assert counts(c)[:2] == [3, 2]
    c.execute_oc_query("MATCH (h:Hub) DETACH DELETE h")
    assert counts(c)[:2] == [2, 0]
    c.execute_oc_query("MATCH (l:Leaf) OPTIONAL MATCH (l)-->(x) DELETE l, x")
    assert counts(c) == [0, 0, 0, 0]


def test_a_failed_query_changes_nothing(spark):
    c = graph(spark, "CREATE (:A)-[:R]->(:B)")
    with pytest.raises(QueryError, match="DeleteConnectedNode"):
        c.execute_oc_query("MATCH (a:A) SET a.x = 1 DELETE a")
    assert bag(c, "MATCH (a:A) RETURN a.x") == rows([None])


def test_named_graphs(spark):
    c = graph(spark, "CREATE GRAPH test1 CREATE (:A)")
    assert bag(c, "MATCH (n) RETURN n") == rows()
    assert bag(c, "USE test1 MATCH (n) RETURN labels(n)") == rows([["A"]])
    with pytest.raises(QueryError, match="DuplicatedGraph"):
        c.execute_oc_query("CREATE GRAPH test1")
    with pytest.raises(QueryError, match="UnknownGraph"):
        c.execute_oc_query("USE nowhere")
    assert c.graphs_list() == ["default", "test1"]
    c.delete_graph("test1")
    assert c.graphs_list() == ["default"]


def test_many_changes_are_written_down(spark):
    c = graph(spark, *[f"CREATE (:A {{i: {i}}})" for i in range(11)])
    assert bag(c, "MATCH (n:A) RETURN count(*), sum(n.i)") == rows([11, 55])
    assert c.graphs["default"].nodes[0].layers < 10


def test_parquet_store(spark, tmp_path):
    folder = str(tmp_path / "graphs")
    c = connect(spark, folder)
    c.execute_oc_query("CREATE (:A {x: 1, none: null})-[:R {w: 2.5}]->(:B {x: 'mixed'}); CREATE GRAPH g CREATE (:C)")
    again = connect(spark, folder, backend="parquet")
    assert bag(again, "MATCH (a)-[r]->(b) RETURN a.x, r.w, b.x") == rows([1, 2.5, "mixed"])
    assert bag(again, "USE g MATCH (n) RETURN labels(n)") == rows([["C"]])
    again.execute_oc_query("MATCH (a:A) SET a.x = 5; CREATE (:D)")
    assert bag(connect(spark, folder), "MATCH (a:A) RETURN a.x") == rows([5])
    again.delete_graph("g")
    assert connect(spark, folder).graphs_list() == ["default"]
    with pytest.raises(QueryError, match="UnknownBackend"):
        connect(spark, folder, backend="other")


def files(folder):
    return sorted(p.name + "/" + f.name for p in folder.iterdir() if p.is_dir() for f in p.glob("*.parquet"))


def test_a_commit_writes_what_changed(spark, tmp_path):
    c = connect(spark, str(tmp_path))
    c.execute_oc_query("UNWIND range(1, 100) AS i CREATE (:A {i: i})-[:R {w: i}]->(:B {i: i})")
    before = set(files(tmp_path))
    c.execute_oc_query("CREATE (:C {i: 0, text: 'new'})")
    added = set(files(tmp_path)) - before
    assert len(added) == 1 and next(iter(added)).startswith("nodes-")
    c.execute_oc_query("MATCH (a:A {i: 7}) SET a.i = 'seven', a.x = 1.5")
    c.execute_oc_query("MATCH (b:B {i: 9}) DETACH DELETE b")
    c.execute_oc_query("MATCH ()-[r:R {w: 3}]->() DELETE r; MATCH (a:A {i: 5}) REMOVE a.i SET a:Five")
    for connection in (c, connect(spark, str(tmp_path))):
        assert counts(connection)[:2] == [200, 98]
        assert bag(connection, "MATCH (a:A)-[r]->(b) WHERE a.x > 1 RETURN a.i, a.x, r.w, b.i") == rows(["seven", 1.5, 7, 7])
        assert bag(connection, "MATCH (c:C) RETURN c.i, c.text") == rows([0, "new"])
        assert bag(connection, "MATCH (a:Five) RETURN a.i, labels(a)") == rows([None, ["A", "Five"]])


def test_segments_are_written_together(spark, tmp_path, monkeypatch):
    from quiverlane.session import ParquetStore

    monkeypatch.setattr(ParquetStore, "MOST_SEGMENTS", 3)
    monkeypatch.setattr(ParquetStore, "KEPT", 2)
    c = connect(spark, str(tmp_path))
    for i in range(6):
        c.execute_oc_query(f"CREATE (:A {{i: {i}}})")
    assert len(c.store.manifest["default"]["nodes"]) <= 3
    assert bag(connect(spark, str(tmp_path)), "MATCH (a:A) RETURN count(*), sum(a.i)") == rows([6, 15])
    assert len(list(tmp_path.glob("manifest-*"))) == 2


def test_a_commit_that_is_cut_off(spark, tmp_path, monkeypatch):
    from quiverlane.session import ParquetStore

    c = connect(spark, str(tmp_path))
    c.execute_oc_query("CREATE (:A {i: 1})")

    def killed(*_):
        raise KeyboardInterrupt

    # after the rows were written and before they are named
    with monkeypatch.context() as m:
        m.setattr(ParquetStore, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            connect(spark, str(tmp_path)).execute_oc_query("CREATE (:A {i: 2})")
    assert bag(connect(spark, str(tmp_path)), "MATCH (a:A) RETURN a.i") == rows([1])
    # while the manifest was being written
    (tmp_path / "manifest-000000000002.json").write_text('{"default": {"next_id"')
    again = connect(spark, str(tmp_path))
    assert bag(again, "MATCH (a:A) RETURN a.i") == rows([1])
    again.execute_oc_query("CREATE (:A {i: 3})")
    assert bag(connect(spark, str(tmp_path)), "MATCH (a:A) RETURN a.i") == rows([1], [3])


def test_two_sessions(spark, tmp_path):
    connect(spark, str(tmp_path)).execute_oc_query("CREATE (:A {i: 1})")
    first, second = connect(spark, str(tmp_path)), connect(spark, str(tmp_path))
    first.execute_oc_query("CREATE (:A {i: 2})")
    with pytest.raises(QueryError, match="another session"):
        second.execute_oc_query("CREATE (:A {i: 3})")
    assert bag(connect(spark, str(tmp_path)), "MATCH (a:A) RETURN a.i") == rows([1], [2])
