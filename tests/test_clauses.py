from collections import Counter

import pytest

from quiverlane.session import connect
from quiverlane.sources.commerce import commerce_graph


def graph(spark, *texts):
    connection = connect(spark)
    for t in texts:
        connection.execute_oc_query(t)
    return connection


def bag(connection, text, parameters=None):
    """The rows as a multiset."""
    return Counter(map(repr, connection.execute_oc_query(text, parameters)[1:]))


def rows(*wanted):
    return Counter(repr(list(r)) for r in wanted)


@pytest.fixture(scope="module")
def cycle(spark):
    return graph(spark, "CREATE (a:A:E {name: 'a', index: 0})-[:AB {sum: 1}]->(b:B {name: 'b', index: 1})-[:BC {sum: 3}]->(c:C:F {name: 'c', index: 2})-[:CD {sum: 5}]->(d:D {name: 'd', index: 3})-[:DA {sum: 3}]->(a)")


@pytest.fixture(scope="module")
def loops(spark):
    return graph(spark, "CREATE (x {n: 1})-[:L]->(x), (y {n: 2})-[:P]->(z {n: 3})")


@pytest.fixture(scope="module")
def parallel(spark):
    return graph(spark, "CREATE (a {n: 1}), (b {n: 2}), (a)-[:R {k: 1}]->(b), (a)-[:R {k: 2}]->(b), (a)-[:R {k: 3}]->(b)")


@pytest.fixture(scope="module")
def values(spark):
    return graph(spark, "CREATE ({g: 'a', num: 33}), ({g: 'a'}), ({g: 'b', num: 42}), ({g: 'b', num: null})")


@pytest.fixture(scope="module")
def mixed(spark):
    return graph(spark, "CREATE ({v: 1}), ({v: 1.0}), ({v: 'a'}), ({v: true}), ({v: [1]}), ({v: {k: 1}}), ({v: 0.0 / 0}), ({w: 1})")


def test_directions(cycle):
    assert bag(cycle, "MATCH (x {name: 'a'})-->(y) RETURN y.name") == rows(["b"])
    assert bag(cycle, "MATCH (x {name: 'a'})<--(y) RETURN y.name") == rows(["d"])
    assert bag(cycle, "MATCH (x {name: 'a'})--(y) RETURN y.name") == rows(["b"], ["d"])
    assert bag(cycle, "MATCH (x)-[r {sum: 3}]->(y) RETURN x.name, y.name") == rows(["b", "c"], ["d", "a"])


def test_chains(cycle):
    assert bag(cycle, "MATCH (w:A)-->(x)-->(y)<-[:BC]-(z) RETURN z.name") == rows()
    assert bag(cycle, "MATCH (w:A)-->(x)-->(y)-->(z)-->(w) RETURN x.name, y.name, z.name") == rows(["b", "c", "d"])
    assert bag(cycle, "MATCH (x:B), (y:D) MATCH (x)-->(m)-->(y) RETURN m.name") == rows(["c"])


def test_labels(cycle):
    assert bag(cycle, "MATCH (n:A:E) RETURN n.name") == rows(["a"])
    assert bag(cycle, "MATCH (n:A|B) RETURN n.name") == rows(["a"], ["b"])
    assert bag(cycle, "MATCH (n:A|B:C) RETURN n.name") == rows(["a"])
    assert bag(cycle, "MATCH (n:A:C) RETURN n") == rows()
    assert bag(cycle, "MATCH (n:A|C)-->(m) RETURN m.name") == rows(["b"], ["d"])
    assert bag(cycle, "MATCH (n) WHERE n:F RETURN n.name, n:C:F, has_label(n, 'D')") == rows(["c", True, False])


def test_self_loops(loops):
    assert bag(loops, "MATCH (n)-->(n) RETURN n.n") == rows([1])
    assert bag(loops, "MATCH (a)--(b) RETURN a.n, b.n") == rows([1, 1], [2, 3], [3, 2])
    assert bag(loops, "MATCH (a)-[r]-(b) WHERE a.n = 1 RETURN type(r)") == rows(["L"])


def test_uniqueness(parallel):
    assert bag(parallel, "MATCH (a)-[x]->(b)<-[y]-(a) RETURN x.k, y.k") == rows(*[[i, j] for i in (1, 2, 3) for j in (1, 2, 3) if i != j])
    assert bag(parallel, "MATCH (a)-[x]->(b) MATCH (a)-[y]->(b) RETURN count(*)") == rows([9])
    assert bag(parallel, "MATCH (a)-[x]->(b), (a)-[y]->(b) RETURN count(*)") == rows([6])
    assert bag(parallel, "MATCH (a)-[r {k: 2}]->(b) MATCH (x)-[r]->(y) RETURN x.n, y.n") == rows([1, 2])
    assert bag(parallel, "MATCH (a)-[r {k: 2}]->(b) MATCH (x)<-[r]-(y) RETURN x.n, y.n") == rows([2, 1])
    assert bag(parallel, "MATCH (a)-[r {k: 2}]->(b) MATCH (x)-[r]-(y) RETURN x.n, y.n") == rows([1, 2], [2, 1])


def test_paths(cycle):
    _, (p, n) = cycle.execute_oc_query("MATCH p = (x:A)-[r]->(y) RETURN p, length(p)")
    assert (p["type"], p["labels"], p["properties"], p["source"]["properties"]["name"], p["destination"]["labels"], n) == ("path", ["AB"], {"sum": 1}, "a", ["B"], 1)


def test_entities_as_results(cycle):
    _, (a, r) = cycle.execute_oc_query("MATCH (a:A)-[r]->() RETURN a, r")
    assert (a["type"], a["labels"], a["properties"]) == ("node", ["A", "E"], {"index": 0, "name": "a"})
    assert (r["type"], r["labels"], r["properties"]) == ("edge", ["AB"], {"sum": 1})


def test_optional_match(cycle):
    assert bag(cycle, "MATCH (a:A) OPTIONAL MATCH (a)-[:NONE]->(x) RETURN x, x.name, labels(x)") == rows([None, None, None])
    assert bag(cycle, "MATCH (a) OPTIONAL MATCH (a)-->(x) WHERE x.index > a.index AND x.index > 1 RETURN a.name, x.name") == rows(["a", None], ["b", "c"], ["c", "d"], ["d", None])
    assert bag(cycle, "OPTIONAL MATCH (a:Nobody) OPTIONAL MATCH (a)-->(b) RETURN a, b") == rows([None, None])
    assert bag(cycle, "OPTIONAL MATCH (a:Nobody) MATCH (a)-->(b) RETURN b") == rows()
    assert bag(cycle, "UNWIND [1, 1, 2] AS i OPTIONAL MATCH (n {index: i}) RETURN i, n.name") == rows([1, "b"], [1, "b"], [2, "c"])
    assert bag(cycle, "MATCH (a:A) OPTIONAL MATCH (a)-[r]->(b)-[s]->(c) RETURN type(r), type(s), c.name") == rows(["AB", "BC", "c"])


def test_optional_match_on_nothing(spark):
    assert bag(graph(spark), "OPTIONAL MATCH (a) RETURN a") == rows([None])


def test_where_keeps_what_is_neither_null_nor_false(values):
    assert bag(values, "MATCH (n) WHERE n.num RETURN n.num") == rows([33], [42])
    assert bag(values, "MATCH (n) WHERE NOT (n.num > 40) RETURN n.num") == rows([33])


def test_aggregates(values):
    assert bag(values, "MATCH (n) RETURN n.g, count(n.num), count(*)") == rows(["a", 1, 2], ["b", 1, 2])
    assert bag(values, "MATCH (n) RETURN sum(n.num), avg(n.num), min(n.num), max(n.num), size(collect(n.num))") == rows([75, 37.5, 33, 42, 4])
    assert bag(values, "MATCH (n) WHERE n.g = 'z' RETURN count(*), sum(n.num), max(n.g), collect(n.g)") == rows([0, None, None, []])
    assert bag(values, "MATCH (n) WHERE n.g = 'z' RETURN n.g, count(*)") == rows()
    assert bag(values, "MATCH (n) RETURN count(*) + 1 AS c, 2 * sum(n.num) AS s") == rows([5, 150])
    assert bag(values, "MATCH (n) RETURN n.g + '!' AS g, count(*) * 10 AS c") == rows(["a!", 20], ["b!", 20])


def test_aggregates_on_an_empty_graph(spark):
    assert graph(spark).execute_oc_query("MATCH (a) RETURN count(*)") == [["count(*)"], [0]]


def test_projection_and_scope(values):
    assert bag(values, "MATCH (n) WITH n.num AS x WHERE x > 35 RETURN x") == rows([42])
    assert bag(values, "MATCH (n) WITH n AS m ORDER BY n.num DESC SKIP 2 LIMIT 1 RETURN m.num") == rows([42])
    assert values.execute_oc_query("MATCH (n) WHERE n.num > 0 RETURN n.g AS g ORDER BY n.num DESC") == [["g"], ["b"], ["a"]]
    assert values.execute_oc_query("MATCH (n) RETURN n.g, count(*) ORDER BY count(*) DESC, n.g LIMIT 1") == [["n.g", "count(*)"], ["a", 2]]
    assert bag(values, "WITH 1 AS a, 2 AS b RETURN *") == rows([1, 2])
    assert bag(values, "WITH 1 AS a WITH *, 2 AS b RETURN a + b AS c") == rows([3])


def test_sort_order(values, mixed):
    assert values.execute_oc_query("MATCH (n) RETURN n.num AS x ORDER BY x")[1:] == [[33], [42], [None], [None]]
    assert values.execute_oc_query("MATCH (n) RETURN n.num AS x ORDER BY x DESC")[1:] == [[None], [None], [42], [33]]
    ordered = [x for (x,) in mixed.execute_oc_query("MATCH (n) RETURN n.v AS v ORDER BY v")[1:]]
    assert ordered[:4] == [{"k": 1}, [1], "a", True] and sorted(ordered[4:6]) == [1, 1.0] and ordered[6] != ordered[6] and ordered[7] is None
    assert bag(mixed, "MATCH (n) WHERE n.v = 1 RETURN count(*)") == rows([2])
    assert bag(mixed, "MATCH (n) WHERE n.v > 0 RETURN count(*)") == rows([2])
    assert bag(mixed, "MATCH (n) RETURN max(n.v) <> 1 AS nan_is_largest, count(n.v)") == rows([True, 7])
    assert bag(mixed, "MATCH (n {v: 'a'}) RETURN n.v + n.v") == rows(["aa"])


def test_maps_are_sorted_by_size_first(spark):
    c = graph(spark, "CREATE ({m: {a: 5, b: 1}}), ({m: {a: 9}}), ({m: {a: 1}}), ({x: 1})")
    assert [m for (m,) in c.execute_oc_query("MATCH (n) RETURN n.m AS m ORDER BY m")[1:]] == [{"a": 1}, {"a": 9}, {"a": 5, "b": 1}, None]


def test_unwind(values):
    assert bag(values, "UNWIND [1, null, 2] AS x RETURN x") == rows([1], [None], [2])
    assert bag(values, "UNWIND null AS x RETURN x") == rows()
    assert bag(values, "UNWIND [] AS x RETURN x") == rows()
    assert bag(values, "UNWIND 5 AS x RETURN x") == rows([5])
    assert bag(values, "UNWIND [[1, 2], [3]] AS l UNWIND l AS x RETURN x") == rows([1], [2], [3])
    assert bag(values, "MATCH (n) WITH collect(n) AS ns UNWIND ns AS n RETURN n.g, n.num") == rows(["a", 33], ["a", None], ["b", 42], ["b", None])


def test_several_results(spark):
    assert graph(spark).execute_oc_query("RETURN 1 AS x; CREATE (); MATCH (n) RETURN count(*) AS n") == {"type": "results", "results": [[["x"], [1]], None, [["n"], [1]]]}


def test_optional_patterns_of_several_edges(cycle):
    assert bag(cycle, "MATCH (d:D) OPTIONAL MATCH (a)-[:CD]->(d)-[r]->(b)-->(c) RETURN a.name, b.name, c.name") == rows(["c", "a", "b"])
    assert bag(cycle, "MATCH (a {index: 0}), (d {index: 3}) OPTIONAL MATCH (a)-->(b)-->(c)-->(d) RETURN b.name, c.name") == rows(["b", "c"])
    assert bag(cycle, "MATCH (a), (d:B) OPTIONAL MATCH (a)-->(x)-->(d) RETURN a.name, x.name") == rows(["a", None], ["b", None], ["c", None], ["d", "a"])
    assert bag(cycle, "OPTIONAL MATCH (n:Nobody) OPTIONAL MATCH (n)-->(x)-->(y) RETURN n, x, y") == rows([None, None, None])
    assert bag(cycle, "MATCH (a:A) OPTIONAL MATCH (a)-->(x)-->(y), (y)-->(z) RETURN z.name") == rows(["d"])


def test_optional_patterns_begin_with_the_outer_nodes(spark, data):
    c = connect(spark, graphs={"default": commerce_graph(spark, data)})
    df = c.execute("MATCH (c:Customer) WHERE c.c_name = 'x' OPTIONAL MATCH (c)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) RETURN c.c_custkey AS k, o.o_orderkey AS o, p.p_name AS p")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    semi = plan.index("LeftSemi")
    # orders meet the customers before order lines are joined
    assert plan.index("Inner") < semi and plan[semi:].index("o_orderkey") < plan[semi:].index("l_orderkey")
