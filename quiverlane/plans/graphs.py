"""Graph queries over the commerce graph, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlane.session import connect
from quiverlane.sources.commerce import commerce_graph
from quiverlane.sources.store import store_graph, store_graphs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _rounded_sql(sql: str, rounded: Sequence[str]) -> str:
    if not rounded:
        return sql
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 2) AS {c}' for c in rounded)}) FROM ({sql})"


def query(name: str, text: str, sql: str | None, rounded: Sequence[str] = (), parameters: Mapping[str, Any] | None = None, whole: str = "") -> None:
    """Registers a query. Sums of floats are rounded to cents, as their order isn't fixed. ``whole``: a
    column of nodes, whose labels and properties become columns that any engine can compare."""

    def run(spark: SparkSession, directory: str) -> DataFrame:
        df = connect(spark, graphs={"default": commerce_graph(spark, directory)}).execute(text, parameters)
        if whole:
            df = df.select(F.array_join(f"{whole}.labels", ":").alias("labels"), f"{whole}.properties.*")
        return df.withColumns({c: F.round(c, 2) for c in rounded}) if rounded else df

    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = _rounded_sql(sql, rounded)


# -- scans and predicates ------------------------------------------------------------------------

query("scan_label", "MATCH (c:Customer) WHERE c.c_acctbal > 1000 RETURN c.c_custkey AS c_custkey, c.c_name AS c_name", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 1000")
query("scan_all_nodes", "MATCH (n) RETURN count(*) AS n", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(*) FROM events) AS n")
query("pattern_property", "MATCH (o:Order {o_orderstatus: 'F', o_orderpriority: '1-URGENT'}) RETURN o.o_orderkey AS o_orderkey, o.o_totalprice AS o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
_CUSTOMER = "SELECT 'Customer' AS labels, c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey = 42"
query("single_vertex", "MATCH (c:Customer {c_custkey: $id}) RETURN c", _CUSTOMER, parameters={"$id": 42}, whole="c")
query("single_vertex_where", "MATCH (c:Customer) WHERE c.c_custkey = $id RETURN c", _CUSTOMER, parameters={"id": 42}, whole="c")
query("where_compare", "MATCH (p:Part) WHERE p.p_size >= 10 AND p.p_size < 20 AND p.p_brand <> 'Brand#11' RETURN p.p_partkey AS p_partkey, p.p_size AS p_size", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size < 20 AND p_brand <> 'Brand#11'")
query("where_boolean_3vl", "MATCH (p:Part) WHERE (p.missing = 1 OR p.p_size > 25) AND NOT (p.p_size > 40 XOR p.p_size > 45) RETURN p.p_partkey AS p_partkey", "SELECT p_partkey FROM part WHERE (CAST(NULL AS BOOLEAN) OR p_size > 25) AND NOT ((p_size > 40) <> (p_size > 45))")
query("where_in_list", "MATCH (c:Customer) WHERE c.c_mktsegment IN ['BUILDING', 'MACHINERY'] RETURN c.c_custkey AS c_custkey", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
query("where_not_in", "MATCH (p:Part) WHERE p.p_size NOT IN [1, 2, 3, 4, 5] RETURN p.p_partkey AS p_partkey", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 2, 3, 4, 5)")
query("where_in_with_null", "MATCH (p:Part) RETURN p.p_size IN [1, 2, null] AS held, count(*) AS n", "SELECT p_size IN (1, 2, NULL) AS held, count(*) AS n FROM part GROUP BY ALL")
query("label_or", "MATCH (n:Supplier|Customer) RETURN count(*) AS n", "SELECT (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS n")
query("label_or_edge_end", "MATCH (n:Customer|Supplier)-[:IN_NATION]->(m:Nation) RETURN m.n_name AS n_name, count(*) AS n", "SELECT n_name, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey GROUP BY n_name")
query("label_group", "MATCH (n:(Region|Nation)) RETURN labels(n)[0] AS label, count(*) AS n", "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation")
query("null_tests", "MATCH (p:Part) WHERE p.p_name IS NOT NULL AND p.nothing IS NULL RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE p_name IS NOT NULL")
query("parameters", "MATCH (o:Order) WHERE o.o_totalprice > $least AND o.o_orderstatus IN $states RETURN o.o_orderkey AS o_orderkey", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000.5 AND o_orderstatus IN ('O', 'P')", parameters={"$least": 150000.5, "states": ["O", "P"]})

# -- patterns ------------------------------------------------------------------------------------

query("edge_directed", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.c_custkey AS c_custkey, o.o_orderkey AS o_orderkey", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey")
query("edge_reversed", "MATCH (o:Order)<-[:PLACED]-(c:Customer) WHERE c.c_acctbal < 0 RETURN o.o_orderkey AS o_orderkey, c.c_name AS c_name", "SELECT o_orderkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0")
query("edge_undirected", "MATCH (n:Nation)--(m) RETURN n.n_name AS n_name, labels(m)[0] AS label, count(*) AS n", "SELECT n_name, 'Region' AS label, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_name UNION ALL SELECT n_name, 'Customer', count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name UNION ALL SELECT n_name, 'Supplier', count(*) FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
query("edge_properties", "MATCH (o:Order)-[l:CONTAINS {l_returnflag: 'R'}]->(p:Part) WHERE l.l_quantity > 45 RETURN o.o_orderkey AS o_orderkey, p.p_partkey AS p_partkey, l.l_quantity AS l_quantity", "SELECT l_orderkey AS o_orderkey, l_partkey AS p_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
query("edge_any_type", "MATCH (o:Order)-[l]->(x) RETURN type(l) AS type, count(*) AS n", "SELECT 'CONTAINS' AS type, count(*) AS n FROM lineitem UNION ALL SELECT 'SOLD_BY', count(*) FROM lineitem")
query("edge_type_or", "MATCH (o:Order)-[l:CONTAINS|SOLD_BY]->(x) WHERE l.l_linenumber = 1 RETURN count(*) AS n", "SELECT 2 * count(*) AS n FROM lineitem WHERE l_linenumber = 1")
query("friend_of", "MATCH (c:Customer {c_custkey: $id})-[:PLACED]->(o:Order) RETURN o.o_orderkey AS o_orderkey", "SELECT o_orderkey FROM orders WHERE o_custkey = 7", parameters={"$id": 7})
query("friend_of_filter", "MATCH (c:Customer {c_custkey: $id})-[:PLACED]->(o:Order) WHERE o.o_totalprice >= 50000.0 RETURN o.o_orderkey AS o_orderkey", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice >= 50000", parameters={"$id": 7})
query("friend_of_friend_of", "MATCH (c:Customer {c_custkey: $id})-[:PLACED]->()-[:CONTAINS]->(p:Part) RETURN p.p_partkey AS p_partkey", "SELECT l_partkey AS p_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 7", parameters={"$id": 7})
query("friend_of_friend_of_filter", "MATCH (c:Customer {c_custkey: $id})-[:PLACED]->()-[:CONTAINS]->(p:Part) WHERE p.p_size >= 18 RETURN p.p_partkey AS p_partkey", "SELECT l_partkey AS p_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_custkey = 7 AND p_size >= 18", parameters={"$id": 7})
query("chain_two_hop", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN r.r_name AS r_name, n.n_name AS n_name, s.s_name AS s_name", "SELECT r_name, n_name, s_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
query("chain_four_hop", "MATCH (r:Region {r_name: 'ASIA'})<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) RETURN n.n_name AS n_name, p.p_brand AS p_brand, count(*) AS n, sum(l.l_quantity) AS quantity", "SELECT n_name, p_brand, count(*) AS n, sum(l_quantity) AS quantity FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE r_name = 'ASIA' GROUP BY n_name, p_brand", ["quantity"])
query("comma_patterns_join", "MATCH (o:Order)-[:CONTAINS]->(p:Part), (o)-[:SOLD_BY]->(s:Supplier), (s)-[:IN_NATION]->(n:Nation) WHERE o.o_orderpriority = '1-URGENT' AND p.p_size = 1 RETURN n.n_name AS n_name, count(*) AS n", "SELECT n_name, count(*) AS n FROM orders JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN part ON p_partkey = a.l_partkey JOIN lineitem b ON b.l_orderkey = o_orderkey JOIN supplier ON s_suppkey = b.l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE o_orderpriority = '1-URGENT' AND p_size = 1 GROUP BY n_name")
query("cross_product", "MATCH (a:Region), (b:Region) WHERE a.r_regionkey < b.r_regionkey RETURN a.r_name AS a, b.r_name AS b", "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_regionkey < b.r_regionkey")
query("cross_labels", "MATCH (n:Region), (m:Nation) WHERE n.r_regionkey = m.n_nationkey AND labels(n) <> labels(m) RETURN n.r_name AS r_name, m.n_name AS n_name", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_nationkey")
query("match_match_bound", "MATCH (c:Customer) WHERE c.c_acctbal > 9000 MATCH (c)-[:IN_NATION]->(n:Nation) RETURN c.c_custkey AS c_custkey, n.n_name AS n_name", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
query("relationship_uniqueness", "MATCH (a:Order)<-[:PLACED]-(c:Customer)-[:PLACED]->(b:Order) RETURN c.c_custkey AS c_custkey, count(*) AS pairs, max(a.o_totalprice + b.o_totalprice) AS most", "SELECT c_custkey, count(*) AS pairs, max(a.o_totalprice + b.o_totalprice) AS most FROM customer JOIN orders a ON a.o_custkey = c_custkey JOIN orders b ON b.o_custkey = c_custkey WHERE a.o_orderkey <> b.o_orderkey GROUP BY c_custkey", ["most"])
query("uniqueness_parallel_edges", "MATCH (a:Part)<-[x:CONTAINS]-(o:Order)-[y:CONTAINS]->(b:Part) RETURN o.o_orderpriority AS o_orderpriority, count(*) AS n", "SELECT o_orderpriority, sum(k * (k - 1))::BIGINT AS n FROM (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1) JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderpriority")
query("uniqueness_not_across_matches", "MATCH (c:Customer)-[:PLACED]->(a:Order) MATCH (c)-[:PLACED]->(b:Order) RETURN c.c_mktsegment AS c_mktsegment, count(*) AS n", "SELECT c_mktsegment, sum(k * k)::BIGINT AS n FROM (SELECT o_custkey, count(*) AS k FROM orders GROUP BY o_custkey) JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment")
query("self_loop_pattern", "MATCH (n)-->(n) RETURN count(*) AS n", "SELECT 0::BIGINT AS n")
query("reciprocal", "MATCH (n:Customer {c_custkey: $id})-[e1:IN_NATION]->(m)<-[e2:IN_NATION]-(k:Customer) RETURN k.c_custkey AS c_custkey", "SELECT b.c_custkey FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey WHERE a.c_custkey = 7", parameters={"$id": 7})
query("named_path_length", "MATCH p = (n:Nation)-[r:IN_REGION]->(m:Region) RETURN n.n_name AS n_name, length(p) AS length, size(p) AS size", "SELECT n_name, 1::BIGINT AS length, 1::BIGINT AS size FROM nation")
query("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) RETURN c.c_custkey AS c_custkey, count(o) AS n", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
query("optional_match_where", "MATCH (c:Customer) WHERE c.c_acctbal < 500 OPTIONAL MATCH (c)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE o.o_totalprice > c.c_acctbal * 200.0 AND l.l_discount > 0.05 RETURN c.c_custkey AS c_custkey, o.o_orderkey AS o_orderkey, p.p_partkey AS p_partkey", "SELECT c_custkey, o_orderkey, p_partkey FROM customer LEFT JOIN (orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey) ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 200.0 AND l_discount > 0.05 WHERE c_acctbal < 500")
query("optional_match_null_chain", "MATCH (n:Region) OPTIONAL MATCH (n)-[:PLACED]->(o:Order) OPTIONAL MATCH (o)-[:CONTAINS]->(p:Part) RETURN n.r_name AS r_name, o IS NULL AS no_order, p.p_name AS p_name", "SELECT r_name, true AS no_order, CAST(NULL AS VARCHAR) AS p_name FROM region")
query("did_events", "MATCH (u:User)-[:DID]->(e:Event {event_type: 'purchase'}) RETURN u.user_id AS user_id, count(*) AS n, sum(e.value) AS value", "SELECT user_id, count(*) AS n, sum(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id", ["value"])

# -- projections, order and aggregates --------------------------------------------------------------

query("with_pipeline", "MATCH (o:Order) WITH o.o_custkey AS k, count(*) AS n, sum(o.o_totalprice) AS total MATCH (c:Customer) WHERE c.c_custkey = k AND n > 12 RETURN c.c_name AS c_name, n, total", "SELECT c_name, n, total FROM (SELECT o_custkey AS k, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) JOIN customer ON c_custkey = k WHERE n > 12", ["total"])
query("with_where_having", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(*) AS n WHERE n >= 15 RETURN c.c_custkey AS c_custkey, c.c_mktsegment AS c_mktsegment, n", "SELECT c_custkey, c_mktsegment, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment HAVING count(*) >= 15")
query("with_entity_through_aggregate", "MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) WITH n, max(c.c_acctbal) AS best MATCH (n)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n_name, r.r_name AS r_name, best", "SELECT n_name, r_name, max(c_acctbal) AS best FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY n_name, r_name")
query("order_by_multi", "MATCH (c:Customer) RETURN c.c_nationkey AS c_nationkey, c.c_acctbal AS c_acctbal, c.c_custkey AS c_custkey ORDER BY c.c_nationkey DESC, c.c_acctbal, c_custkey LIMIT 50", "SELECT c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_custkey FROM customer ORDER BY 1 DESC, 2, 3 LIMIT 50")
query("order_skip_limit", "MATCH (o:Order) RETURN o.o_orderkey AS o_orderkey, o.o_totalprice AS o_totalprice ORDER BY o.o_totalprice DESC, o.o_orderkey SKIP 10 LIMIT 20", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
query("order_nulls", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_orderstatus = 'P' WITH c.c_custkey AS k, max(o.o_totalprice) AS most RETURN k, most ORDER BY most DESC, k LIMIT 30", "SELECT c_custkey AS k, max(o_totalprice) AS most FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey ORDER BY most DESC NULLS FIRST, k LIMIT 30")
query("agg_count_star", "MATCH (o:Order) RETURN o.o_orderpriority AS o_orderpriority, count(*) AS n", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
query("agg_count_filter", "MATCH (o:Order) WHERE o.o_totalprice >= 18000.0 RETURN o.o_orderpriority AS o_orderpriority, count(*) AS n", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice >= 18000 GROUP BY o_orderpriority")
query("agg_count_nonnull", "MATCH (r:Region) OPTIONAL MATCH (r)<-[:IN_REGION]-(n:Nation) WHERE n.n_nationkey < 10 RETURN r.r_name AS r_name, count(n.n_name) AS n, count(*) AS rows", "SELECT r_name, count(n_name) AS n, count(*) AS rows FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey < 10 GROUP BY r_name")
query("agg_sum_group", "MATCH (o:Order)-[l:CONTAINS]->(:Part) RETURN l.l_returnflag AS l_returnflag, l.l_linestatus AS l_linestatus, sum(l.l_extendedprice * (1.0 - l.l_discount)) AS revenue, sum(l.l_linenumber) AS numbers", "SELECT l_returnflag, l_linestatus, sum(l_extendedprice * (1.0 - l_discount)) AS revenue, sum(l_linenumber)::BIGINT AS numbers FROM lineitem GROUP BY ALL", ["revenue"])
query("agg_avg", "MATCH (c:Customer) RETURN c.c_mktsegment AS c_mktsegment, avg(c.c_acctbal) AS mean", "SELECT c_mktsegment, avg(c_acctbal) AS mean FROM customer GROUP BY c_mktsegment", ["mean"])
query("agg_min_max", "MATCH (o:Order) RETURN min(o.o_totalprice) AS least, max(o.o_totalprice) AS most, avg(o.o_totalprice) AS mean", "SELECT min(o_totalprice) AS least, max(o_totalprice) AS most, avg(o_totalprice) AS mean FROM orders", ["mean"])
query("agg_expr_mixed", "MATCH (p:Part) RETURN p.p_brand AS p_brand, count(*) + 1 AS n, max(p.p_size) - min(p.p_size) AS spread", "SELECT p_brand, count(*) + 1 AS n, (max(p_size) - min(p_size))::BIGINT AS spread FROM part GROUP BY p_brand")
query("agg_empty", "MATCH (c:Customer) WHERE c.c_mktsegment = 'NONE' RETURN count(*) AS n, sum(c.c_acctbal) AS s, min(c.c_name) AS m", "SELECT count(*) AS n, sum(c_acctbal) AS s, min(c_name) AS m FROM customer WHERE c_mktsegment = 'NONE'")
query("collect_size", "MATCH (n:Nation)<-[:IN_NATION]-(c:Customer) WITH n, collect(c.c_custkey) AS keys RETURN n.n_name AS n_name, size(keys) AS n", "SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
query("flagship", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.r_name AS r_name, count(*) AS orders, sum(o.o_totalprice) AS revenue ORDER BY revenue DESC", "SELECT r_name, count(*) AS orders, sum(o_totalprice) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name", ["revenue"])

# -- lists and functions ----------------------------------------------------------------------------

query("unwind_list", "MATCH (r:Region) UNWIND [1, 2, r.r_regionkey] AS x RETURN r.r_name AS r_name, x", "SELECT r_name, unnest([1, 2, r_regionkey])::BIGINT AS x FROM region")
query("unwind_range", "UNWIND range(1, 10) AS x RETURN x, x * x AS y", "SELECT x::BIGINT AS x, (x * x)::BIGINT AS y FROM range(1, 11) t(x)")
query("unwind_collect_roundtrip", "MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier) WITH n.n_name AS n_name, collect(s.s_suppkey) AS keys UNWIND keys AS k RETURN n_name, k", "SELECT n_name, s_suppkey AS k FROM nation JOIN supplier ON s_nationkey = n_nationkey")
query("unwind_entities", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r, collect(n) AS nations UNWIND nations AS n RETURN r.r_name AS r_name, n.n_name AS n_name", "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
query("fn_head", "MATCH (r:Region) RETURN head([r.r_name, 'x']) AS first, head([]) AS nothing", "SELECT r_name AS first, NULL AS nothing FROM region")
query("fn_keys", "MATCH (r:Region) UNWIND keys(r) AS k RETURN k, count(*) AS n", "SELECT unnest(['r_name', 'r_regionkey']) AS k, (SELECT count(*) FROM region) AS n")
query("fn_range", "MATCH (r:Region) UNWIND range(0, r.r_regionkey) AS i RETURN r.r_name AS r_name, i", "SELECT r_name, unnest(range(0, r_regionkey + 1))::BIGINT AS i FROM region")
query("fn_size", "MATCH (p:Part) RETURN size(range(1, p.p_size)) AS s, count(*) AS n", "SELECT p_size::BIGINT AS s, count(*) AS n FROM part GROUP BY p_size")
query("fn_type", "MATCH (:Customer)-[r]->(m) RETURN type(r) AS type, labels(m)[0] AS label, count(*) AS n", "SELECT 'IN_NATION' AS type, 'Nation' AS label, count(*) AS n FROM customer UNION ALL SELECT 'PLACED', 'Order', count(*) FROM orders")
query("fn_ceil_floor", "MATCH (c:Customer) RETURN c.c_custkey AS c_custkey, ceil(c.c_acctbal) AS up, floor(c.c_acctbal) AS down", "SELECT c_custkey, ceil(c_acctbal)::DOUBLE AS up, floor(c_acctbal)::DOUBLE AS down FROM customer")
query("fn_labels", "MATCH (n) UNWIND labels(n) AS l RETURN l, count(*) AS n", "SELECT 'Region' AS l, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'User', count(DISTINCT user_id) FROM events UNION ALL SELECT 'Event', count(*) FROM events")
query("fn_length", "MATCH (n:Nation) RETURN n.n_name AS n_name, length([1, n.n_regionkey]) AS l", "SELECT n_name, 2::BIGINT AS l FROM nation")
query("fn_coalesce", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 300000.0 RETURN c.c_custkey AS c_custkey, coalesce(o.o_orderkey, -1) AS k", "SELECT c_custkey, coalesce(o_orderkey, -1) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000")
query("fn_properties", "MATCH (n:Nation) WITH properties(n) AS p RETURN p.n_name AS n_name, p.n_regionkey AS k", "SELECT n_name, n_regionkey::BIGINT AS k FROM nation")
query("fn_to_integer", "MATCH (c:Customer) RETURN c.c_custkey AS c_custkey, toInteger(c.c_acctbal) AS i, toInteger('12') AS s", "SELECT c_custkey, trunc(c_acctbal)::BIGINT AS i, 12::BIGINT AS s FROM customer")
query("fn_to_string", "MATCH (p:Part) RETURN p.p_partkey AS p_partkey, toString(p.p_size) AS s, toString(p.p_size * 1.0) AS f, toString(p.p_size > 20) AS b", "SELECT p_partkey, p_size::VARCHAR AS s, p_size::VARCHAR AS f, CASE WHEN p_size > 20 THEN 'true' ELSE 'false' END AS b FROM part")
query("fn_has_label", "MATCH (n:Region|Nation) RETURN has_label(n, 'Region') AS r, count(*) AS n", "SELECT true AS r, count(*) AS n FROM region UNION ALL SELECT false, count(*) FROM nation")
query("fn_has_labels", "MATCH (n:Region|Nation) WHERE n:Nation RETURN count(*) AS n", "SELECT count(*) AS n FROM nation")
query("rand_range", "MATCH (r:Region) WITH r.r_name AS r_name, rand() AS x WHERE x >= 0.0 AND x < 1.0 RETURN r_name", "SELECT r_name FROM region")

# -- operators ----------------------------------------------------------------------------------------

query("arith_int_div_mod", "MATCH (c:Customer) WITH c.c_custkey AS k RETURN k, k / 7 AS d, (3 - k) / 7 AS nd, k % 7 AS m, (3 - k) % 7 AS nm, -k AS neg", "SELECT c_custkey AS k, c_custkey // 7 AS d, trunc((3 - c_custkey) / 7.0)::BIGINT AS nd, c_custkey % 7 AS m, (3 - c_custkey) % 7 AS nm, -c_custkey AS neg FROM customer")
query("arith_float", "MATCH (p:Part) RETURN p.p_partkey AS p_partkey, p.p_retailprice / 3 AS d, p.p_retailprice + p.p_size AS s, p.p_retailprice - 1 AS m, p.p_size * 0.5 AS h", "SELECT p_partkey, p_retailprice / 3 AS d, p_retailprice + p_size AS s, p_retailprice - 1 AS m, p_size * 0.5::DOUBLE AS h FROM part", ["d", "s", "m"])
query("string_concat", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name + '/' + n.n_name AS path", "SELECT r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
query("list_concat_append", "MATCH (n:Nation) UNWIND [n.n_nationkey] + [100, 200] + n.n_regionkey AS x RETURN n.n_name AS n_name, x", "SELECT n_name, unnest([n_nationkey, 100, 200, n_regionkey])::BIGINT AS x FROM nation")
query("list_index_slice", "MATCH (p:Part) WITH p.p_partkey AS k, range(1, 5) AS l RETURN k, l[k % 5] AS i, size(l[1..3]) AS a, l[2..][0] AS b, size(l[..-1]) AS c, size(l[-2..]) AS e", "SELECT p_partkey AS k, (p_partkey % 5 + 1)::BIGINT AS i, 2::BIGINT AS a, 3::BIGINT AS b, 4::BIGINT AS c, 2::BIGINT AS e FROM part")
query("list_compare", "MATCH (n:Nation) RETURN n.n_name AS n_name, [n.n_regionkey, 1] = [1, 1] AS eq, [9] < [1, 2] AS shorter, [1, n.n_regionkey] < [1, 3] AS lt", "SELECT n_name, n_regionkey = 1 AS eq, true AS shorter, n_regionkey < 3 AS lt FROM nation")
query("map_access", "MATCH (c:Customer) WITH {k: c.c_custkey, inner: {b: c.c_acctbal}} AS m RETURN m.k AS k, m['inner'].b AS b, m.none AS none", "SELECT c_custkey AS k, c_acctbal AS b, NULL AS none FROM customer")
query("xor", "MATCH (p:Part) RETURN p.p_size > 10 XOR p.p_size > 30 AS x, count(*) AS n", "SELECT (p_size > 10) <> (p_size > 30) AS x, count(*) AS n FROM part GROUP BY ALL")
query("type_mismatch", "MATCH (r:Region) RETURN r.r_name = 1 AS eq, r.r_name <> 1 AS ne, r.r_name < 1 AS lt, r.r_regionkey = 1.0 AS num", "SELECT false AS eq, true AS ne, CAST(NULL AS BOOLEAN) AS lt, r_regionkey = 1 AS num FROM region")
query("not_binds_tighter", "MATCH (p:Part) WHERE NOT (p.p_size = 1) = false RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE p_size = 1")

query("column_names", "MATCH (r:Region) RETURN count(*), 1+2, max( r.r_regionkey ) AS most", "SELECT count(*) AS \"count(*)\", 3::BIGINT AS \"1+2\", max(r_regionkey)::BIGINT AS most FROM region")
query("equal_maps", "MATCH (n:Nation) RETURN {a: n.n_regionkey, b: 'x'} = {b: 'x', a: 1} AS eq, {a: 1} = {b: 1} AS other, {a: n.n_regionkey} <> {a: 1} AS ne, count(*) AS n", "SELECT n_regionkey = 1 AS eq, false AS other, n_regionkey <> 1 AS ne, count(*) AS n FROM nation GROUP BY ALL")
query("equal_nodes", "MATCH (a:Region), (b:Region) RETURN a = b AS same, a <> b AS other, count(*) AS n", "SELECT a.r_regionkey = b.r_regionkey AS same, a.r_regionkey <> b.r_regionkey AS other, count(*) AS n FROM region a, region b GROUP BY ALL")
query("equal_edges", "MATCH ()-[e:IN_REGION]->(r) MATCH (n)-[f:IN_REGION]->(r) RETURN e = f AS same, count(*) AS n", "SELECT a.n_nationkey = b.n_nationkey AS same, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey GROUP BY ALL")
query("equal_paths", "MATCH p = (n:Nation)-[:IN_REGION]->(r:Region) MATCH q = (m:Nation)-[:IN_REGION]->(r) RETURN p = q AS same, count(*) AS n", "SELECT a.n_nationkey = b.n_nationkey AS same, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey GROUP BY ALL")
query("mixed_order", "MATCH (n:Nation) UNWIND [n.n_nationkey, n.n_name, n.n_regionkey = 1, n.n_regionkey * 1.5] AS x WITH x ORDER BY x SKIP 20 LIMIT 40 RETURN toString(x) AS x", "SELECT x FROM (SELECT 1 AS k, n_name AS x, NULL::DOUBLE AS d FROM nation UNION ALL SELECT 2, CASE WHEN n_regionkey = 1 THEN 'true' ELSE 'false' END, n_regionkey = 1 FROM nation UNION ALL SELECT 3, n_nationkey::VARCHAR, n_nationkey FROM nation UNION ALL SELECT 3, CASE WHEN n_regionkey % 2 = 0 THEN (n_regionkey * 3 // 2)::VARCHAR ELSE (n_regionkey * 1.5)::DOUBLE::VARCHAR END, n_regionkey * 1.5 FROM nation) ORDER BY k, d, x LIMIT 40 OFFSET 20")
query("literals", "RETURN 0x1F AS hex, 0o17 AS oct, 'a\\tb\\'c' AS text, 1e3 AS large, .5 AS small, -7 AS minus, true AS yes, null AS nothing, size([1, [2], {a: 3}]) AS n", "SELECT 31::BIGINT AS hex, 15::BIGINT AS oct, 'a' || chr(9) || 'b''c' AS text, 1000::DOUBLE AS large, 0.5::DOUBLE AS small, -7::BIGINT AS minus, true AS yes, NULL AS nothing, 3::BIGINT AS n")
query("several_queries", "MATCH (n:Nation) RETURN count(*) AS n; MATCH (r:Region) RETURN r.r_name AS r_name", "SELECT r_name FROM region")
query("arith_mixed", "MATCH (p:Part) UNWIND [p.p_size, p.p_retailprice] AS x RETURN p.p_partkey AS k, avg(x + 1) AS s", "SELECT p_partkey AS k, (p_size + p_retailprice + 2) / 2 AS s FROM part", ["s"])

# -- writing: on a copy held by the connection ----------------------------------------------------------


def script(name: str, texts: Sequence[str], sql: str, rounded: Sequence[str] = ()) -> None:
    """Registers a query that ends a script of writing queries."""

    def run(spark: SparkSession, directory: str) -> DataFrame:
        connection = connect(spark, graphs={"default": commerce_graph(spark, directory)})
        df = None
        for text in texts:
            df = connection.execute(text)
        return df.withColumns({c: F.round(c, 2) for c in rounded}) if rounded else df

    QUERIES[name] = run
    ORACLE[name] = _rounded_sql(sql, rounded)


script("create_nodes_edges", ["MATCH (n:Nation)-[:IN_REGION]->(r:Region) CREATE (c:City {name: n.n_name + ' City', nation: n.n_nationkey})-[:CAPITAL_OF {since: n.n_nationkey * 10}]->(n)", "MATCH (c:City)-[e:CAPITAL_OF]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN c.name AS city, e.since AS since, r.r_name AS r_name"], "SELECT n_name || ' City' AS city, (n_nationkey * 10)::BIGINT AS since, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
script("set_property", ["MATCH (s:Supplier) WHERE s.s_acctbal < 0 SET s.debt = -s.s_acctbal, s.s_name = 'gone'", "MATCH (s:Supplier) RETURN s.s_suppkey AS s_suppkey, s.s_name AS s_name, s.debt AS debt"], "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'gone' ELSE s_name END AS s_name, CASE WHEN s_acctbal < 0 THEN -s_acctbal END AS debt FROM supplier")
script("set_nested", ["MATCH (r:Region) SET r.a.b = r.r_regionkey SET r.a.c = 'x'", "MATCH (r:Region) RETURN r.r_name AS r_name, r.a.b AS b, r.a.c AS c"], "SELECT r_name, r_regionkey::BIGINT AS b, 'x' AS c FROM region")
script("set_merge", ["MATCH (n:Nation) SET n += {n_name: null, rank: n.n_nationkey + 1}", "MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS n_name, n.rank AS rank"], "SELECT n_nationkey::BIGINT AS k, CAST(NULL AS VARCHAR) AS n_name, (n_nationkey + 1)::BIGINT AS rank FROM nation")
script("set_labels", ["MATCH (c:Customer) WHERE c.c_acctbal > 5000 SET c:Rich:Known", "MATCH (c:Rich:Customer) REMOVE c:Known", "MATCH (c:Rich) RETURN c.c_custkey AS c_custkey, size(labels(c)) AS n, c:Known AS known"], "SELECT c_custkey, 2::BIGINT AS n, false AS known FROM customer WHERE c_acctbal > 5000")
script("remove_property", ["MATCH (s:Supplier) WHERE s.s_nationkey = 3 REMOVE s.s_name", "MATCH (s:Supplier) RETURN s.s_name IS NULL AS gone, count(*) AS n"], "SELECT s_nationkey = 3 AS gone, count(*) AS n FROM supplier GROUP BY ALL")
script("delete_edges", ["MATCH (c:Customer)-[p:PLACED]->(o:Order) WHERE o.o_orderstatus = 'F' DELETE p", "MATCH (c:Customer)-[p:PLACED]->(o:Order) RETURN count(*) AS n"], "SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F'")
script("detach_delete", ["MATCH (r:Region {r_name: 'ASIA'}) DETACH DELETE r", "MATCH (n:Nation) OPTIONAL MATCH (n)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r_name, count(*) AS n"], "SELECT CASE WHEN r_name <> 'ASIA' THEN r_name END AS r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
script("create_delete_graph", ["MATCH (r:Region) CREATE (:Copy {name: r.r_name})-[:OF]->(r)", "MATCH (c:Copy)-[e:OF]->(r:Region {r_name: 'ASIA'}) DELETE e, c", "MATCH (c:Copy)-[:OF]->(r) RETURN c.name AS name, r.r_regionkey AS k"], "SELECT r_name AS name, r_regionkey::BIGINT AS k FROM region WHERE r_name <> 'ASIA'")
script("multi_graph", ["CREATE GRAPH other UNWIND range(1, 5) AS i CREATE (:Thing {i: i})", "USE other MATCH (t:Thing) RETURN t.i AS i"], "SELECT i::BIGINT AS i FROM range(1, 6) t(i)")

_COUNTED = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "events": ["event_id", "ts", "event_type", "value", "props"]}
_LINE = "l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
query(
    "statistics",
    "CALL internal.stats()",
    "SELECT (" + " + ".join(f"(SELECT count(*) FROM {t})" for t in _COUNTED) + " + (SELECT count(DISTINCT user_id) FROM events))::BIGINT AS nodes_count, "
    "((SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM events))::BIGINT AS edges_count, "
    "8::BIGINT AS labels_nodes_count, (" + " + ".join(f"(SELECT {' + '.join(f'count({c})' for c in cs)} FROM {t})" for t, cs in _COUNTED.items()) + " + (SELECT count(DISTINCT user_id) FROM events) + 2 * (SELECT " + " + ".join(f"count({c})" for c in _LINE) + " FROM lineitem))::BIGINT AS properties_count",
)

# -- over the tables of a graph store ------------------------------------------------------------------

_STORE = """
WITH raw AS (SELECT id, graph_name, labels, properties, loaded_at FROM nodes UNION ALL SELECT id, NULL, labels, properties, loaded_at FROM shared_nodes),
deaths AS (SELECT node_id, max(deleted_at) AS deleted FROM node_tombstones GROUP BY node_id),
once AS (
  SELECT nid, g, labels, p FROM (SELECT id AS nid, max(graph_name) AS g, max(labels) AS labels, max(properties) AS p, max(loaded_at) AS loaded FROM raw WHERE id IS NOT NULL GROUP BY id)
  LEFT JOIN deaths ON node_id = nid WHERE NOT coalesce(deleted >= loaded, false)),
inner_texts AS (SELECT nid, g, labels, CASE WHEN json_valid(p) AND json_type(p) = 'VARCHAR' THEN json_extract_string(p, '$') ELSE p END AS p FROM once),
n AS (
  SELECT nid, g, CASE WHEN starts_with(labels, ':') THEN list_filter(string_split(labels, ':'), lambda x: x <> '')
                      WHEN json_valid(labels) AND json_type(labels) = 'ARRAY' THEN list_transform(list_filter(json_extract(labels, '$[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: json_extract_string(x, '$')) ELSE [] END AS labels,
         CASE WHEN json_valid(p) AND json_type(p) = 'OBJECT' THEN p END AS p
  FROM inner_texts),
v AS (SELECT nid, g, labels, p, TRY_CAST(json_extract_string(p, '$.id') AS BIGINT) AS id, TRY_CAST(json_extract_string(p, '$.age') AS BIGINT) AS age, json_extract_string(p, '$.name') AS name FROM n),
edge AS (SELECT id AS eid, max(graph_name) AS eg, max(left_id) AS l, max(right_id) AS r, max(properties) AS ep, max(labels) AS el FROM edges GROUP BY id),
e AS (
  SELECT eid, eg, l, r, CASE WHEN json_valid(ep) AND json_type(ep) = 'OBJECT' THEN ep END AS ep, el
  FROM (SELECT eid, eg, l, r, CASE WHEN json_valid(ep) AND json_type(ep) = 'VARCHAR' THEN json_extract_string(ep, '$') ELSE ep END AS ep, el FROM edge WHERE l IS NOT NULL AND r IS NOT NULL)),
found AS (SELECT e.*, a.g AS lg, b.g AS rg FROM e JOIN n a ON l = a.nid JOIN n b ON r = b.nid)
"""


def stored(name: str, text: str, sql: str, parameters: Mapping[str, Any] | None = None, rounded: Sequence[str] = ()) -> None:
    """Registers a query over all graphs of the store as one."""

    def run(spark: SparkSession, directory: str) -> DataFrame:
        df = connect(spark, graphs={"default": store_graph(spark, directory)}).execute(text, parameters)
        return df.withColumns({c: F.round(c, 2) for c in rounded}) if rounded else df

    QUERIES[name] = run
    ORACLE[name] = _STORE + _rounded_sql(sql, rounded)


# The patterns of a social network's workload.
stored("store_single_vertex", "MATCH (n:User {id: $id}) RETURN n.id AS id, n.name AS name, n.age AS age, size(keys(n)) AS n_keys, labels(n)[0] AS label", "SELECT id, name, age, (SELECT count(*) FROM json_each(p) je WHERE je.type <> 'NULL') AS n_keys, labels[1] AS label FROM v WHERE list_contains(labels, 'User') AND id = 1001", {"$id": 1001})
stored("store_friend_of", "MATCH (s:User {id: $id})-->(n:User) RETURN n.id AS id", "SELECT b.id FROM v a JOIN e ON l = a.nid JOIN v b ON r = b.nid WHERE list_contains(a.labels, 'User') AND a.id = 1001 AND list_contains(b.labels, 'User')", {"$id": 1001})
stored("store_friend_of_filter", "MATCH (s:User {id: $id})-->(n:User) WHERE n.age >= 18 RETURN n.id AS id", "SELECT b.id FROM v a JOIN e ON l = a.nid JOIN v b ON r = b.nid WHERE list_contains(a.labels, 'User') AND a.id = 1001 AND list_contains(b.labels, 'User') AND b.age >= 18", {"$id": 1001})
stored("store_friend_of_friend_of", "MATCH (s:User {id: $id})-->()-->(n:User) WHERE n.age >= 18 RETURN n.id AS id, count(*) AS ways", "SELECT c.id, count(*) AS ways FROM v a JOIN e x ON x.l = a.nid JOIN v b ON x.r = b.nid JOIN e y ON y.l = b.nid AND y.eid <> x.eid JOIN v c ON y.r = c.nid WHERE list_contains(a.labels, 'User') AND a.id = 1001 AND list_contains(c.labels, 'User') AND c.age >= 18 GROUP BY c.id", {"$id": 1001})
stored("store_reciprocal_friends", "MATCH (n {id: $id})-[e1]->(m)-[e2]->(n) RETURN m.id AS id, count(*) AS ways", "SELECT b.id, count(*) AS ways FROM v a JOIN e x ON x.l = a.nid JOIN v b ON x.r = b.nid JOIN e y ON y.l = b.nid AND y.r = a.nid AND y.eid <> x.eid WHERE a.id = 1001 GROUP BY b.id", {"$id": 1001})
stored("store_aggregate_count", "MATCH (n:User) RETURN n.age AS age, count(*) AS n", "SELECT age, count(*) AS n FROM v WHERE list_contains(labels, 'User') GROUP BY age")
stored("store_aggregate_count_filter", "MATCH (n:User) WHERE n.age >= 18 RETURN n.age AS age, count(*) AS n", "SELECT age, count(*) AS n FROM v WHERE list_contains(labels, 'User') AND age >= 18 GROUP BY age")
stored("store_aggregate_min_max_avg", "MATCH (n:User) RETURN min(n.age) AS least, max(n.age) AS most, avg(n.age) AS mean", "SELECT min(age) AS least, max(age) AS most, avg(age) AS mean FROM v WHERE list_contains(labels, 'User')", rounded=["mean"])
stored("store_labels", "MATCH (n) UNWIND labels(n) AS label RETURN label, count(*) AS n", "SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM v) GROUP BY label")
stored("store_degrees", "MATCH (a:User)-[x]-(b) RETURN a.id AS id, count(x) AS degree", "SELECT a.id, count(*) AS degree FROM v a JOIN (SELECT l AS s, r AS t FROM e UNION ALL SELECT r, l FROM e WHERE l <> r) ON s = a.nid JOIN v b ON t = b.nid WHERE list_contains(a.labels, 'User') GROUP BY a.id")
stored("store_keys", "MATCH (n) UNWIND keys(n) AS key RETURN key, count(*) AS n", "SELECT je.key AS key, count(*) AS n FROM n, json_each(p) je WHERE je.type <> 'NULL' GROUP BY ALL")
stored("store_whole_ages", "MATCH (n) WHERE n.age IS NOT NULL RETURN n.age AS age, count(*) AS n", "SELECT age, count(*) AS n FROM v WHERE age IS NOT NULL GROUP BY age")
stored("store_properties", "MATCH (n) RETURN count(n.links) AS links, count(n.KG) AS kg, count(n.thread) AS threads, sum(size(n.links)) AS n_links, count(head(n.thread.replies).by) AS answered", "SELECT count(*) FILTER (json_type(p, '$.links') <> 'NULL') AS links, count(*) FILTER (json_type(p, '$.KG') <> 'NULL') AS kg, count(*) FILTER (json_type(p, '$.thread') <> 'NULL') AS threads, sum(json_array_length(p, '$.links'))::BIGINT AS n_links, count(*) FILTER (json_type(p, '$.thread.replies[0].by') <> 'NULL') AS answered FROM n")
stored("store_edge_keys", "MATCH ()-[e]->() UNWIND keys(e) AS key RETURN key, count(*) AS n", "SELECT je.key AS key, count(*) AS n FROM found, json_each(ep) je WHERE je.type <> 'NULL' GROUP BY ALL")
stored("store_edge_property", "MATCH ()-[e]->() WHERE e.sum >= 3 RETURN e.sum AS sum, count(*) AS n", "SELECT CAST(json_extract_string(ep, '$.sum') AS BIGINT) AS sum, count(*) AS n FROM found WHERE CAST(json_extract_string(ep, '$.sum') AS BIGINT) >= 3 GROUP BY ALL")
stored("store_deleted", "MATCH (n) OPTIONAL MATCH (n)-[e]->(m) RETURN count(*) AS rows, count(e) AS edges", "SELECT count(*) AS rows, count(eid) AS edges FROM n LEFT JOIN found ON l = nid")


def stored_named(name: str, text: str, sql: str) -> None:
    """Registers a query that names one of the store's graphs."""
    QUERIES[name] = lambda spark, directory: connect(spark, graphs=store_graphs(spark, directory)).execute(text)
    ORACLE[name] = _STORE + sql


_SHARED = "nid IN (SELECT id FROM shared_nodes)"
stored_named("store_use_graph", "USE social MATCH (n) RETURN n:User AS user, count(*) AS n, count(n.age) AS ages", f"SELECT list_contains(labels, 'User') AS user, count(*) AS n, count(age) AS ages FROM v WHERE g = 'social' OR {_SHARED} GROUP BY ALL")
stored_named("store_default_graph", "MATCH (n) RETURN count(*) AS n", f"SELECT count(*) AS n FROM n WHERE g = 'default' OR g IS NULL OR {_SHARED}")
stored_named("store_use_edges", "USE catalogue MATCH (a)-[e]->(b) RETURN has_label(e, 'FOLLOWS') AS follows, count(*) AS n", f"""
, ends AS (SELECT nid FROM n WHERE g = 'catalogue' OR {_SHARED}),
typed AS (
  SELECT CASE WHEN starts_with(el, ':') THEN list_filter(string_split(el, ':'), lambda x: x <> '')
              WHEN json_valid(el) AND json_type(el) = 'ARRAY' THEN list_transform(list_filter(json_extract(el, '$[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: json_extract_string(x, '$')) ELSE [] END AS types
  FROM e WHERE eg = 'catalogue' AND l IN (SELECT nid FROM ends) AND r IN (SELECT nid FROM ends))
SELECT list_contains(types, 'FOLLOWS') AS follows, count(*) AS n FROM typed GROUP BY ALL""")
