"""The tables of a trading company as a property graph."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession

from quiverlane.graph import PropertyGraph
from quiverlane.sources.tables import read_table

#: Properties of the edges that order lines make.
LINE = "l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


@lru_cache(maxsize=4)
def commerce_graph(spark: SparkSession, directory: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts, orders, users and events.

    Each table is one node frame; foreign keys and order lines are the edges. Only the schemas are
    read. As with any open database, a session keeps the graph of a directory that it opened.
    """
    t = {n: read_table(spark, directory, n) for n in "region nation customer supplier part orders lineitem events".split()}
    g = PropertyGraph()
    for label, table, key in (("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("Order", "orders", "o_orderkey")):
        g = g.with_nodes(label, t[table], key)
    g = g.with_nodes("User", t["events"].select("user_id").distinct(), "user_id")
    g = g.with_nodes("Event", t["events"], "event_id", ["event_id", "ts", "event_type", "value", "props"])
    g = g.with_edges("IN_REGION", t["nation"], ("Nation", "n_nationkey"), ("Region", "n_regionkey"), "n_nationkey")
    g = g.with_edges("IN_NATION", t["customer"], ("Customer", "c_custkey"), ("Nation", "c_nationkey"), "c_custkey")
    g = g.with_edges("IN_NATION", t["supplier"], ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), "s_suppkey")
    g = g.with_edges("PLACED", t["orders"], ("Customer", "o_custkey"), ("Order", "o_orderkey"), "o_orderkey")
    g = g.with_edges("CONTAINS", t["lineitem"], ("Order", "l_orderkey"), ("Part", "l_partkey"), None, LINE)
    g = g.with_edges("SOLD_BY", t["lineitem"], ("Order", "l_orderkey"), ("Supplier", "l_suppkey"), None, LINE)
    return g.with_edges("DID", t["events"], ("User", "user_id"), ("Event", "event_id"), "event_id")
