"""Queries over the tables of a graph store: references, heavy keys, wide tables, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlane.operators import nested, references, salted, wide
from quiverlane.sources import read_table

#: Part of all rows of edges above which a node is reported as heavy.
HEAVY_EDGE_SHARE = 0.01


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    edges = references.earliest_references(read_table(spark, d, "edges", "id", "left_id", "right_id", "loaded_at"), "edges", "id", ["left_id", "right_id"], "loaded_at")
    props = references.earliest_references(read_table(spark, d, "node_props", "row_no", "node_id", "loaded_at"), "node_props", "row_no", ["node_id"], "loaded_at")
    loads = [read_table(spark, d, t, F.col("id").alias("node_id"), F.col("loaded_at").alias("at")) for t in ("nodes", "shared_nodes")]
    deletions = read_table(spark, d, "node_tombstones", "node_id", F.col("deleted_at").alias("at"))
    return edges.unionByName(props), loads[0].unionByName(loads[1]), deletions


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(*_references(spark, d)).select("ref_table", "ref_id", "ref_field", "fate")


def p1_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(*_references(spark, d))


def _edge_ends(spark: SparkSession, d: str) -> DataFrame:
    """One row per end of each row of edges; null ends included."""
    edges = read_table(spark, d, "edges", "id", "left_id", "right_id", "made_at")
    ends = F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left_id").alias("node_id"), F.col("right_id").alias("other_id")), F.struct(F.lit("right").alias("side"), F.col("right_id").alias("node_id"), F.col("left_id").alias("other_id"))))
    return edges.select("id", "made_at", ends.alias("e")).select("id", "made_at", "e.*")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    per_node = salted.salted_aggregate(_edge_ends(spark, d), ["side", "node_id"], [salted.Agg("n_rows", "rows")])
    n = read_table(spark, d, "edges").agg(F.count(F.lit(1)).alias("n")).scalar()
    return per_node.where(F.col("node_id").isNotNull() & (F.col("n_rows") > n * HEAVY_EDGE_SHARE)).select("side", "node_id")


def p3_node_results(spark: SparkSession, d: str) -> DataFrame:
    """Per side and node: its rows, edges, neighbours, loops, and when its edges were made."""
    aggs = [
        salted.Agg("n_rows", "rows"),
        salted.Agg("n_edges", "distinct", F.col("id")),
        salted.Agg("n_neighbours", "distinct", F.col("other_id")),
        salted.Agg("n_loops", "sum", (F.col("node_id") == F.col("other_id")).cast("int")),
        salted.Agg("first_made", "min", F.col("made_at")),
        salted.Agg("last_made", "max", F.col("made_at")),
    ]
    return salted.salted_aggregate(_edge_ends(spark, d), ["side", "node_id"], aggs).where("node_id is not null").withColumn("n_loops", F.coalesce("n_loops", F.lit(0)))


def _props(spark: SparkSession, d: str) -> tuple[DataFrame, list[wide.Attribute]]:
    return read_table(spark, d, "node_props", "node_id", "prop_name", "prop_text", "loaded_at", "row_no"), wide.catalog_of(read_table(spark, d, "prop_catalog"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.unsettled_cells(*_props(spark, d))


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    """The wide table with its maps and lists as text, which any engine can compare."""
    props, attributes = _props(spark, d)
    table = wide.wide_table(props, attributes)

    def text(a: wide.Attribute):
        return F.array_join(a.name, "|").alias(a.name) if a.is_multi else F.col(a.name)

    return table.select("node_id", *[text(a) for a in attributes], F.size("faults").cast("bigint").alias("n_faults"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = nested.latest_rows(read_table(spark, d, "nodes", "id", "properties", "loaded_at"), "id", ["properties"], "loaded_at")
    return nested.flatten_objects(nodes, "id", "properties").withColumnRenamed("id", "node_id")


def p5_objects(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of all objects in arrays with their scalar members, as lines of text that any engine can compare."""
    nodes = nested.latest_rows(read_table(spark, d, "nodes", "id", "properties", "loaded_at"), "id", ["properties"], "loaded_at")
    lines = F.array_sort(F.transform(F.map_entries("members"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return nested.flatten_objects(nodes, "id", "properties", members=True).withColumnRenamed("id", "node_id").withColumn("members", F.array_join(lines, "\n"))


QUERIES = {f.__name__: f for f in (p1_found, p1_orphan_counts, p3_found, p3_node_results, p4_found, p4_wide, p5_found, p5_objects)}

_REFERENCES = """
WITH e AS (SELECT id, min(left_id) AS left_id, min(right_id) AS right_id, min(loaded_at) AS tm FROM edges GROUP BY id),
p AS (SELECT row_no, min(node_id) AS node_id, min(loaded_at) AS tm FROM node_props GROUP BY row_no),
refs AS (
  SELECT 'edges' AS ref_table, id AS ref_id, 'left_id' AS ref_field, left_id AS node_id, tm FROM e WHERE left_id IS NOT NULL
  UNION ALL SELECT 'edges', id, 'right_id', right_id, tm FROM e WHERE right_id IS NOT NULL
  UNION ALL SELECT 'node_props', row_no, 'node_id', node_id, tm FROM p WHERE node_id IS NOT NULL),
loads AS (SELECT id AS node_id, loaded_at AS tm FROM nodes UNION ALL SELECT id, loaded_at FROM shared_nodes),
known AS (SELECT DISTINCT node_id FROM loads),
hits AS (
  SELECT r.ref_table, r.ref_id, r.ref_field, r.tm, k.node_id IS NULL AS missing,
         (SELECT max(l.tm) FROM loads l WHERE l.node_id = r.node_id AND l.tm <= r.tm) AS last_load,
         (SELECT max(t.deleted_at) FROM node_tombstones t WHERE t.node_id = r.node_id AND t.deleted_at <= r.tm) AS last_death
  FROM refs r LEFT JOIN known k ON r.node_id = k.node_id),
fates AS (
  SELECT ref_table, ref_id, ref_field, strftime(tm, '%Y-%m') AS period,
         CASE WHEN missing THEN 'missing' WHEN last_load IS NULL THEN 'late' WHEN last_death >= last_load THEN 'deleted' END AS fate
  FROM hits)
"""

_ENDS = """
WITH ends AS (
  SELECT 'left' AS side, left_id AS node_id, right_id AS other_id, id, made_at FROM edges
  UNION ALL SELECT 'right', right_id, left_id, id, made_at FROM edges)
"""

_VALUES = r"""
WITH rows AS (
  SELECT n.node_id, c.prop_name, c.value_kind AS kind, c.is_multi, trim(n.prop_text, ' ') AS text, n.loaded_at, n.row_no
  FROM node_props n JOIN prop_catalog c ON lower(trim(n.prop_name, ' ')) = lower(trim(c.prop_name, ' '))
  WHERE n.node_id IS NOT NULL),
vals AS (
  SELECT *,
    CASE WHEN kind = 'Integer' AND regexp_full_match(text, '[+-]?[0-9]+') THEN TRY_CAST(ltrim(text, '+') AS BIGINT) END AS i,
    CASE WHEN kind = 'Float' AND regexp_full_match(text, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(ltrim(text, '+') AS DOUBLE) + 0.0 END AS f,
    CASE WHEN kind = 'Boolean' AND lower(text) IN ('true', 'false') THEN lower(text) = 'true' END AS b,
    CASE WHEN kind = 'String' THEN text END AS s
  FROM rows),
read AS (SELECT *, (i IS NOT NULL OR f IS NOT NULL OR b IS NOT NULL OR s IS NOT NULL) AS ok FROM vals),
cells AS (
  SELECT node_id, prop_name, is_multi, count(text) AS n, count(CASE WHEN ok THEN 1 END) AS n_ok,
    coalesce(min(i) <> max(i), false) OR coalesce(min(f) <> max(f), false) OR coalesce(min(CAST(b AS INT)) <> max(CAST(b AS INT)), false) OR coalesce(min(s) <> max(s), false) AS differ
  FROM read GROUP BY node_id, prop_name, is_multi),
faults AS (
  SELECT node_id, prop_name, CASE WHEN n_ok = 0 THEN 'unreadable' ELSE 'conflict' END AS fault
  FROM cells WHERE NOT is_multi AND n > 0 AND (n_ok = 0 OR differ))
"""


def _wide_sql() -> str:
    """The columns of the catalog, which is the same at every scale."""
    of = {"i": ("age", "index", "sum", "visits", "rank"), "f": ("score", "weight", "ratio"), "b": ("active", "verified"), "s": ("name", "home", "note")}
    columns = ", ".join(f"""max(CASE WHEN x.prop_name = '{n}' THEN x.{k} END) AS "{n}\"""" for k, names in of.items() for n in names)
    return (
        _VALUES
        + f""", best AS (
  SELECT *, row_number() OVER (PARTITION BY node_id, prop_name ORDER BY loaded_at DESC, row_no DESC, text DESC) AS r FROM read WHERE ok AND NOT is_multi),
labels AS (SELECT node_id, string_agg(text, '|' ORDER BY text) AS label FROM (SELECT DISTINCT node_id, text FROM read WHERE ok AND is_multi) GROUP BY node_id),
ids AS (SELECT DISTINCT node_id FROM rows),
singles AS (SELECT x.node_id, {columns} FROM best x WHERE x.r = 1 GROUP BY x.node_id),
counted AS (SELECT node_id, count(*) AS n_faults FROM faults GROUP BY node_id)
SELECT ids.node_id, singles.* EXCLUDE (node_id), coalesce(l.label, '') AS label, coalesce(c.n_faults, 0) AS n_faults
FROM ids LEFT JOIN singles ON ids.node_id = singles.node_id LEFT JOIN labels l ON ids.node_id = l.node_id LEFT JOIN counted c ON ids.node_id = c.node_id"""
    )


#: Every object and array of each node's map, level by level.
_WALK = """
WITH RECURSIVE once AS (SELECT id AS node_id, max(properties) AS p FROM nodes WHERE id IS NOT NULL GROUP BY id),
texts AS (SELECT node_id, CASE WHEN json_valid(p) AND json_type(p) = 'VARCHAR' THEN json_extract_string(p, '$') ELSE p END AS p FROM once),
maps AS (SELECT node_id, p::JSON AS j FROM texts WHERE json_valid(p) AND json_type(p) = 'OBJECT'),
walk(node_id, parent_path, path, j, t, listed, ordinal) AS (
  SELECT node_id, '$', '$', j, 'OBJECT', false, 0 FROM maps
  UNION ALL
  SELECT w.node_id, CASE WHEN w.listed AND w.t = 'OBJECT' THEN w.path ELSE w.parent_path END, w.path || CASE WHEN w.t = 'ARRAY' THEN '[' || je.key || ']' ELSE '.' || je.key END,
         je.value, je.type, w.t = 'ARRAY', CASE WHEN w.t = 'ARRAY' THEN CAST(je.key AS INT) END
  FROM walk w, json_each(w.j) je WHERE w.t IN ('OBJECT', 'ARRAY') AND je.type IN ('OBJECT', 'ARRAY')),
objects AS (SELECT node_id, parent_path, path AS child_path, ordinal, j FROM walk WHERE listed AND t = 'OBJECT')
"""

ORACLE = {
    "p5_found": _WALK + "SELECT node_id, parent_path, child_path FROM objects",
    "p5_objects": _WALK + "SELECT node_id, parent_path, child_path, ordinal, coalesce((SELECT string_agg(je.key || '=' || CAST(je.value AS VARCHAR), chr(10) ORDER BY je.key || '=' || CAST(je.value AS VARCHAR)) FROM json_each(j) je WHERE je.type NOT IN ('OBJECT', 'ARRAY')), '') AS members FROM objects",
    "p1_found": _REFERENCES + "SELECT ref_table, ref_id, ref_field, fate FROM fates WHERE fate IS NOT NULL",
    "p1_orphan_counts": _REFERENCES + "SELECT ref_table, ref_field, period, fate, count(*) AS n_references FROM fates WHERE fate IS NOT NULL GROUP BY ALL",
    "p3_found": _ENDS + "SELECT side, node_id FROM ends WHERE node_id IS NOT NULL GROUP BY side, node_id HAVING count(*) > 0.01 * (SELECT count(*) FROM edges)",
    "p3_node_results": _ENDS + "SELECT side, node_id, count(*) AS n_rows, count(DISTINCT id) AS n_edges, count(DISTINCT other_id) AS n_neighbours, CAST(coalesce(sum(CASE WHEN node_id = other_id THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_loops, min(made_at) AS first_made, max(made_at) AS last_made FROM ends WHERE node_id IS NOT NULL GROUP BY side, node_id",
    "p4_found": _VALUES + "SELECT node_id, prop_name, fault FROM faults",
    "p4_wide": _wide_sql(),
}
