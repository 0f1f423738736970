"""Queries of this subpackage and the SQL twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlane.llm import encode, labels, mixing, residue, terms
from quiverlane.operators.nested import latest_rows
from quiverlane.sources import read_table

MIX_SEED = 20240501


#: A label is rare in fewer records than this, and common in more than this part of all records.
RARE_BELOW, COMMON_ABOVE = 5, 0.4


def _labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The label list of each node, and the nodes' ids."""
    nodes = latest_rows(read_table(spark, d, "nodes", "id", "labels", "loaded_at"), "id", ["labels"], "loaded_at")
    return labels.parse_labels(nodes, "id", "labels"), nodes.select("id")


def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every label with its occurrences, its nodes and its band."""
    lists, ids = _labels(spark, d)
    n = ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    return terms.banded(terms.count_values(lists, "labels"), n, RARE_BELOW, COMMON_ABOVE).withColumnRenamed("value", "label")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_labels(spark, d).where("band is not null").select("label", "band")


def _ngrams(spark: SparkSession, d: str, most_n: int | None) -> DataFrame:
    return terms.count_ngrams(_labels(spark, d)[0], "labels", most_n).select(F.array_join("ngram", "\n").alias("ngram"), F.size("ngram").cast("bigint").alias("n"), "n_occurrences", "n_records")


def p2_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of up to three labels."""
    return _ngrams(spark, d, 3)


def p2_all_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of labels of every length that occurs."""
    return _ngrams(spark, d, None)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(read_table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", encode.vocabulary_path())


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents", "doc_id", "source", "text")
    return mixing.kept_sizes(encode.count_tokens(docs, "text", encode.vocabulary_path(), ["doc_id", "source"]))


def _plan(spark: SparkSession, d: str, sizes: DataFrame) -> DataFrame:
    return mixing.plan_mix(sizes, read_table(spark, d, "mix_targets"), MIX_SEED)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_shares(_plan(spark, d, _sizes(spark, d))).where("short").select("source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each source contributes to the mix, and whether it is short."""
    return mixing.mix_shares(_plan(spark, d, _sizes(spark, d)))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix and how often each is repeated."""
    sizes = _sizes(spark, d)
    return mixing.mix(sizes, _plan(spark, d, sizes), "doc_id", MIX_SEED)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(read_table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p8_matches(spark: SparkSession, d: str) -> DataFrame:
    """Which passages are residue of what kind."""
    return residue.residue_matches(read_table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """What is left of each source once documents with residue are excluded."""
    docs = read_table(spark, d, "documents", "doc_id", "source", "text", "n_chars")
    return residue.without_residue(docs, "doc_id", "text").groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_chars").alias("n_chars"))


QUERIES = {f.__name__: f for f in (p2_found, p2_labels, p2_ngrams, p2_all_ngrams, p6_ids, p7_found, p7_shares, p7_mix, p8_found, p8_matches, p8_kept)}

_LABELS = """
WITH n AS (SELECT id, max(labels) AS labels FROM nodes GROUP BY id),
lists AS (SELECT id, unnest(json_extract(labels, '$[*]')) AS j FROM n WHERE json_valid(labels) AND json_type(labels) = 'ARRAY'),
pieces AS (SELECT id, unnest(string_split(labels, ':')) AS label FROM n WHERE starts_with(labels, ':')),
carried AS (
  SELECT id, json_extract_string(j, '$') AS label FROM lists WHERE json_type(j) = 'VARCHAR'
  UNION ALL SELECT id, label FROM pieces WHERE label <> ''),
counted AS (SELECT label, count(*) AS n_occurrences, count(DISTINCT id) AS n_records FROM carried GROUP BY label),
banded AS (
  SELECT *, CASE WHEN n_records < 5 THEN 'rare' WHEN n_records > 0.4 * (SELECT count(*) FROM n) THEN 'common' END AS band FROM counted)
"""

ORACLE = {
    "p2_found": _LABELS + "SELECT label, band FROM banded WHERE band IS NOT NULL",
    "p2_labels": _LABELS + "SELECT label, n_occurrences, n_records, band FROM banded",
    "p2_ngrams": """
WITH n AS (SELECT id, max(labels) AS labels FROM nodes GROUP BY id),
lists AS (
  SELECT id, CASE WHEN starts_with(labels, ':') THEN list_filter(string_split(labels, ':'), lambda x: x <> '')
                  WHEN json_valid(labels) AND json_type(labels) = 'ARRAY' THEN list_transform(list_filter(json_extract(labels, '$[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: json_extract_string(x, '$')) END AS l
  FROM n),
starts AS (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM lists WHERE len(l) > 0),
grams AS (SELECT s.id, k.n, array_to_string(list_slice(l, i, i + k.n - 1), chr(10)) AS ngram FROM starts s CROSS JOIN (SELECT unnest([1, 2, 3])::BIGINT AS n) k WHERE i + k.n - 1 <= len(l))
SELECT ngram, n, count(*) AS n_occurrences, count(DISTINCT id) AS n_records FROM grams GROUP BY ngram, n""",
    "p2_all_ngrams": """
WITH n AS (SELECT id, max(labels) AS labels FROM nodes GROUP BY id),
lists AS (
  SELECT id, CASE WHEN starts_with(labels, ':') THEN list_filter(string_split(labels, ':'), lambda x: x <> '')
                  WHEN json_valid(labels) AND json_type(labels) = 'ARRAY' THEN list_transform(list_filter(json_extract(labels, '$[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: json_extract_string(x, '$')) END AS l
  FROM n),
starts AS (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM lists WHERE len(l) > 0),
spans AS (SELECT id, l, i, unnest(range(1, len(l) - i + 2)) AS n FROM starts),
grams AS (SELECT id, n, array_to_string(list_slice(l, i, i + n - 1), chr(10)) AS ngram FROM spans)
SELECT ngram, n, count(*) AS n_occurrences, count(DISTINCT id) AS n_records FROM grams GROUP BY ngram, n""",
}
