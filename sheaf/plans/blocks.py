"""Queries on folds, titles and rule cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, repeated, rules
from ..sources.tables import table
from .shelf import bytes_sql


def rect_merge_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    x0, y0 = F.col("l_linenumber") * 10.0, (F.col("l_partkey") % 30).cast("double")
    rects = t.select("l_orderkey", x0.alias("x0"), y0.alias("y0"), (x0 + F.col("l_quantity")).alias("x1"), (y0 + 10).alias("y1")).distinct()
    return blocks.merge_rectangles(rects, ["l_orderkey"])


def paragraph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").withColumn("who", F.when(F.col("role") == "system", "system").otherwise("talk"))
    return blocks.merge_paragraphs(t, ["conv_id"], "turn", "who", "text", 600)


def title_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part", "p_brand", "p_name", "p_size", "p_partkey")
    return blocks.title_candidate(t, "p_brand", F.col("p_size"), F.col("p_partkey"), "p_name")


def nontranslatable_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = repeated.split_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return lines.select("doc_id", "line_no", blocks.untranslatable(F.col("line")).alias("rule")).filter(F.col("rule").isNotNull())


def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "source", "text").groupBy("source").agg(F.sum(F.octet_length("text").cast("long")).alias("b"))
    return d.select("source", rules.human_bytes(F.col("b")).alias("size"))


QUERIES = {f.__name__: f for f in (rect_merge_fold, paragraph_merge, title_inference, nontranslatable_rules, human_sizes)}
ORACLE_SQL = {
    "rect_merge_fold": """
WITH RECURSIVE d AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber * 10.0 AS DOUBLE) AS x0, CAST(l_partkey % 30 AS DOUBLE) AS y0, CAST(l_linenumber * 10.0 + l_quantity AS DOUBLE) AS x1, CAST(l_partkey % 30 + 10 AS DOUBLE) AS y1 FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY x0, y0, x1, y1) AS n FROM d),
w(k, n, no, x0, y0, x1, y1) AS (
  SELECT l_orderkey, n, 0, x0, y0, x1, y1 FROM r WHERE n = 1
  UNION ALL
  SELECT k, r.n, CASE WHEN m THEN no ELSE no + 1 END, CASE WHEN m THEN least(w.x0, r.x0) ELSE r.x0 END, CASE WHEN m THEN least(w.y0, r.y0) ELSE r.y0 END, CASE WHEN m THEN greatest(w.x1, r.x1) ELSE r.x1 END, CASE WHEN m THEN greatest(w.y1, r.y1) ELSE r.y1 END
  FROM w JOIN r ON r.l_orderkey = w.k AND r.n = w.n + 1, LATERAL (SELECT greatest(w.x0, r.x0) < least(w.x1, r.x1) AND greatest(w.y0, r.y0) < least(w.y1, r.y1) AS m) z),
l AS (SELECT *, row_number() OVER (PARTITION BY k, no ORDER BY n DESC) AS q FROM w)
SELECT k AS l_orderkey, no, x0, y0, x1, y1 FROM l WHERE q = 1""",
    "paragraph_merge": """
WITH RECURSIVE r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CASE WHEN role = 'system' THEN 'system' ELSE 'talk' END AS who, text FROM conversations),
w(c, i, no, who, n, body) AS (
  SELECT conv_id, i, 0, who, 1, text FROM r WHERE i = 1
  UNION ALL
  SELECT c, r.i, CASE WHEN m THEN no ELSE no + 1 END, r.who, CASE WHEN m THEN n + 1 ELSE 1 END, CASE WHEN m THEN body || ' ' || r.text ELSE r.text END
  FROM w JOIN r ON r.conv_id = w.c AND r.i = w.i + 1, LATERAL (SELECT w.who = r.who AND length(body) + 1 + length(r.text) <= 600 AS m) z),
l AS (SELECT *, row_number() OVER (PARTITION BY c, no ORDER BY i DESC) AS q FROM w)
SELECT c AS conv_id, no, who, n, body FROM l WHERE q = 1""",
    "title_inference": "SELECT p_brand, arg_max(p_name, (p_size, -p_partkey, p_name)) AS title FROM part GROUP BY p_brand",
    "nontranslatable_rules": r"""
WITH l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) x, LATERAL unnest(range(1, len(parts) + 1)) u(i)),
c AS (SELECT doc_id, line_no, CASE WHEN length(trim(t)) = 0 THEN 'empty' WHEN NOT regexp_matches(t, '\p{L}') THEN 'symbols'
  WHEN regexp_full_match(t, '\s*(https?://|www\.)\S+\s*') OR regexp_full_match(t, '\s*\S+@\S+\.\S+\s*') THEN 'address'
  WHEN regexp_full_match(t, '\s*[\w.]+\([^)]*\)\s*;?\s*') THEN 'code' WHEN length(t) < 12 AND upper(t) = t THEN 'capitals'
  WHEN regexp_full_match(t, '\s*[0-9.,]+\s*[A-Za-z%]{1,3}\s*') THEN 'quantity' END AS rule FROM l)
SELECT doc_id, line_no, rule FROM c WHERE rule IS NOT NULL""",
    "human_sizes": f"SELECT source, {bytes_sql('b')} AS size FROM (SELECT source, sum(octet_length(encode(text)))::BIGINT AS b FROM documents GROUP BY source)",
}
