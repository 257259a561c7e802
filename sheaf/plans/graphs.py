"""Queries on components, notes and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components as comp
from ..operators import spans
from ..sources.tables import table


def components_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("r"), F.floor(F.col("s_acctbal") / 500).cast("long").alias("c"))
    return comp.components(s, comp.grid_edges(s, "r", "c", "k", 1), "k")


def notes_hit_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order, as a point, the last line item rectangle of the order that holds it."""
    notes = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("w"))
    points = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 80).alias("x"))
    inside = (F.col("x") >= F.col("l_linenumber") * 5) & (F.col("x") <= F.col("l_linenumber") * 5 + F.col("w"))
    return points.join(notes, "l_orderkey").filter(inside).groupBy("l_orderkey").agg(F.max("l_linenumber").alias("note"))


def citation_mask_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with bracketed numbers, masked and restored."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    t = o.select("o_orderkey", F.format_string("as shown in [%d, %d] and elsewhere [%d].", F.col("o_orderkey"), F.col("o_orderkey") + 1, F.col("o_custkey")).alias("text"))
    m = t.withColumn("m", spans.mask("text"))
    return m.select("o_orderkey", F.col("m.masked").alias("masked"), (spans.restore(F.col("m.masked"), F.col("m.tokens"), F.col("m.cited")) == F.col("text")).alias("restored"))


def translation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey")
    k = F.col("o_orderkey") % 5
    pair = o.withColumn("before", F.lit("see ⟦C0⟧ here")).withColumn("after", F.when(k == 0, "").when(k == 1, "见 ⟦C1⟧").when(k == 2, "见 ⟦C0⟧ ⟫").when(k == 3, "see ⟦C0⟧").otherwise("见 ⟦C0⟧"))
    return spans.translation_issue(pair, "before", "after").select("o_orderkey", "issue")


QUERIES = {f.__name__: f for f in (components_grid, notes_hit_test, citation_mask_restore, translation_checks)}
ORACLE_SQL = {
    "components_grid": """
WITH RECURSIVE s AS (SELECT s_suppkey AS k, s_nationkey AS r, CAST(floor(s_acctbal / 500) AS BIGINT) AS c FROM supplier),
e0 AS (SELECT k AS a, lead(k) OVER (PARTITION BY r ORDER BY c, k) AS b, lead(c) OVER (PARTITION BY r ORDER BY c, k) - c AS d FROM s
  UNION ALL SELECT k, lead(k) OVER (PARTITION BY c ORDER BY r, k), lead(r) OVER (PARTITION BY c ORDER BY r, k) - r FROM s),
e AS (SELECT a, b FROM e0 WHERE d <= 1 UNION SELECT b, a FROM e0 WHERE d <= 1),
w(k, m) AS (SELECT k, k FROM s UNION SELECT e.b, w.m FROM w JOIN e ON e.a = w.k)
SELECT k, min(m) AS component FROM w GROUP BY k""",
    "notes_hit_test": """
WITH n AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS w FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, max(l_linenumber) AS note FROM n JOIN orders ON o_orderkey = l_orderkey
WHERE o_custkey % 80 BETWEEN l_linenumber * 5 AND l_linenumber * 5 + w GROUP BY 1""",
    "citation_mask_restore": "SELECT o_orderkey, 'as shown in ⟦C0⟧ and elsewhere ⟦C1⟧.' AS masked, true AS restored FROM orders",
    "translation_checks": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'tokens' WHEN 2 THEN 'markup' WHEN 3 THEN 'language' END AS issue FROM orders",
}
