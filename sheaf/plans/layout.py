"""Queries on statistics, intervals, rectangles and order-sensitive operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import folds, intervals, repeated, stats
from ..sources.tables import table


def translatable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = repeated.split_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    flagged = lines.withColumn("math", F.regexp_count("line", F.lit("[#$%&*|]")) > 5).withColumn("skip", F.length("line") < 20)
    return flagged.filter(~F.col("math") & ~F.col("skip") & F.col("line").rlike(r"[\p{L}\p{N}]")).select("doc_id", "line_no", "line")


def weighted_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag")
    return t.groupBy("l_orderkey").agg(stats.weighted_mean(F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_quantity").cast("decimal(6,0)")).alias("mean_size"), stats.weighted_majority(F.col("l_returnflag") == "N", F.col("l_quantity")).alias("mostly_n"))


def weighted_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return stats.weighted_mode(t.withColumn("l_linenumber", F.col("l_linenumber") * 10 + F.ascii("l_returnflag") % 10), ["l_orderkey"], "l_returnflag", "l_quantity", "l_linenumber")


def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_type", "value").groupBy("event_type").agg(stats.upper_median("value").alias("median"))


def weighted_lower_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.weighted_median(table(spark, sf_dir, "lineitem", "l_suppkey", "l_extendedprice", "l_quantity"), ["l_suppkey"], "l_extendedprice", "l_quantity", upper=False)


def weighted_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.weighted_median(table(spark, sf_dir, "lineitem", "l_suppkey", "l_extendedprice", "l_quantity"), ["l_suppkey"], "l_extendedprice", "l_quantity", upper=True)


def cluster_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events", "event_id", "user_id", "ts")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    found = stats.clusters(t, ["user_id"], micros, ["ts", "event_id"], 3600.0)
    return found.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    spans = t.select("l_orderkey", (F.col("l_linenumber") * 10.0).alias("start"), (F.col("l_linenumber") * 10.0 + F.col("l_quantity")).alias("end"))
    return intervals.merge_intervals(spans, ["l_orderkey"], "start", "end")


def _rects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    a = line.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("no"), (F.col("l_linenumber") * 10.0).alias("a_x0"), F.lit(0.0).alias("a_y0"), (F.col("l_linenumber") * 10.0 + 8).alias("a_x1"), F.col("l_quantity").alias("a_y1"))
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    b = o.select(F.col("o_orderkey").alias("k"), F.lit(0.0).alias("b_x0"), F.lit(0.0).alias("b_y0"), (F.col("o_custkey") % 60).cast("double").alias("b_x1"), F.lit(40.0).alias("b_y1"))
    return a, b


def spatial_contain_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _rects(spark, sf_dir)
    return intervals.inside(a, b, ["k"]).select("k", "part", "no")


def spatial_contain_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _rects(spark, sf_dir)
    return intervals.inside(a, b, ["k"], anti=True).select("k", "part", "no")


def nearest_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    errors = events.filter("event_type = 'purchase'").withColumnRenamed("event_id", "purchase_id")
    views = events.filter("event_type <> 'purchase'").select("user_id", "ts", "event_id")
    return intervals.last_before(views, errors, ["user_id"], "ts", "purchase_id", "last_purchase").select("event_id", "last_purchase")


def argmin_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier of the same nation whose balance is nearest from below, for each customer."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"))
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"), "s_suppkey")
    return intervals.last_before(c, s, ["nation"], "bal", "s_suppkey", "supplier").select("c_custkey", "supplier")


def section_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    return folds.section_state(t, ["conv_id"], ["turn"], F.col("role") == "user", F.col("role") == "assistant").select("conv_id", "turn", "inside")


def continuation_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return folds.continuation(t, ["conv_id"], ["turn"], F.col("role") == "system", F.length("text") > 100).select("conv_id", "turn", "marked")


def margin_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").distinct()
    return folds.regular_runs(t, ["l_orderkey"], ["l_linenumber"], "l_linenumber", 3)


def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    sized = t.withColumn("height", F.floor("o_totalprice"))
    return folds.running_offset(sized, ["o_custkey"], ["o_orderkey"], "height", 12).select("o_orderkey", F.col("offset").cast("double").alias("offset"))


def budgeted_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = repeated.split_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return folds.budgeted_prefix(lines, ["doc_id"], ["line_no"], "line", 1500).select("doc_id", "line_no", "kept_text")


def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.even_sample(table(spark, sf_dir, "events", "event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


def chunk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = repeated.split_lines(table(spark, sf_dir, "documents", "doc_id", "text")).withColumn("size", F.length("line").cast("long"))
    return folds.pack(lines.select("doc_id", "line_no", "size"), ["doc_id"], ["line_no"], "size", 12, 2000).select("doc_id", "line_no", "chunk")


def outline_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand").withColumn("level", F.col("p_size") % 6 + 1)
    return folds.outline_parents(t, ["p_brand"], "p_partkey", "level", 6).select("p_partkey", "parent")


def column_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part", "p_brand", "p_size", "p_retailprice").withColumn("side", F.when(F.col("p_size") < 20, -1).when(F.col("p_size") > 30, 1).otherwise(0))
    return t.groupBy("p_brand", "side").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"), F.count("*").alias("n"))


def dense_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority").filter("o_orderpriority <> '1-URGENT'")
    return repeated.renumber(t, ["o_custkey"], ["o_orderkey"]).select("o_orderkey", "new_no")


_LINES = """l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) x, LATERAL unnest(range(1, len(parts) + 1)) t(i))"""
_RECTS = """a AS (SELECT l_orderkey AS k, l_partkey AS part, l_linenumber AS no, l_linenumber * 10.0 AS x0, 0.0 AS y0, l_linenumber * 10.0 + 8 AS x1, l_quantity AS y1 FROM lineitem),
b AS (SELECT o_orderkey AS k, 0.0 AS x0, 0.0 AS y0, CAST(o_custkey % 60 AS DOUBLE) AS x1, 40.0 AS y1 FROM orders)"""
_WITHIN = """greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) >= 0.8 * (a.x1 - a.x0) * (a.y1 - a.y0) AND (a.y1 - a.y0) > 0"""


def _median(cond: str) -> str:
    return f"""
WITH s AS (SELECT l_suppkey, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY v ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY l_suppkey) AS t FROM s)
SELECT l_suppkey, min(v) AS median FROM c WHERE c * 2 {cond} t GROUP BY l_suppkey"""


QUERIES = {f.__name__: f for f in (translatable_filter, weighted_size_stats, weighted_mode, upper_median, weighted_lower_median, weighted_upper_median, cluster_1d, interval_merge, spatial_contain_semi, spatial_contain_anti, nearest_above, argmin_neighbour, section_state, continuation_marks, margin_run_detection, running_offsets, budgeted_prefix, even_sample, chunk_packing, outline_parents, column_extents, dense_renumber)}
ORACLE_SQL = {
    "translatable_filter": f"""
WITH {_LINES}
SELECT doc_id, line_no, line FROM l
WHERE len(regexp_extract_all(line, '[#$%&*|]')) <= 5 AND length(line) >= 20 AND regexp_matches(line, '[\\p{{L}}\\p{{N}}]')""",
    "weighted_size_stats": """
SELECT l_orderkey, CAST(sum(coalesce(CAST(l_extendedprice AS DECIMAL(12,2)), 10.0) * CAST(l_quantity AS DECIMAL(6,0))) AS DOUBLE) / CAST(sum(l_quantity) AS DOUBLE) AS mean_size,
       coalesce(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 0) * 2 > sum(l_quantity) AS mostly_n
FROM lineitem GROUP BY l_orderkey""",
    "weighted_mode": """
WITH s AS (SELECT l_orderkey, l_returnflag, sum(l_quantity) AS w, min(l_linenumber * 10 + ascii(l_returnflag) % 10) AS f FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY w DESC, f) AS n FROM s)
SELECT l_orderkey, l_returnflag AS mode FROM r WHERE n = 1""",
    "upper_median": """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events)
SELECT event_type, value AS median FROM r WHERE n = c // 2 + 1""",
    "weighted_lower_median": _median(">="),
    "weighted_upper_median": _median(">"),
    "cluster_1d": """
WITH g AS (SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600000000 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM g)
SELECT user_id, cluster, count(*) AS n, min(event_id) AS first_event FROM c GROUP BY user_id, cluster""",
    "interval_merge": """
WITH s AS (SELECT l_orderkey, CAST(l_linenumber * 10.0 AS DOUBLE) AS a, CAST(l_linenumber * 10.0 + l_quantity AS DOUBLE) AS b FROM lineitem),
o AS (SELECT *, CASE WHEN a < max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM s),
i AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey ORDER BY a, b DESC ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT l_orderkey, min(a) AS start, max(b) AS "end", count(*) AS n FROM i GROUP BY l_orderkey, k""",
    "spatial_contain_semi": f"WITH {_RECTS} SELECT k, part, no FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.k = b.k AND {_WITHIN})",
    "spatial_contain_anti": f"WITH {_RECTS} SELECT k, part, no FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.k = b.k AND {_WITHIN})",
    "nearest_above": """
SELECT v.event_id, (SELECT max_by(p.event_id, (p.ts, p.event_id)) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = v.user_id AND p.ts <= v.ts) AS last_purchase
FROM events v WHERE v.event_type <> 'purchase'""",
    "argmin_neighbour": """
SELECT c.c_custkey, (SELECT max_by(s.s_suppkey, (s.s_acctbal, s.s_suppkey)) FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND s.s_acctbal <= c.c_acctbal) AS supplier FROM customer c""",
    "section_state": """
WITH e AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 0 END AS e FROM conversations)
SELECT conv_id, turn, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 0) = 1 AS inside FROM e""",
    "continuation_marks": """
WITH e AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 1 WHEN length(text) <= 100 THEN 0 END AS e FROM conversations)
SELECT conv_id, turn, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 0) = 1 AS marked FROM e""",
    "margin_run_detection": """
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
g AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM d)
SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n FROM g GROUP BY l_orderkey, k HAVING count(*) >= 3""",
    "running_offsets": """
SELECT o_orderkey, CAST(coalesce(sum(floor(o_totalprice) + 12) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS "offset" FROM orders""",
    "budgeted_prefix": f"""
WITH {_LINES},
b AS (SELECT *, coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT doc_id, line_no, CASE WHEN length(line) <= 1498 - before THEN line ELSE substr(line, 1, CAST(1498 - before AS BIGINT)) END AS kept_text
FROM b WHERE length(line) <= 1498 - before OR 1498 - before >= 120""",
    "even_sample": """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
p AS (SELECT DISTINCT u.user_id, CAST(round_even(i * (n - 1) / 59.0, 0) AS BIGINT) AS r FROM (SELECT DISTINCT user_id, n FROM r WHERE n > 60) u, range(60) t(i))
SELECT user_id, event_id FROM r WHERE n <= 60 UNION ALL SELECT r.user_id, r.event_id FROM r JOIN p USING (user_id, r)""",
    "chunk_packing": f"""
WITH RECURSIVE {_LINES},
z AS (SELECT doc_id, line_no, length(line) AS s FROM l),
w(doc_id, line_no, n, t, chunk) AS (
  SELECT doc_id, line_no, 1, s, 0 FROM z WHERE line_no = 0
  UNION ALL
  SELECT z.doc_id, z.line_no, CASE WHEN w.n >= 12 OR w.t + z.s > 2000 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 12 OR w.t + z.s > 2000 THEN z.s ELSE w.t + z.s END,
         CASE WHEN w.n >= 12 OR w.t + z.s > 2000 THEN w.chunk + 1 ELSE w.chunk END
  FROM w JOIN z ON z.doc_id = w.doc_id AND z.line_no = w.line_no + 1)
SELECT doc_id, line_no, chunk FROM w""",
    "outline_parents": """
WITH p AS (SELECT p_partkey, p_brand, p_size % 6 + 1 AS level FROM part)
SELECT c.p_partkey, (SELECT max(q.p_partkey) FROM p q WHERE q.p_brand = c.p_brand AND q.p_partkey < c.p_partkey AND q.level < c.level) AS parent FROM p c""",
    "column_extents": """
SELECT p_brand, CASE WHEN p_size < 20 THEN -1 WHEN p_size > 30 THEN 1 ELSE 0 END AS side, min(p_retailprice) AS lo, max(p_retailprice) AS hi, count(*) AS n FROM part GROUP BY ALL""",
    "dense_renumber": """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS new_no FROM orders WHERE o_orderpriority <> '1-URGENT'""",
}
