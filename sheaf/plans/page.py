"""Queries on pages. A page is an order, its lines are the order's items laid out by their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import page as P
from ..operators import rules as R
from ..sources.tables import table

WIDTH, HEIGHT = 600.0, 800.0
TEXTS = ["the long exam-", "ple goes on and", "Then it ends here.", "%s", "%s.5", "N/A", "[%s] Lee, A study", "arXiv %s", "References", "Abstract of %s", "Table 1: all of it", "yes", "and more words of the same kind follow here now", "Lead in:", "Odd"]


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    t = t.withColumn("n", F.row_number().over(w))
    p, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity").cast("int")
    text = F.replace(F.element_at(F.array(*map(F.lit, TEXTS)), (p % len(TEXTS) + 1).cast("int")), F.lit("%s"), s.cast("string"))
    x0 = F.lit(50.0) + (p % 4) * 6 + F.when(q % 7 == 0, 280.0).otherwise(0.0)
    y0 = F.lit(40.0) + F.col("n") * 12 + s % 3
    return t.select(
        F.col("l_orderkey").cast("long").alias("page"), "n", text.alias("text"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 60 + (s % 6) * 40).cast("double").alias("x1"), (y0 + 10 + p % 2).cast("double").alias("y1"),
        (F.lit(9.0) + (p % 3) * 0.25).cast("double").alias("size"), (F.col("l_returnflag") == "A").alias("bold"), (q % 11 == 0).alias("italic"), (q % 2).cast("int").alias("color"), (q % 13 == 0).alias("math"), (q % 17 == 0).alias("skip"),
        (q % 29 == 0).alias("whole"), (q % 31 == 0).alias("rotated"), F.when(q % 19 == 0, 1).cast("int").alias("table"), F.lit(None).cast("int").alias("algorithm"), (F.col("l_linenumber") / 3).cast("int").alias("source"),
    )


_TEXT = "replace([" + ", ".join(f"'{t}'" for t in TEXTS) + f"][l_partkey % {len(TEXTS)} + 1], '%s', l_suppkey::VARCHAR)"
LINES = f"""lines AS MATERIALIZED (
  SELECT page, n, text, x0, y0, x0 + 60 + (s % 6) * 40 AS x1, y0 + 10 + p % 2 AS y1, 9.0::DOUBLE + (p % 3) * 0.25::DOUBLE AS size, flag = 'A' AS bold, q % 11 = 0 AS italic, q % 2 AS color, q % 13 = 0 AS math, q % 17 = 0 AS skip,
    q % 29 = 0 AS whole, q % 31 = 0 AS rotated, CASE WHEN q % 19 = 0 THEN 1 END AS tab, ln // 3 AS source
  FROM (SELECT *, (50 + (p % 4) * 6 + CASE WHEN q % 7 = 0 THEN 280 ELSE 0 END)::DOUBLE AS x0, (40 + n * 12 + s % 3)::DOUBLE AS y0 FROM (
    SELECT l_orderkey AS page, l_partkey AS p, l_suppkey AS s, floor(l_quantity)::INTEGER AS q, l_returnflag AS flag, l_linenumber AS ln, {_TEXT} AS text,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)::INTEGER AS n FROM lineitem)))"""


def paragraphs_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.paragraphs(page_lines(spark, sf_dir), ["n"])


def reference_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.reference_entries(page_lines(spark, sf_dir))


def visual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.visual_rows(page_lines(spark, sf_dir))


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.union_box(page_lines(spark, sf_dir), "page")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a supplier as small cells: a page for each supplier, in columns of 60 and rows of 14."""
    t = table(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    t = t.withColumn("n", F.row_number().over(w))
    block = (F.col("n") / 40).cast("int") % 3  # tables, columns too far apart, and words
    x0 = (F.lit(40) + (F.col("l_partkey") % 5) * F.when(block == 1, 200).otherwise(60)).cast("double")
    y0 = (F.lit(40) + (F.col("n") / 4).cast("int") * 14 + (F.col("l_orderkey") % 2)).cast("double")
    y0 = y0 + F.when(F.col("n") % 40 < 8, 60.0).otherwise(0.0) + (F.col("n") / 40).cast("int") * 90
    text = F.when((F.col("l_quantity").cast("int") % 4 == 0) | (block == 2), "name").when(F.col("l_partkey") % 50 == 0, "Table 1: x").otherwise(F.col("l_partkey").cast("string"))
    return t.select(F.col("l_suppkey").cast("long").alias("page"), "n", x0.alias("x0"), y0.alias("y0"), (x0 + 30).alias("x1"), (y0 + 9).alias("y1"), text.alias("text"), F.lit(False).alias("skip"), (F.col("l_quantity").cast("int") % 9 == 0).alias("math"))


def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table_cells(_cells(spark, sf_dir), 500.0)


def _rects(spark: SparkSession, sf_dir: str, status: str, name: str) -> DataFrame:
    """A box for each order of a customer, a page for each customer."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").filter(F.col("o_orderstatus") == status)
    price = F.floor("o_totalprice").cast("long")
    x0, y0 = (price % 200).cast("double"), ((price / 7).cast("long") % 300).cast("double")
    return o.select(F.col("o_custkey").cast("long").alias("page"), F.col("o_orderkey").cast("long").alias(name), x0.alias("x0"), y0.alias("y0"), (x0 + 80 + price % 150).cast("double").alias("x1"), (y0 + 30 + price % 60).cast("double").alias("y1"))


def caption_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.near_captions(_rects(spark, sf_dir, "O", "t"), _rects(spark, sf_dir, "F", "c"))


def image_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _rects(spark, sf_dir, "O", "n").withColumn("text", F.when(F.col("n") % 3 == 0, "one two three four five six").otherwise("a label")).withColumn("math", F.col("n") % 11 == 0).withColumn("skip", F.lit(False))
    return P.image_text(blocks, _rects(spark, sf_dir, "F", "r"))


def chart_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphics = _rects(spark, sf_dir, "O", "g").withColumn("y0", F.lit(0.0)).withColumn("y1", F.lit(400.0)).withColumn("x0", F.col("x0") + 150).withColumn("x1", F.col("x1") + 150)
    lines = _rects(spark, sf_dir, "F", "n").unionByName(_rects(spark, sf_dir, "P", "n")).withColumn("x1", F.col("x0") + 100 + F.col("n") % 60).withColumn("text", F.lit("label")).withColumn("size", (F.col("n") % 14).cast("double"))
    return P.chart_labels(graphics, lines, 600.0)


def background_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    def snapped(status: str, name: str) -> DataFrame:
        r = _rects(spark, sf_dir, status, name)
        return r.withColumn("x0", F.floor(F.col("x0") / 100) * 2.0).withColumn("y0", F.floor(F.col("y0") / 20) * 8.0).withColumn("x1", F.lit(150.0) + F.floor(F.col("x1") / 100)).withColumn("y1", F.lit(200.0))

    fills = snapped("O", "f").unionByName(snapped("F", "f")).withColumn("shade", F.when(F.col("f") % 3 == 0, 0.95).otherwise(0.5))
    lines = snapped("P", "n").withColumn("x0", F.lit(20.0)).withColumn("x1", F.lit(120.0)).withColumn("y0", F.lit(150.0)).withColumn("y1", F.lit(160.0)).withColumn("text", F.when(F.col("n") % 2 == 0, "these are seven or more words of prose").otherwise("few"))
    return P.background_frames(fills, lines, 300.0)


def interval_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _rects(spark, sf_dir, "O", "n")
    b = a.select("page", F.col("n").alias("m"), *[F.col(k).alias("b" + k) for k in P.BOX])
    c = F.col
    return a.join(b, "page").filter("n < m").select("n", "m", P.gap(c("x0"), c("x1"), c("bx0"), c("bx1")).alias("gap_x"), P.gap(c("y0"), c("y1"), c("by0"), c("by1")).alias("gap_y"), P.side(c("x0"), c("x1"), 400.0).alias("side"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a page in two columns, some across."""
    l = page_lines(spark, sf_dir)
    across = F.col("n") <= F.col("page") % 3
    right = F.col("n") % 2 == 0
    x0 = F.when(across, 100.0).when(right, 310.0).otherwise(60.0) + F.col("x0") % 5
    x1 = F.when(across, 480.0).when(right, 540.0).otherwise(270.0) + F.when(F.col("page") % 5 == 0, 60.0).otherwise(0.0)
    return l.withColumn("x0", x0).withColumn("x1", x1)


def column_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.column_layout(_blocks(spark, sf_dir), WIDTH, HEIGHT)


def cover_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cover_header(_blocks(spark, sf_dir), WIDTH, HEIGHT)


def equation_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir)
    return P.equation_columns(b.filter("math"), P.column_layout(b, WIDTH, HEIGHT))


def reading_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.reading_anchor(_blocks(spark, sf_dir), F.lit(WIDTH / 2), 72 + F.col("page") % 100)


def repeated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a customer's orders that aren't repeated: by rounded box and text, in 60 % of the pages and three at least."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    b = o.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("page"), F.explode(F.array(F.struct(F.lit(10.0).alias("x0"), F.col("o_orderstatus").alias("text")), F.struct((F.col("o_orderkey") % 2 + 20).cast("double").alias("x0"), F.lit("Journal").alias("text")), F.struct(F.lit(30.0).alias("x0"), F.col("o_orderpriority").alias("text")), F.struct(F.lit(40.0).alias("x0"), F.col("o_orderkey").cast("string").alias("text")))).alias("b")).select("doc", "page", "b.*")
    pages = b.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    seen = b.groupBy("doc", "x0", "text").agg(F.countDistinct("page").alias("seen")).join(pages, "doc").filter(F.col("seen") >= F.greatest(F.lit(3), F.floor(F.col("pages") * 0.6)))
    kept = b.join(seen, ["doc", "x0", "text"], "left_anti").filter(~F.col("text").rlike(r"^[\s\d\-–—·°.,;:()\[\]{}<>+=*/|_~^%&$#@!?'\"\\]+$"))
    return kept.withColumn("id", (F.row_number().over(Window.partitionBy("doc", "page").orderBy("x0", "text")) - 1).cast("long"))


_CELLS = """cells AS MATERIALIZED (
  SELECT page, n, x0, y0, x0 + 30 AS x1, y0 + 9 AS y1, text FROM (
    SELECT page, n, (40 + p % 5 * CASE WHEN n // 40 % 3 = 1 THEN 200 ELSE 60 END)::DOUBLE AS x0, (40 + n // 4 * 14 + o % 2 + CASE WHEN n % 40 < 8 THEN 60 ELSE 0 END + n // 40 * 90)::DOUBLE AS y0,
      CASE WHEN q % 4 = 0 OR n // 40 % 3 = 2 THEN 'name' WHEN p % 50 = 0 THEN 'Table 1: x' ELSE p::VARCHAR END AS text, q % 9 = 0 AS math FROM (
      SELECT l_suppkey AS page, l_orderkey AS o, l_partkey AS p, floor(l_quantity)::INTEGER AS q,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)::INTEGER AS n FROM lineitem))
  WHERE NOT math AND text <> 'Table 1: x')"""


def _rect_sql(status: str, name: str) -> str:
    return f"SELECT o_custkey AS page, o_orderkey AS {name}, x0, y0, (x0 + 80 + price % 150)::DOUBLE AS x1, (y0 + 30 + price % 60)::DOUBLE AS y1 FROM (SELECT *, (price % 200)::DOUBLE AS x0, (price // 7 % 300)::DOUBLE AS y0 FROM (SELECT *, floor(o_totalprice)::BIGINT AS price FROM orders WHERE o_orderstatus = '{status}'))"


def _snap_sql(status: str, name: str) -> str:
    return f"SELECT page, {name}, floor(x0 / 100) * 2.0 AS x0, floor(y0 / 20) * 8.0 AS y0, 150.0 + floor(x1 / 100) AS x1, 200.0 AS y1 FROM ({_rect_sql(status, name)})"


_BLOCKS = f"""{LINES}, blocks AS MATERIALIZED (
  SELECT * REPLACE (CASE WHEN n <= page % 3 THEN 100.0 WHEN n % 2 = 0 THEN 310.0 ELSE 60.0 END::DOUBLE + x0 % 5 AS x0, (CASE WHEN n <= page % 3 THEN 480.0 WHEN n % 2 = 0 THEN 540.0 ELSE 270.0 END + CASE WHEN page % 5 = 0 THEN 60 ELSE 0 END)::DOUBLE AS x1) FROM lines)"""
_COLUMNS = """body AS (SELECT *, CASE WHEN (x0 + x1) / 2 < 300 AND x1 <= 307.2 THEN 'l' WHEN (x0 + x1) / 2 >= 300 AND x0 >= 292.8 THEN 'r' ELSE 'o' END AS side FROM blocks WHERE NOT math AND NOT skip),
own AS (SELECT page, side, min(x0) AS x0, max(x1) AS x1, min(y0) AS top, arg_max(y1, y0 * 1000 + n) AS bottom, count(*) AS blocks, count(*) >= 2 OR bool_or(y1 - y0 >= 96 OR len(text) >= 160) AS heavy FROM body GROUP BY page, side),
two AS (SELECT l.page FROM own l JOIN own r ON l.page = r.page AND l.side = 'l' AND r.side = 'r' LEFT JOIN (SELECT page, max(y1) AS ob, bool_and(x0 < 300 AND x1 > 300) AS crosses FROM body WHERE side = 'o' GROUP BY page) o ON o.page = l.page
  WHERE l.heavy AND r.heavy AND r.x0 > l.x1 + 4 AND (o.page IS NULL OR (o.crosses AND o.ob <= least(l.top, r.top) - 1))),
cols AS MATERIALIZED (
  SELECT page, CASE WHEN side = 'l' THEN 0 ELSE 1 END AS "column", x0, x1, top, bottom, blocks FROM own WHERE side <> 'o' AND page IN (SELECT page FROM two)
  UNION ALL SELECT page, 0, min(x0), max(x1), min(y0), arg_max(y1, y0 * 1000 + n), count(*) FROM body WHERE page NOT IN (SELECT page FROM two) GROUP BY page)"""
_MARK = f"(regexp_matches(text, '{R.CAPTIONS['citation']}') OR regexp_matches(text, '{R.CAPTIONS['references']}') OR (len(text) < 60 AND regexp_matches(text, '{R.CAPTIONS['reference_mark']}')))"

QUERIES = {f.__name__: f for f in (paragraphs_geometry, reference_entries, visual_rows, page_boxes, table_grid, caption_band_join, image_text, chart_labels, background_frames, interval_relations, column_detection, cover_headers, equation_columns, reading_anchors, repeated_blocks)}
ORACLE_SQL = {
    "paragraphs_geometry": f"""WITH RECURSIVE {LINES}, f AS (
  SELECT page, n, 0 AS no, 1 AS lines, 0.0::DOUBLE AS indent, x0 AS first, bold, italic, color, math, skip, whole, rotated, tab, source, size, text, x0, y0, x1, y1 FROM lines WHERE n = 1
  UNION ALL
  SELECT page, n, no + CASE WHEN j THEN 0 ELSE 1 END, CASE WHEN j THEN lines + 1 ELSE 1 END, CASE WHEN NOT j THEN 0 WHEN lines = 1 THEN greatest(0, first - b.x0) ELSE indent END, CASE WHEN j THEN first ELSE b.x0 END,
    CASE WHEN j THEN bold::INTEGER * len(text) + b.bold::INTEGER * len(b.text) > (len(text) + len(b.text)) * 0.5 ELSE b.bold END, CASE WHEN j THEN italic ELSE b.italic END, CASE WHEN j THEN color ELSE b.color END, b.math, b.skip, b.whole, b.rotated, b.tab, b.source, CASE WHEN j THEN size ELSE b.size END,
    CASE WHEN NOT j THEN b.text WHEN regexp_matches(text, '[A-Za-z]{{2}}-$') AND regexp_matches(ltrim(b.text), '^[a-z]') THEN left(text, len(text) - 1) || ltrim(b.text) ELSE text || ' ' || b.text END,
    CASE WHEN j THEN least(x0, b.x0) ELSE b.x0 END, CASE WHEN j THEN least(y0, b.y0) ELSE b.y0 END, CASE WHEN j THEN greatest(x1, b.x1) ELSE b.x1 END, CASE WHEN j THEN greatest(y1, b.y1) ELSE b.y1 END
  FROM (SELECT page, b.n, no, lines, indent, first, f.bold, f.italic, f.color, f.size, f.text, f.x0, f.y0, f.x1, f.y1, b,
      f.tab IS NOT DISTINCT FROM b.tab AND f.math = b.math AND f.skip = b.skip AND NOT (f.whole OR b.whole OR f.rotated OR b.rotated)
      AND (b.y0 - f.y1 >= 0 OR ((b.y0 + b.y1) / 2 - (f.y0 + f.y1) / 2 > least(f.size, b.size) * 0.55 AND b.y0 - f.y1 >= -least(f.size, b.size) * 0.55))
      AND b.y0 - f.y1 <= greatest(4.0, least(f.size, b.size) * 0.9) AND abs(b.x0 - f.x0) <= greatest(12.0, least(f.size, b.size) * 1.25)
      AND abs(b.size - f.size) <= CASE WHEN same AND NOT regexp_matches(f.text, '[.!?]\\s*$') THEN least(f.size, b.size) * 0.2 ELSE 0.6 END
      AND ((f.bold = b.bold AND f.italic = b.italic) OR (same AND regexp_matches(f.text, '[A-Za-z]{{2}}-$') AND regexp_matches(b.text, '^[a-z]'))
        OR (same AND f.tab IS NULL AND (len(regexp_extract_all(f.text, '[A-Za-z㐀-鿿]+')) >= 8 OR regexp_matches(f.text, '[.:;：；。]\\s*$'))))
      AND NOT (f.color <> b.color AND (f.math OR f.skip OR b.math OR b.skip)) AS j
    FROM (SELECT f, b, f.source = b.source AND NOT (f.math OR f.skip OR b.math OR b.skip) AS same, f.page, f.no, f.lines, f.indent, f.first FROM f JOIN lines b ON b.page = f.page AND b.n = f.n + 1)))
SELECT page, no, max(lines)::INTEGER AS lines, arg_max(indent, n) AS indent, arg_max(bold, n) AS bold, arg_max(text, n) AS text, arg_max(x0, n) AS x0, arg_max(y0, n) AS y0, arg_max(x1, n) AS x1, arg_max(y1, n) AS y1 FROM f GROUP BY page, no""",
    "reference_entries": f"""WITH RECURSIVE {LINES}, m AS MATERIALIZED (SELECT *, {_MARK} AS ref FROM lines), f AS (
  SELECT page, 0 AS n, NULL::DOUBLE AS edge, 0.0::DOUBLE AS bottom, false AS said FROM (SELECT DISTINCT page FROM m)
  UNION ALL
  SELECT page, n, CASE WHEN out_ THEN edge WHEN follow THEN edge WHEN ref THEN x0 END, CASE WHEN out_ THEN bottom WHEN follow OR ref THEN y1 ELSE bottom END, skip OR (NOT out_ AND (follow OR ref))
  FROM (SELECT m.page, m.n, m.x0, m.y1, m.ref, m.skip, f.edge, f.bottom, m.math OR m.skip AS out_, coalesce(m.x0 > f.edge + 3 AND m.y0 - f.bottom < 14, false) AS follow FROM f JOIN m ON m.page = f.page AND m.n = f.n + 1))
SELECT page, n, said AS skip FROM f WHERE n > 0""",
    "visual_rows": f"""WITH RECURSIVE {LINES}, f AS (
  SELECT page, n, 0 AS row, y1 AS base, size, x0 FROM lines WHERE n = 1
  UNION ALL
  SELECT page, n, row + CASE WHEN near THEN 0 ELSE 1 END, CASE WHEN near THEN base ELSE b.y1 END, CASE WHEN near THEN size ELSE b.size END, CASE WHEN near THEN x0 ELSE b.x0 END
  FROM (SELECT f.page, b.n, f.row, f.base, f.size, f.x0, b, abs(b.y1 - f.base) <= greatest(3.5, greatest(b.size, f.size) * 0.5) AND b.x0 >= f.x0 - 2 AS near FROM f JOIN lines b ON b.page = f.page AND b.n = f.n + 1))
SELECT page, n, row FROM f""",
    "page_boxes": f"WITH {LINES} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM lines GROUP BY page",
    "table_grid": f"""WITH RECURSIVE {_CELLS}, s AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY page ORDER BY x0) > 5 THEN 1 ELSE 0 END AS sx, CASE WHEN y0 - lag(y0) OVER (PARTITION BY page ORDER BY y0) > 5 THEN 1 ELSE 0 END AS sy FROM cells),
g AS MATERIALIZED (SELECT *, sum(sx) OVER (PARTITION BY page ORDER BY x0) AS c, sum(sy) OVER (PARTITION BY page ORDER BY y0) AS r FROM s),
e AS MATERIALIZED (
  SELECT page, n AS a, lead(n) OVER w AS b, lead(x0) OVER w - x1 <= 120 AS ok FROM g WINDOW w AS (PARTITION BY page, r ORDER BY x0, n)
  UNION ALL SELECT page, n, lead(n) OVER w, lead(y0) OVER w - y1 <= 30 FROM g WINDOW w AS (PARTITION BY page, c ORDER BY y0, n)),
way AS MATERIALIZED (SELECT page, a, b FROM e WHERE ok UNION ALL SELECT page, b, a FROM e WHERE ok),
reach AS (SELECT page, n, n AS root FROM g UNION SELECT w.page, w.b, r.root FROM reach r JOIN way w ON w.page = r.page AND w.a = r.n WHERE r.root < w.b),
comp AS MATERIALIZED (SELECT page, n, min(root) AS k FROM reach GROUP BY page, n),
tops AS (SELECT page, k, y0, y0 - lag(y0) OVER (PARTITION BY page, k ORDER BY y0) AS gap FROM (SELECT DISTINCT page, k, y0 FROM g JOIN comp USING (page, n))),
med AS (SELECT page, k, list_sort(list(gap))[len(list(gap)) // 2 + 1] AS m FROM tops WHERE gap IS NOT NULL GROUP BY page, k),
ok AS (SELECT page, k FROM g JOIN comp USING (page, n) LEFT JOIN med USING (page, k) GROUP BY page, k, m HAVING count(*) >= 6 AND count(*) FILTER (regexp_matches(text, '{P.DATA_CELL}')) >= 3 AND count(DISTINCT c) BETWEEN 2 AND 16
  AND count(DISTINCT r) >= 3 AND count(*) >= 0.5 * count(DISTINCT c) * count(DISTINCT r) AND coalesce(m, 0) <= 30)
SELECT page, n FROM comp SEMI JOIN ok USING (page, k)""",
    "caption_band_join": f"""SELECT t.page, t.t, c.c FROM ({_rect_sql('O', 't')}) t JOIN ({_rect_sql('F', 'c')}) c ON t.page = c.page
WHERE least(t.x1, c.x1) - greatest(t.x0, c.x0) >= 0.6 * least(t.x1 - t.x0, c.x1 - c.x0) AND (t.y0 - c.y1 BETWEEN -8 AND 65 OR c.y0 - t.y1 BETWEEN -8 AND 32)""",
    "image_text": f"""SELECT DISTINCT b.page, b.n FROM ({_rect_sql('O', 'n')}) b JOIN ({_rect_sql('F', 'r')}) r ON r.page = b.page WHERE b.n % 11 <> 0 AND (
  greatest(0, least(b.x1, r.x1) - greatest(b.x0, r.x0)) * greatest(0, least(b.y1, r.y1) - greatest(b.y0, r.y0)) >= 0.8 * (b.x1 - b.x0) * (b.y1 - b.y0)
  OR (b.n % 3 <> 0 AND (b.x0 + b.x1) / 2 BETWEEN r.x0 AND r.x1 AND (b.y0 + b.y1) / 2 BETWEEN r.y0 AND r.y1))""",
    "chart_labels": f"""WITH g AS (SELECT page, g, x0 + 150 AS x0, 0.0::DOUBLE AS y0, x1 + 150 AS x1, 400.0::DOUBLE AS y1 FROM ({_rect_sql('O', 'g')})),
l AS (SELECT * REPLACE (x0 + 100 + n % 60 AS x1) FROM ({_rect_sql('F', 'n')} UNION ALL {_rect_sql('P', 'n')}) WHERE n % 14 <= 12),
j AS (SELECT g.page, g.g, min(l.x0) AS x0, min(l.y0) AS y0, max(l.x1) AS x1, max(l.y1) AS y1 FROM g JOIN l ON g.page = l.page AND l.y0 >= g.y0 AND l.y1 <= g.y1 AND g.x0 - l.x1 BETWEEN 0 AND 14 AND l.x1 - l.x0 < 240 GROUP BY g.page, g.g HAVING count(*) >= 3)
SELECT g.page, g.g, least(g.x0, coalesce(j.x0, g.x0)) AS x0, least(g.y0, coalesce(j.y0, g.y0)) AS y0, greatest(g.x1, coalesce(j.x1, g.x1)) AS x1, greatest(g.y1, coalesce(j.y1, g.y1)) AS y1 FROM g LEFT JOIN j ON g.page = j.page AND g.g = j.g""",
    "background_frames": f"""WITH f AS (SELECT *, CASE WHEN f % 3 = 0 THEN 0.95 ELSE 0.5 END AS shade FROM ({_snap_sql('O', 'f')} UNION ALL {_snap_sql('F', 'f')}) WHERE x1 - x0 >= 105 AND y1 - y0 >= 40),
p AS (SELECT DISTINCT page FROM ({_rect_sql('P', 'n')}) WHERE n % 2 = 0),
k AS (SELECT a.page, a.f, b.f AS frame FROM f a JOIN f b ON a.page = b.page AND a.f <> b.f AND a.shade <> b.shade AND abs(a.x0 - b.x0) <= 3 AND abs(a.x1 - b.x1) <= 3 AND abs(a.y1 - b.y1) <= 3 AND a.y0 - b.y0 BETWEEN 0 AND 26
  WHERE a.shade >= 0.88 AND a.page IN (SELECT page FROM p) AND a.x0 <= 20 AND a.y0 <= 150 AND a.x1 >= 120 AND 100 >= 0.55 * (a.x1 - a.x0))
SELECT page, f FROM k UNION SELECT page, frame FROM k""",
    "interval_relations": f"""SELECT a.n, b.n AS m, greatest(0, greatest(a.x0, b.x0) - least(a.x1, b.x1)) AS gap_x, greatest(0, greatest(a.y0, b.y0) - least(a.y1, b.y1)) AS gap_y, CASE WHEN a.x1 <= 203 THEN -1 WHEN a.x0 >= 197 THEN 1 ELSE 0 END AS side
FROM ({_rect_sql('O', 'n')}) a JOIN ({_rect_sql('O', 'n')}) b ON a.page = b.page AND a.n < b.n""",
    "column_detection": f"WITH {_BLOCKS}, {_COLUMNS} SELECT * FROM cols",
    "cover_headers": f"""WITH {_BLOCKS}, b AS (SELECT * FROM blocks WHERE NOT math AND NOT skip), h AS (SELECT page, arg_min(y0, n) AS cutoff FROM b WHERE regexp_matches(text, '(?i)^\\s*(abstract|summary)\\b') GROUP BY page)
SELECT b.page, b.n FROM b LEFT JOIN h ON h.page = b.page WHERE y1 < coalesce(cutoff, 208) - 1 AND x0 < 300 AND x1 > 300 AND abs((x0 + x1) / 2 - 300) <= 60""",
    "equation_columns": f"""WITH {_BLOCKS}, {_COLUMNS}
SELECT page, n, "column" FROM (SELECT b.page, b.n, c."column", row_number() OVER (PARTITION BY b.page, b.n ORDER BY least(b.x1, c.x1) - greatest(b.x0, c.x0) DESC, c."column") AS k FROM blocks b JOIN cols c ON c.page = b.page WHERE b.math) WHERE k = 1""",
    "reading_anchors": f"""WITH {_BLOCKS}, d AS (SELECT page, n, (guide - y0) / greatest(1.0, y1 - y0) AS "offset", greatest(0, y0 - guide, guide - y1) + greatest(0, x0 - 300, 300 - x1) * 0.12::DOUBLE AS d FROM (SELECT *, 72 + page % 100 AS guide FROM blocks))
SELECT page, n, "offset" FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY d, n) AS k FROM d) WHERE k = 1""",
    "repeated_blocks": """WITH b AS MATERIALIZED (
  SELECT o_custkey AS doc, o_orderkey AS page, 10.0 AS x0, o_orderstatus AS text FROM orders UNION ALL SELECT o_custkey, o_orderkey, o_orderkey % 2 + 20, 'Journal' FROM orders
  UNION ALL SELECT o_custkey, o_orderkey, 30, o_orderpriority FROM orders UNION ALL SELECT o_custkey, o_orderkey, 40, o_orderkey::VARCHAR FROM orders),
p AS (SELECT doc, count(DISTINCT page) AS pages FROM b GROUP BY doc),
s AS (SELECT b.doc, x0, text FROM b JOIN p ON p.doc = b.doc GROUP BY b.doc, x0, text, pages HAVING count(DISTINCT page) >= greatest(3, floor(pages * 0.6)))
SELECT doc, page, x0::DOUBLE AS x0, text, row_number() OVER (PARTITION BY doc, page ORDER BY x0, text) - 1 AS id FROM b ANTI JOIN s USING (doc, x0, text)
WHERE NOT regexp_full_match(text, '[\\s\\d\\-–—·°.,;:()\\[\\]{}<>+=*/|_~^%&$#@!?''"\\\\]+')""",
}
