"""Queries on exclusions, drawings, titles, segments, bursts and windows of pages."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import rules as R
from ..operators.components import components
from ..operators.grouped import fold_rows
from ..sources.tables import table
from . import page as P
from .rules import _first, _found, _has, _second, _sub, filled, filled_sql

#: Decimal numbers, fonts of code, marks of code.
DECIMAL, CODE_FONT = r"[−-]?\d+\.\d+", r"(?i)mono|nimbusmon|typewriter|inconsolata|courier|(?:cm|sf)tt"
CODE = r"""^[\d\s]*[{}\[\]]|^[\d\s]*["'][\w.-]+["']\s*:|^\s*\w+(?:\[[^]]+\])?\s*=|\b(?:def|class|import|return|let)\s+|=>|:=|\b\w+\.\w+\b.*[+*]|\b\w+\(\?\w|^(?:[a-z][\w-]*,\s*){5,}"""
BLOCKS = [("1.5 2.25 -3.0 4.5 5.75 6.125 ab", "Times"), ("1.5 2.25 the 4.5 5.75 6.125 7.5", "Times"), ("1.5 2.5 %n 3.5", "Times"), ("{ \"a\": 1 }", "Courier"), ("{ a }", "Times"), ("import %n", "SFTT1000"), ("%n and words", "DejaVuSansMono"), ("x[1] = %k", "Inconsolata"), ("a.b + c %n", "CMTT10"), ("\"key-%k\": 5", "LiberationMono"), ("(a) => b", "NimbusMonL"), ("one, two, three, four, five, six", "Typewriter"), ("y := %k", "Arial")]
AUTHORS = [("Anna Lee Bo Chen", True), ("Anna Lee, Bo Chen and Cy Dee [1] 2", True), ("Anna of %n", False), ("University of %N", False), ("Lee", False), ("Anna Lee†", True), ("anna lee *", True), ("Abstract", False), ("A Study: of %N", False), ("Cy Dee a@b.org", True)]


def excluded_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of numbers, and of code in a code font, that are set aside."""
    t = filled(spark, sf_dir, text=_first(BLOCKS), font=_second(BLOCKS))
    text = F.col("text")
    numbers, words = F.size(R.found(text, r"(?<!\w)" + DECIMAL + r"(?!\w)")), F.size(R.found(text, "[A-Za-z]{2,}"))
    return t.select("id", ((numbers >= 6) & (numbers >= words * 2) & ~text.rlike(R.COMMON_BY_FORMULA)).alias("numeric"), (F.col("font").rlike(CODE_FONT) & text.rlike(CODE)).alias("code"))


def author_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines above the abstract that name authors: capitalised words but for "and", or names with a mark."""
    t = filled(spark, sf_dir, text=_first(AUTHORS))
    names = F.regexp_replace("text", r"\S+@\S+|\[[\d\s−–-]+\]|\d+|[*∗†‡,;]", " ")
    words = R.found(names, r"[\p{L}][\p{L}\p{Nd}_.'’-]*")
    line = F.size(words).between(2, 80) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}") | (w == "and")) & ~names.rlike(r"[:?!]|\b(?:University|Institute|School|Department|Laboratory|Abstract)\b")
    marked = F.trim("text").rlike(r"^\p{L}[\p{L}\p{Nd}_.'’-]*(?: +\p{L}[\p{L}\p{Nd}_.'’-]*){1,5} *[*∗†‡]+$")
    return t.select("id", (line | marked).alias("author"))


def drawing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings of a page gathered as they come: each joins the groups that it comes within 4 of, which become one."""
    r = P._rects(spark, sf_dir, "O", "n")

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        held: list[list] = []
        for d in rows:
            box = [d["x0"], d["y0"], d["x1"], d["y1"]]
            near = [g for g in held if g[0] - 4 < box[2] and box[0] < g[2] + 4 and g[1] - 4 < box[3] and box[1] < g[3] + 4]
            count = 1 + sum(g[4] for g in near)
            for g in near:
                box = [min(box[0], g[0]), min(box[1], g[1]), max(box[2], g[2]), max(box[3], g[3])]
            if near:
                near[0][:] = [*box, count]
                gone = [id(g) for g in near[1:]]
                held = [g for g in held if id(g) not in gone]
            else:
                held.append([*box, 1])
            page = d["page"]
        for k, g in enumerate(held):
            yield {"page": page, "g": k, "x0": g[0], "y0": g[1], "x1": g[2], "y1": g[3], "drawings": g[4]}

    return fold_rows(r, ["page"], ["n"], step, "page long, g int, x0 double, y0 double, x1 double, y1 double, drawings int")


def components_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page that are within 10 of each other in both directions belong together."""
    r = P._rects(spark, sf_dir, "O", "n")
    o = r.select("page", F.col("n").alias("m"), *[F.col(k).alias("o" + k) for k in ("x0", "y0", "x1", "y1")])
    near = (F.greatest("x0", "ox0") - F.least("x1", "ox1") <= 10) & (F.greatest("y0", "oy0") - F.least("y1", "oy1") <= 10)
    edges = r.join(o, "page").filter((F.col("n") < F.col("m")) & near).select(F.col("n").alias("a"), F.col("m").alias("b"))
    return components(r.select("n"), edges, "n")


def matched_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of search matches in each line of a document that they meet."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    hits = tx.literal_matches(d, "doc_id", "text", "tion").withColumn("end", F.col("at") + 4)
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "part")).select("doc_id", "line", F.length("part").alias("n"))
    w = Window.partitionBy("doc_id").orderBy("line")
    lines = lines.withColumn("to", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("line")).withColumn("from", F.col("to") - F.col("n"))
    cut = hits.join(lines, "doc_id").filter(F.greatest("from", "at") < F.least("to", "end"))
    return cut.select("doc_id", "at", "line", (F.greatest("from", "at") - F.col("from")).alias("start"), (F.least("to", "end") - F.col("from")).alias("stop"))


def debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last change of each burst: changes of a user less than 400 seconds apart are saved once."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.lead(F.col("ts").cast("timestamp")).over(w)) - F.unix_micros(F.col("ts").cast("timestamp"))
    return e.withColumn("gap", gap).filter(F.col("gap").isNull() | (F.col("gap") >= 400_000_000)).select("user_id", "event_id", "event_type")


def prefetch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to fetch around the current one, the next before the previous, without those that are there, failed or under way."""
    c = table(spark, sf_dir, "customer", "c_custkey")
    k = F.col("c_custkey")
    at = c.select(k.alias("doc"), (k % 20).alias("page"), F.when(k % 3 == 0, 3).when(k % 3 == 1, 1).otherwise(0).alias("radius"))
    around = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.col("radius")), lambda o: F.array(F.col("page") + o, F.col("page") - o))))
    q = at.select("doc", F.posexplode(around).alias("rank", "want")).filter(F.col("want").between(0, 19) & ((F.col("doc") + F.col("want")) % 5 != 0))
    return q.select("doc", F.col("want").alias("page"), (F.row_number().over(Window.partitionBy("doc").orderBy("rank")) - 1).cast("long").alias("place"))


def visible_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots that a view draws (within 1.2 views of it), and those it lets go (a view further)."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    h = F.floor("o_totalprice").cast("long") % 900 + 100
    s = o.withColumn("h", h).withColumn("bottom", F.sum("h").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    top, view, at = F.col("bottom") - F.col("h"), 600, (F.col("o_custkey") % 7) * 500
    low, high = at - 720, at + view + 720
    state = F.when((F.col("bottom") >= low) & (top <= high), "draw").when((top > high + view) | (F.col("bottom") < low - view), "release").otherwise("keep")
    return s.select("o_orderkey", state.alias("state"))


def partial_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a page's blocks: the translation, and in a page that isn't complete the source where there is none."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey").withColumn("q", F.col("l_quantity").cast("int"))
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    blocks = l.groupBy(*key).agg(F.min("q").alias("q"))
    done = blocks.filter("q % 3 <> 0").select(*key, F.concat(F.lit("tr "), F.col("q").cast("string")).alias("text"))
    aside = (F.col("q") % 5 == 0) | (F.col("l_orderkey") % 4 == 0)
    j = blocks.join(done, key, "left")
    return j.select(*key, F.when(F.col("text").isNotNull(), F.col("text")).when(~aside, F.concat(F.lit("src "), F.col("q").cast("string"))).alias("shown"))


def viewport_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on a scaled view whose y goes down from the top, clamped to the page."""
    r = P._rects(spark, sf_dir, "O", "n")
    scale = 1.5
    clamp = lambda c, low, high: F.greatest(F.lit(low), F.least(F.lit(high), c))
    x0, x1, y0, y1 = (clamp(F.col(c), 0.0, m) for c, m in (("x0", 250.0), ("x1", 250.0), ("y0", 300.0), ("y1", 300.0)))
    flip = lambda y: (300.0 - (300.0 - y)) * scale
    return r.select("n", (F.least(x0, x1) * scale).alias("x"), F.least(flip(y0), flip(y1)).alias("y"), (F.abs(x1 - x0) * scale).alias("w"), F.abs(flip(y1) - flip(y0)).alias("h")).filter("w > 1 and h > 1")


def script_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as ideographs one by one and runs of all else."""
    t = filled(spark, sf_dir, text=["中文 %n 字", "%n", "", "深度（%k）学", "a，b", "字"])
    pieces = R.found(F.col("text"), "[⺀-鿿豈-﫿＀-￯　-〿]|[^⺀-鿿豈-﫿＀-￯　-〿]+")
    return t.select("id", F.posexplode(pieces).alias("no", "piece")).select("id", "no", "piece", F.col("piece").rlike("^[⺀-鿿豈-﫿＀-￯　-〿]").alias("ideograph"))


_HAN = "⺀-鿿豈-﫿＀-￯　-〿"
QUERIES = {f.__name__: f for f in (excluded_blocks, author_lines, drawing_groups, components_theta, matched_segments, debounced, prefetch_pages, visible_slots, partial_pages, viewport_boxes, script_pieces)}
ORACLE_SQL = {
    "excluded_blocks": f"""SELECT id, numbers >= 6 AND numbers >= words * 2 AND NOT {_has('text', R.COMMON_BY_FORMULA)} AS numeric, {_has('font', CODE_FONT)} AND {_has('text', CODE)} AS code
FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_full_match(w, '{DECIMAL}'))) AS numbers, len({_found('text', '[A-Za-z]{2,}')}) AS words FROM ({filled_sql(text=_first(BLOCKS), font=_second(BLOCKS))}))""",
    "author_lines": f"SELECT id, [{', '.join(str(b).lower() for _, b in AUTHORS)}][id % {len(AUTHORS)} + 1] AS author FROM ({filled_sql(text=_first(AUTHORS))})",
    "components_theta": f"""WITH RECURSIVE r AS MATERIALIZED ({P._rect_sql('O', 'n')}), way AS MATERIALIZED (SELECT a.n AS x, b.n AS y FROM r a JOIN r b ON a.page = b.page AND a.n <> b.n AND greatest(a.x0, b.x0) - least(a.x1, b.x1) <= 10 AND greatest(a.y0, b.y0) - least(a.y1, b.y1) <= 10),
reach AS (SELECT n, n AS root FROM r UNION SELECT w.y, reach.root FROM reach JOIN way w ON w.x = reach.n) SELECT n, min(root) AS component FROM reach GROUP BY n""",
    "matched_segments": """WITH p AS (SELECT doc_id, string_split(text, 'tion') AS parts FROM documents), h AS (SELECT doc_id, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + 4 * (i - 1) AS INTEGER) AS "at" FROM p, LATERAL unnest(range(1, len(parts))) t(i)),
s AS (SELECT doc_id, i - 1 AS line, len(parts[i]) AS n, parts[1:i] AS before FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), LATERAL unnest(range(1, len(parts) + 1)) t(i)),
l AS (SELECT doc_id, line, CAST(list_sum(list_transform(before, lambda x: len(x))) + line AS BIGINT) AS until, n FROM s)
SELECT h.doc_id, h."at", line, greatest(until - n, "at") - (until - n) AS start, least(until, "at" + 4) - (until - n) AS stop FROM h JOIN l ON l.doc_id = h.doc_id AND greatest(until - n, "at") < least(until, "at" + 4)""",
    "debounced": "SELECT user_id, event_id, event_type FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next IS NULL OR next - ts >= INTERVAL 400 SECOND",
    "prefetch_pages": """WITH c AS (SELECT c_custkey AS doc, c_custkey % 20 AS page, [3, 1, 0][c_custkey % 3 + 1] AS radius FROM customer), o AS (SELECT doc, page + d AS want, CASE WHEN d > 0 THEN 2 * d - 1 ELSE -2 * d END AS r FROM c, LATERAL unnest(range(-radius, radius + 1)) t(d))
SELECT doc, want AS page, row_number() OVER (PARTITION BY doc ORDER BY r) - 1 AS place FROM o WHERE want BETWEEN 0 AND 19 AND (doc + want) % 5 <> 0""",
    "visible_slots": """WITH s AS (SELECT *, sum(h) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS bottom, o_custkey % 7 * 500 AS a FROM (SELECT *, floor(o_totalprice)::BIGINT % 900 + 100 AS h FROM orders))
SELECT o_orderkey, CASE WHEN bottom >= a - 720 AND bottom - h <= a + 1320 THEN 'draw' WHEN bottom - h > a + 1920 OR bottom < a - 1320 THEN 'release' ELSE 'keep' END AS state FROM s""",
    "partial_pages": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN q % 3 <> 0 THEN 'tr ' || q WHEN q % 5 <> 0 AND l_orderkey % 4 <> 0 THEN 'src ' || q END AS shown
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(floor(l_quantity)::INTEGER) AS q FROM lineitem GROUP BY ALL)""",
    "viewport_boxes": f"""SELECT * FROM (SELECT n, least(250.0, x0) * 1.5::DOUBLE AS x, least(300.0, y0) * 1.5::DOUBLE AS y, (least(250.0, x1) - least(250.0, x0)) * 1.5::DOUBLE AS w, (least(300.0, y1) - least(300.0, y0)) * 1.5::DOUBLE AS h FROM ({P._rect_sql('O', 'n')})) WHERE w > 1 AND h > 1""",
    "script_pieces": f"""SELECT id, (i - 1)::INTEGER AS no, p[i] AS piece, regexp_matches(p[i], '^[{_HAN}]') AS ideograph FROM (SELECT id, regexp_extract_all(text, '[{_HAN}]|[^{_HAN}]+') AS p FROM ({filled_sql(text=["中文 %n 字", "%n", "", "深度（%k）学", "a，b", "字"])})), LATERAL unnest(range(1, len(p) + 1)) t(i)""",
}
