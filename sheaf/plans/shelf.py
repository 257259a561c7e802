"""Queries on the library, notes, cached pages and the reader. Records are made of the customers, notes of the orders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import search
from ..operators import rules
from ..operators import shelf as S
from ..sources.tables import table


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    k = F.col("c_custkey").cast("long")
    sha = lambda prefix, v: F.sha2(F.concat(F.lit(prefix), v.cast("string")), 256)
    return c.select(
        k.alias("k"), sha("c", k).alias("hash"), F.when(k % 4 == 0, F.lit(None)).when(k % 9 == 0, "broken").otherwise(sha("w", (k * 7) % 311)).alias("work_id"), F.col("c_name").alias("title"),
        F.concat(F.lower("c_mktsegment"), F.lit("  "), (k % 13).cast("string"), F.lit(".pdf")).alias("file_name"), F.when(k % 5 == 0, F.concat(F.lit("My Paper "), (k % 17).cast("string"))).otherwise("").alias("display_title"),
        (k % 50).cast("int").alias("page_count"), (1000 + (k * 37) % 5000).alias("imported_at"), F.when((k % 3 == 0) | (k * 7 % 311 < 60), 0).otherwise((k * 91) % 7000).cast("long").alias("last_read"),
        (k % 7 != 0).alias("available"), ((k * 7) % 311 % 6 == 0).alias("archived"), F.when(k % 8 == 0, F.lit(None)).otherwise(k % 60 + 1).cast("int").alias("page"), (k % 40).alias("updated_at"), (k % 6).cast("int").alias("revision"),
    )


RECORDS = """records AS MATERIALIZED (
  SELECT k, sha256('c' || k) AS hash, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 9 = 0 THEN 'broken' ELSE sha256('w' || (k * 7 % 311)) END AS work_id, c_name AS title, lower(c_mktsegment) || '  ' || (k % 13) || '.pdf' AS file_name,
    CASE WHEN k % 5 = 0 THEN 'My Paper ' || (k % 17) ELSE '' END AS display_title, k % 50 AS page_count, 1000 + k * 37 % 5000 AS imported_at, CASE WHEN k % 3 = 0 OR k * 7 % 311 < 60 THEN 0 ELSE k * 91 % 7000 END AS last_read,
    k % 7 <> 0 AS available, k * 7 % 311 % 6 = 0 AS archived, CASE WHEN k % 8 <> 0 THEN k % 60 + 1 END AS page, k % 40 AS updated_at, k % 6 AS revision
  FROM (SELECT *, c_custkey AS k FROM customer)), g AS MATERIALIZED (SELECT *, CASE WHEN regexp_matches(coalesce(work_id, ''), '^[0-9a-f]{64}$') THEN 'work-' || work_id ELSE 'file-' || hash END AS group_id FROM records)"""


def _home(shown: str, query: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.home(records(spark, sf_dir), shown, query, 50)

    return run


def _home_sql(shown: str, query: str) -> str:
    plain = lambda c: f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
    words = lambda c: "(" + " AND ".join([f"contains({plain(c)}, '{w}')" for w in query.lower().split()] or ["true"]) + ")"
    found = " OR ".join(words(c) for c in ("CASE WHEN display_title = '' THEN title ELSE display_title END", "title", "file_name"))
    test = {"all": "NOT archived", "unread": "NOT archived AND read = 0", "archived": "archived"}[shown]
    return f"""WITH {RECORDS}, o AS (SELECT *, row_number() OVER (ORDER BY last_read = 0, last_read DESC, imported_at DESC, hash) AS o FROM g),
v AS (SELECT group_id, min(o) AS first, max(last_read) AS read, bool_or({found}) AS found, count(*) AS versions, coalesce(arg_min(hash, o) FILTER (available), arg_min(hash, o)) AS hash, coalesce(arg_min(archived, o) FILTER (available), arg_min(archived, o)) AS archived FROM o GROUP BY group_id)
SELECT row_number() OVER (ORDER BY first) - 1 AS position, group_id, hash, versions FROM v WHERE found AND {test} ORDER BY first LIMIT 50"""


def resume_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.resume(records(spark, sf_dir))


def server_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).orderBy((F.col("last_read") > 0).desc(), F.col("last_read").desc(), F.col("imported_at").desc(), "hash").limit(50)
    return r.select("hash", "last_read", "imported_at")


#: Records as JSON: whole ones and ones with a defect each.
JSONS = [
    '{"hash": "%h", "title": "T %k", "file_name": "f.pdf", "page_count": %k, "imported_at": 5, "last_read": 0, "updated_at": 1.5}', '{"hash": "x%h", "title": "T", "file_name": "f.pdf", "page_count": 1, "imported_at": 5, "last_read": 0, "updated_at": 1}',
    '{"hash": "%h", "title": 7, "file_name": "f.pdf", "page_count": 1, "imported_at": 5, "last_read": 0, "updated_at": 1}', '{"hash": "%h", "title": "T", "page_count": 1, "imported_at": 5, "last_read": 0, "updated_at": 1}', '{"hash": "%h", "title": "T", "file_name": "f.pdf", "page_count": "1", "imported_at": 5, "last_read": 0, "updated_at": 1}',
    '{"hash": "%h", "title": "T", "file_name": "f.pdf", "page_count": 1, "imported_at": -5, "last_read": 0, "updated_at": 1}', '{"hash": "%h", "title": "T"', '["%h"]', '{"hash": "%h", "title": "", "file_name": "", "page_count": 0, "imported_at": 0, "last_read": 0, "updated_at": 0, "more": [1]}', 'null',
    '{"hash": "%h", "title": "T", "file_name": "f.pdf", "page_count": 1, "imported_at": 5, "last_read": null, "updated_at": 1}',
]


def _json(spark: SparkSession, sf_dir: str, shapes: list[str]) -> DataFrame:
    k = F.col("c_custkey")
    out = F.element_at(F.array(*map(F.lit, shapes)), (k % len(shapes) + 1).cast("int"))
    h = F.sha2(F.concat(F.lit("c"), k.cast("string")), 256)
    return table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").select(k.cast("long").alias("k"), F.col("c_mktsegment").alias("shelf"), h.alias("hash"), F.replace(F.replace(out, F.lit("%h"), h), F.lit("%k"), (k % 97).cast("string")).alias("j"))


def _json_sql(shapes: list[str]) -> str:
    listed = ", ".join("'" + s.replace("'", "''") + "'" for s in shapes)
    return f"SELECT c_custkey AS k, c_mktsegment AS shelf, sha256('c' || c_custkey) AS hash, replace(replace([{listed}][c_custkey % {len(shapes)} + 1], '%h', sha256('c' || c_custkey)), '%k', (c_custkey % 97)::VARCHAR) AS j FROM customer"


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _number(v: Column, path: str) -> Column:
    return F.when(_kind(v, path).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.try_variant_get(v, path, "double"))


def record_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each shelf the records that can be shown, and how many are damaged."""
    t = _json(spark, sf_dir, JSONS).withColumn("v", F.try_parse_json("j"))
    v = F.col("v")
    texts = (_kind(v, "$.title") == "STRING") & (_kind(v, "$.file_name") == "STRING") & (F.try_variant_get(v, "$.hash", "string") == F.col("hash"))
    numbers = F.lit(True)
    for c in ("page_count", "imported_at", "last_read", "updated_at"):
        numbers = numbers & F.coalesce(_number(v, f"$.{c}") >= 0, F.lit(False))
    ok = F.coalesce(texts & numbers, F.lit(False))
    return t.groupBy("shelf").agg(F.sum(ok.cast("long")).alias("items"), F.sum((~ok).cast("long")).alias("damaged"), F.min(F.when(ok, F.col("k"))).alias("first"))


READINGS = [
    '{"mode": "single", "page": %k.7, "scale": 1.5}', '{"mode": "duo", "page": 3, "duoScale": 9}', '{"mode": "spread"}', '{}', '{"page": true}', '{"page": "3"}', '{"page": 0}', '{"page": 100001}', '{"scale": 0.25, "page": %k1}', '{"scale": 0.2}', '[1]', '{"mode": "continuous", "page": 5, "fitWidth": false, "duoSync": true}', '{"fitWidth": null, "page": 12, "duoSync": 1}', '{"mode": "single"',
]


def reading_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading states of clients: whitelisted and bounded, or rejected; the page stays within the record's pages."""
    t = _json(spark, sf_dir, READINGS).withColumn("v", F.try_parse_json("j"))
    v = F.col("v")
    kind = F.coalesce(F.schema_of_variant("v"), F.lit(""))
    mode = F.when(_kind(v, "$.mode").isNull(), "continuous").otherwise(F.try_variant_get(v, "$.mode", "string"))
    ok, value = kind.startswith("OBJECT") & mode.isin("continuous", "single", "duo"), {}
    for name, low, high in (("page", 1, 100000), ("scale", 0.25, 4), ("duoScale", 0.25, 4)):
        value[name] = F.when(_kind(v, f"$.{name}").isNull(), F.lit(1.0)).otherwise(_number(v, f"$.{name}"))
        ok = ok & F.coalesce(value[name].between(low, high), F.lit(False))
    pages = (F.col("k") % 50).cast("int")
    page = F.floor(value["page"]).cast("int")
    flag = lambda c, default: F.when(_kind(v, f"$.{c}") == "BOOLEAN", F.try_variant_get(v, f"$.{c}", "boolean")).otherwise(F.lit(default))
    t = t.withColumn("valid", F.coalesce(ok, F.lit(False)))
    shown = lambda c: F.when(F.col("valid"), c)
    return t.select("k", "valid", shown(mode).alias("mode"), shown(F.when(pages > 0, F.least(page, pages)).otherwise(page)).alias("page"), shown(value["scale"]).alias("scale"), shown(flag("fitWidth", True)).alias("fit"), shown(flag("duoSync", False)).alias("sync"))


def record_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumn("group_id", S.group_id(F.col("work_id"), F.col("hash")))
    cur = r.filter("k % 5 <> 1").select("k", "group_id", F.col("page").alias("reading"), "updated_at", "last_read", "display_title", "revision")
    new = r.filter("k % 6 <> 2").select("k", F.when(F.col("k") % 10 == 0, "other").otherwise(F.col("group_id")).alias("group_id"), (F.col("page") + 1).alias("reading"), ((F.col("k") * 3) % 41).alias("updated_at"), (F.col("last_read") + 5).alias("last_read"), F.concat(F.lit("new "), F.col("k").cast("string")).alias("display_title"), ((F.col("k") * 5) % 7).cast("int").alias("revision"))
    return S.merged(cur, new, "k")


def presentation_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest edit of a group's presentation reaches all of its records that aren't newer."""
    r = records(spark, sf_dir).withColumn("group_id", S.group_id(F.col("work_id"), F.col("hash")))
    edits = r.filter("k % 11 = 0").groupBy("group_id").agg(F.max(F.struct("revision", "k")).alias("e")).select("group_id", (F.col("e.revision") + 1).alias("new"), F.concat(F.lit("edit "), F.col("e.k").cast("string")).alias("name"))
    j = r.join(edits, "group_id", "left")
    won = F.col("new").isNotNull() & (F.col("new") >= F.col("revision"))
    return j.select("k", F.when(won, F.col("name")).otherwise(F.col("display_title")).alias("display_title"), F.when(won, F.col("new")).otherwise(F.col("revision")).alias("revision"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    k, p = F.col("o_orderkey").cast("long"), F.floor("o_totalprice").cast("long")
    x, y = (p % 80) / 100.0, (p % 71) / 100.0
    rect = F.array(x, y, F.when(k % 17 == 0, x).otherwise(x + 0.15), F.when(k % 19 == 0, F.lit(1.5)).otherwise(y + 0.1))
    rects = F.when(k % 23 == 0, F.array().cast("array<array<double>>")).when(k % 29 == 0, F.array(F.array(x, y, x + 0.1))).otherwise(F.array(rect))
    anchors = F.when(k % 31 == 0, F.array().cast("array<struct<page:int,rects:array<array<double>>>>")).otherwise(F.array(F.struct(F.when(k % 37 == 0, -1).otherwise(p % 9).cast("int").alias("page"), rects.alias("rects"))))
    return o.select(k.alias("note"), F.col("o_custkey").cast("long").alias("doc"), (p % 1000).alias("made"), F.struct(F.when(k % 41 == 0, F.lit(None)).otherwise("q").alias("quote"), F.lit("b").alias("body"), anchors.alias("anchors")).alias("n"))


def valid_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that are whole, numbered in a document by page and time."""
    n = _notes(spark, sf_dir).filter(S.note_valid(F.col("n"))).withColumn("page", F.col("n.anchors")[0]["page"])
    return n.select("note", "doc", "page", (F.row_number().over(Window.partitionBy("doc").orderBy("page", "made", "note")) - 1).cast("long").alias("place"))


def note_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _notes(spark, sf_dir).filter(S.note_valid(F.col("n")))
    rects = n.select("doc", "note", "made", F.explode("n.anchors").alias("a")).select("doc", "note", "made", "a.page", F.explode("a.rects").alias("r")).select("doc", "note", "made", "page", *[F.col("r")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])
    e = table(spark, sf_dir, "events", "event_id", "value", "user_id")
    clicks = e.select(F.col("event_id").cast("long").alias("click"), (F.col("event_id") % 1500).cast("long").alias("doc"), (F.col("user_id") % 9).cast("int").alias("page"), ((F.floor(F.col("value") * 100) % 97) / 100.0).alias("x"), ((F.floor(F.col("value") * 100) % 89) / 100.0).alias("y"))
    return S.hit_notes(rects, clicks)


def overview_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that an overview may quote: with letters, not set aside, formulas only if displayed."""
    t = table(spark, sf_dir, "conversations", "conv_id", "turn", "text", "role")
    skip, math, shown = F.col("turn") % 7 == 3, F.col("turn") % 5 == 2, F.col("conv_id") % 2 == 0
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    return t.filter(~skip & (~math | shown) & text.rlike(r"\p{L}")).select(F.concat_ws(":", (F.col("conv_id") + 1).cast("string"), F.col("turn").cast("string")).alias("id"), text.alias("text"), F.when(math & shown, "formula").otherwise("text").alias("kind"))


def grounded_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select(F.col("conv_id").alias("page"), F.col("turn").alias("block"), "text")
    point = F.col("page") * 100 + F.col("block")
    cut = lambda at, n: F.substring("text", at, n)
    one = lambda k, shift, quote: F.struct(F.lit(k).alias("k"), F.lit(shift).alias("shift"), quote.alias("quote"))
    quotes = F.array(one(0, 0, cut(3, 40)), one(1, 0, F.concat(F.lit("  "), cut(10, 25))), one(2, 0, cut(1, 30)))
    off = F.array(one(0, 1, cut(3, 40)), one(1, 0, F.when(F.col("block") % 3 == 0, cut(1, 11)).otherwise(cut(5, 60))))
    q = t.select(point.alias("point"), "page", "block", F.explode(F.when(point % 2 == 0, quotes).otherwise(off)).alias("q")).select("point", F.col("q.k").alias("k"), "page", (F.col("block") + F.col("q.shift")).alias("block"), F.col("q.quote").alias("quote"))
    return S.grounded(q, t)


def page_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    q = F.col("l_quantity").cast("int")
    b = t.select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("block"), (q % 5 != 0).alias("translate"), (q % 3 != 0).alias("fresh"), (F.col("l_partkey") % 4 == 0).alias("cached"), (F.col("l_suppkey") % 4 == 0).alias("partial"), F.element_at(F.array(F.lit("timeout"), F.lit("network"), F.lit("invalid")), (q % 3 + F.col("l_partkey") % 2 + 1).cast("int")).alias("reason"))
    return S.page_state(b)


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    base = F.when(F.col("k") % 2 == 0, "https://api.example.com").otherwise(F.concat(F.lit("https://h"), (F.col("k") % 5).cast("string"), F.lit(".example.org/v1")))
    key = F.concat_ws("|", F.lit("30"), F.lit("7"), (F.col("k") % 50).cast("string"), F.lit("model"), F.lit("中文"))
    far = F.when(F.lower(base).isin("https://api.example.com", "https://api.example.com/v1"), F.lit("")).otherwise(F.concat(F.lit("|endpoint="), F.substring(F.sha2(base, 256), 1, 16)))
    return r.select("k", F.concat(key, far, F.lit("|prompt="), F.sha2(F.col("title"), 256)).alias("key"), F.col("hash").rlike(S.HASH).alias("valid"), F.coalesce(F.col("work_id").rlike(S.HASH), F.lit(False)).alias("work_valid"))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose tokens were numbered anew have one signature."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name")
    token = lambda n: F.concat(F.lit("__MATH_"), F.lpad(n.cast("string"), 4, "0"), F.lit("__"))
    k = F.col("p_partkey")
    two = F.array(token(k % 50 + 1), token(k % 50 + 2))
    text = F.concat(F.col("p_name"), F.lit(" "), two[0], F.lit(" and "), F.when(k % 3 == 0, two[0]).otherwise(two[1]))
    return p.select("p_name", S.signature(text, two).alias("signature"), k.alias("k")).groupBy("p_name", "signature").agg(F.count("*").alias("blocks"))


def storage_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("b"))
    big = d.withColumn("b", F.col("b") * F.element_at(F.array(*[F.lit(x) for x in (1, 37, 1024, 40000, 3000000, 1073741824)]), (F.col("doc_id") % 6 + 1).cast("int")))
    return big.select("doc_id", rules.human_bytes(F.col("b")).alias("size"))


def browser_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the keys and values that a key-value store has under a prefix."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props")
    kv = e.select("user_id", F.concat(F.when(F.col("event_id") % 3 == 0, "other-").otherwise("paper-reader-"), F.col("event_type")).alias("key"), F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.col("props"), F.lit("é"))).alias("value"))
    return kv.filter(F.col("key").startswith("paper-reader-")).groupBy("user_id").agg(F.sum(F.octet_length(F.concat("key", F.coalesce("value", F.lit("")))).cast("long")).alias("bytes"))


def cyclic_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cyclic(table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")


def style_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events", "user_id", "event_id", "event_type")
    return S.style_runs(t, "user_id", "event_id", F.when(F.col("event_id") % 4 < 2, "bold").otherwise("plain"), "event_type")


def top_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    slots = l.withColumn("slot", (F.row_number().over(w) - 1).cast("int")).withColumn("h", (F.floor("o_totalprice").cast("long") % 900 + 100))
    slots = slots.select(F.col("o_custkey").alias("doc"), "slot", (F.sum("h").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("h") + 8).alias("top"))
    e = table(spark, sf_dir, "events", "event_id", "value")
    scrolls = e.select((F.col("event_id") % 1500).alias("doc"), F.col("event_id").cast("long").alias("scroll"), (F.floor(F.col("value") * 100).cast("long") * 3).alias("offset"))
    return S.top_slots(slots, scrolls)


ADDRESSES = ["https://api.example.com/v1", "http://host:8080", "ftp://x.org", "https://user@x.org/", "https://x.org/?q=1", "https://x.org/a#b", "  https://x.org/%n ", "https://", "x.org", "HTTPS://X.ORG", "", "http://%n.org/v1/"]


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import filled

    t = filled(spark, sf_dir, address=ADDRESSES)
    return t.select("id", S.endpoint_valid(F.col("address"), F.when(F.col("id") % 10 == 3, "  ").otherwise("key")).alias("valid"))


def work_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions of one work by a hash of title and abstract; none where the abstract isn't whole or too short."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").filter(F.col("text").isNotNull())
    title = F.concat(F.lit("Title  "), (F.col("doc_id") % 40).cast("string"))
    page = F.concat(F.lit("12\nAbstract\n"), F.col("text"), F.when(F.col("doc_id") % 4 == 0, "\nand so").otherwise("\n1. Introduction\nmore"))
    clean = F.regexp_replace(page, r"(?m)^\s*\d{1,4}\s*$", "")
    abstract = F.regexp_extract(clean, r"(?im)^\s*abstract\s*\n([\s\S]*?)^\s*(?:1[.\s]*)?introduction\s*(?:\n|\z)", 1)
    flat = F.lower(F.trim(F.regexp_replace(F.regexp_replace(abstract, r"([A-Za-z])-\s*\n\s*([a-z])", "$1$2"), r"\s+", " ")))
    enough = F.length(flat).between(200, 8000) & (F.length(F.regexp_replace(flat, r"[^\p{L}]", "")) >= 120)
    key = F.sha2(F.concat(F.lower(F.trim(F.regexp_replace(title, r"\s+", " "))), F.lit("\n"), flat), 256)
    return d.select("doc_id", F.when(enough, key).alias("work_id"))


def sentence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long texts cut where a sentence ends and 180 characters are there: (doc_id, no, length, piece's hash)."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").filter(F.col("text").isNotNull())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, p) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for k, p in enumerate(search.sentence_pieces(t))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string()))], ["doc_id", "no", "piece"])

    out = d.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, no int, piece string")
    return out.select("doc_id", "no", F.length("piece").alias("length"), F.md5("piece").alias("hash"))


def search_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a needle in the normal form of each text (case, ligatures, soft hyphens, breaks), as offsets of the text itself."""
    d = table(spark, sf_dir, "documents", "doc_id", "text").filter(F.col("text").isNotNull())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, a, b) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for a, b in search.matches(t, "Tion  The")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "end"])

    return d.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, "doc_id long, start long, end long")


QUERIES = {f.__name__: f for f in (resume_candidate, server_sort, record_integrity, reading_states, record_merge, presentation_edits, valid_notes, note_hits, overview_sources, grounded_anchors, page_progress, cache_keys, signatures, storage_sizes, browser_bytes, cyclic_results, style_runs, top_slots, endpoints, work_fingerprints, sentence_pack, search_normalised)}
QUERIES |= {"home_all": _home("all", ""), "home_unread": _home("unread", ""), "home_archived": _home("archived", ""), "home_search": _home("all", "Paper 1")}

_NUMBERS = " AND ".join(f"coalesce(json_type(j, '$.{c}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND json_extract(j, '$.{c}')::DOUBLE >= 0, false)" for c in ("page_count", "imported_at", "last_read", "updated_at"))
_READING = lambda c: f"CASE WHEN coalesce(json_type(j, '$.{c}'), 'NULL') = 'NULL' AND NOT json_exists(j, '$.{c}') THEN 1.0::DOUBLE WHEN json_type(j, '$.{c}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN json_extract(j, '$.{c}')::DOUBLE END"
_NOTES = """notes AS MATERIALIZED (
  SELECT o_orderkey AS note, o_custkey AS doc, p % 1000 AS made, (p % 9)::INTEGER AS page, p % 80 / 100.0::DOUBLE AS x0, p % 71 / 100.0::DOUBLE AS y0, p % 80 / 100.0::DOUBLE + 0.15::DOUBLE AS x1, p % 71 / 100.0::DOUBLE + 0.1::DOUBLE AS y1 FROM (SELECT *, floor(o_totalprice)::BIGINT AS p FROM orders)
  WHERE o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0 AND o_orderkey % 23 <> 0 AND o_orderkey % 29 <> 0 AND o_orderkey % 31 <> 0 AND o_orderkey % 37 <> 0 AND o_orderkey % 41 <> 0)"""
_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


def bytes_sql(b: str) -> str:
    out = f"CASE WHEN {b} < 1024 THEN {b} || ' B'"
    for k, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        x = f"({b} / {1024**k}.0::DOUBLE)"
        trimmed = f"regexp_replace(regexp_replace(CASE WHEN {x} < 10 THEN printf('%.2f', round({x}, 2)) WHEN {x} < 100 THEN printf('%.1f', round({x}, 1)) ELSE format('{{:,}}', round({x}, 0)::BIGINT) || '.0' END, '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
        out += f" WHEN {b} < {1024 ** (k + 1)} OR {k} = 4 THEN {trimmed} || ' {unit}'"
    return out + " END"


def _endpoint_sql() -> str:
    from .rules import filled_sql

    return f"SELECT id, regexp_matches(trim(address), '(?i)^https?://[^/?#@\\s:]+(:\\d+)?(/[^?#]*)?$') AND id % 10 <> 3 AS valid FROM ({filled_sql(address=ADDRESSES)})"


ORACLE_SQL = {f"home_{n}": _home_sql(s, q) for n, s, q in (("all", "all", ""), ("unread", "unread", ""), ("archived", "archived", ""), ("search", "all", "Paper 1"))} | {
    "resume_candidate": f"WITH {RECORDS} SELECT hash, CASE WHEN page IS NOT NULL AND page_count > 0 THEN least(100.0, greatest(0.0, page / page_count::DOUBLE * 100)) ELSE 0.0 END AS percent FROM g WHERE NOT archived AND available AND last_read > 0 ORDER BY last_read DESC, imported_at DESC, hash LIMIT 1",
    "server_sort": f"WITH {RECORDS} SELECT hash, last_read, imported_at FROM g ORDER BY last_read > 0 DESC, last_read DESC, imported_at DESC, hash LIMIT 50",
    "record_integrity": f"""WITH t AS (SELECT k, shelf, hash, CASE WHEN json_valid(j) THEN j::JSON END AS j FROM ({_json_sql(JSONS)})),
v AS (SELECT k, shelf, coalesce(json_type(j, '$.title') = 'VARCHAR' AND json_type(j, '$.file_name') = 'VARCHAR' AND json_extract_string(j, '$.hash') = hash AND {_NUMBERS}, false) AS ok FROM t)
SELECT shelf, count(*) FILTER (ok) AS items, count(*) FILTER (NOT ok) AS damaged, min(k) FILTER (ok) AS "first" FROM v GROUP BY shelf""",
    "reading_states": f"""WITH t AS (SELECT k, CASE WHEN json_valid(j) THEN j::JSON END AS j FROM ({_json_sql(READINGS)})),
v AS (SELECT k, j, json_type(j) = 'OBJECT' AS o, CASE WHEN json_exists(j, '$.mode') THEN json_extract_string(j, '$.mode') ELSE 'continuous' END AS mode, {_READING('page')} AS page, {_READING('scale')} AS scale, {_READING('duoScale')} AS duo FROM t),
w AS (SELECT *, coalesce(o AND mode IN ('continuous', 'single', 'duo') AND page BETWEEN 1 AND 100000 AND scale BETWEEN 0.25 AND 4 AND duo BETWEEN 0.25 AND 4, false) AS valid FROM v)
SELECT k, valid, CASE WHEN valid THEN mode END AS mode, CASE WHEN valid THEN CASE WHEN k % 50 > 0 THEN least(floor(page), k % 50) ELSE floor(page) END END::INTEGER AS page, CASE WHEN valid THEN scale END AS scale,
  CASE WHEN valid THEN coalesce(json_type(j, '$.fitWidth') <> 'BOOLEAN' OR json_extract_string(j, '$.fitWidth') = 'true', true) END AS fit, CASE WHEN valid THEN coalesce(json_type(j, '$.duoSync') = 'BOOLEAN' AND json_extract_string(j, '$.duoSync') = 'true', false) END AS sync FROM w""",
    "record_merge": f"""WITH {RECORDS}, c AS (SELECT k, group_id, page AS reading, updated_at, last_read, display_title, revision FROM g WHERE k % 5 <> 1),
e AS (SELECT k, CASE WHEN k % 10 = 0 THEN 'other' ELSE group_id END AS group_id, page + 1 AS reading, k * 3 % 41 AS updated_at, last_read + 5 AS last_read, 'new ' || k AS display_title, k * 5 % 7 AS revision FROM g WHERE k % 6 <> 2),
j AS (SELECT coalesce(c.k, e.k) AS k, c, e, e.k IS NULL OR (c.k IS NOT NULL AND e.updated_at < c.updated_at) AS late, e.k IS NULL OR (c.k IS NOT NULL AND c.group_id = e.group_id AND e.revision < c.revision) AS shown FROM c FULL JOIN e ON c.k = e.k)
SELECT k, CASE WHEN late THEN c.reading ELSE e.reading END AS reading, CASE WHEN late THEN c.updated_at ELSE e.updated_at END AS updated_at, CASE WHEN late THEN c.last_read ELSE e.last_read END AS last_read,
  CASE WHEN shown THEN c.display_title ELSE e.display_title END AS display_title, CASE WHEN shown THEN c.revision ELSE e.revision END AS revision FROM j""",
    "presentation_edits": f"""WITH {RECORDS}, e AS (SELECT group_id, max(revision) + 1 AS new, 'edit ' || arg_max(k, revision * 1000000 + k) AS name FROM g WHERE k % 11 = 0 GROUP BY group_id)
SELECT k, CASE WHEN e.new >= revision THEN e.name ELSE display_title END AS display_title, CASE WHEN e.new >= revision THEN e.new ELSE revision END AS revision FROM g LEFT JOIN e ON e.group_id = g.group_id""",
    "valid_notes": f"WITH {_NOTES} SELECT note, doc, page, row_number() OVER (PARTITION BY doc ORDER BY page, made, note) - 1 AS place FROM notes",
    "note_hits": f"""WITH {_NOTES}, c AS (SELECT event_id AS click, event_id % 1500 AS doc, user_id % 9 AS page, floor(value * 100)::BIGINT % 97 / 100.0::DOUBLE AS x, floor(value * 100)::BIGINT % 89 / 100.0::DOUBLE AS y FROM events)
SELECT click, arg_max(note, made * 100000000 + note) AS note FROM c JOIN notes n ON n.page = c.page AND n.doc = c.doc AND c.x BETWEEN x0 AND x1 AND c.y BETWEEN y0 AND y1 GROUP BY click""",
    "overview_sources": f"SELECT (conv_id + 1) || ':' || turn AS id, {_FLAT} AS text, CASE WHEN turn % 5 = 2 THEN 'formula' ELSE 'text' END AS kind FROM conversations WHERE turn % 7 <> 3 AND (turn % 5 <> 2 OR conv_id % 2 = 0) AND regexp_matches(text, '\\p{{L}}')",
    "grounded_anchors": f"""WITH t AS (SELECT conv_id AS page, turn AS block, text, conv_id * 100 + turn AS point FROM conversations),
q AS (SELECT point, 0 AS k, page, block, text[3:42] AS quote FROM t WHERE point % 2 = 0 UNION ALL SELECT point, 1, page, block, '  ' || text[10:34] FROM t WHERE point % 2 = 0
  UNION ALL SELECT point, 0, page, block + 1, text[3:42] FROM t WHERE point % 2 <> 0 UNION ALL SELECT point, 1, page, block, CASE WHEN block % 3 = 0 THEN text[1:11] ELSE text[5:64] END FROM t WHERE point % 2 <> 0),
c AS (SELECT point, k, page, block, trim(regexp_replace(quote, '\\s+', ' ', 'g')) AS quote FROM q)
SELECT point, c.page, c.block, arg_min(quote, k) AS quote FROM c JOIN t USING (page, block, point) WHERE len(quote) BETWEEN 12 AND 390 AND contains({_FLAT}, quote) GROUP BY point, c.page, c.block
UNION ALL SELECT c.point, c.page, c.block, arg_min(quote, k) FROM c JOIN t ON t.page = c.page AND t.block = c.block AND t.point <> c.point WHERE len(quote) BETWEEN 12 AND 390 AND contains({_FLAT}, quote) GROUP BY c.point, c.page, c.block""",
    "page_progress": """WITH b AS (SELECT l_orderkey AS page, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey AS block, q % 5 <> 0 AS translate, q % 5 = 0 OR q % 3 <> 0 OR l_partkey % 4 = 0 OR l_suppkey % 4 = 0 AS have, ['timeout', 'network', 'invalid'][q % 3 + l_partkey % 2 + 1] AS reason FROM (SELECT *, floor(l_quantity)::INTEGER AS q FROM lineitem)),
r AS (SELECT page, string_agg(reason, '; ' ORDER BY first, reason) AS reasons FROM (SELECT page, reason, min(block) AS first FROM b WHERE NOT have GROUP BY page, reason) GROUP BY page)
SELECT b.page, CASE WHEN bool_and(have) THEN 'complete' WHEN bool_or(have AND translate) THEN 'partial' ELSE 'none' END AS stored, count(*) FILTER (NOT have) AS missing, coalesce(any_value(reasons), '') AS reasons FROM b LEFT JOIN r ON r.page = b.page GROUP BY b.page""",
    "cache_keys": f"""WITH {RECORDS} SELECT k, '30|7|' || (k % 50) || '|model|中文' || CASE WHEN k % 2 = 0 THEN '' ELSE '|endpoint=' || left(sha256('https://h' || (k % 5) || '.example.org/v1'), 16) END || '|prompt=' || sha256(title) AS key,
  regexp_matches(hash, '^[0-9a-f]{{64}}$') AS valid, coalesce(regexp_matches(work_id, '^[0-9a-f]{{64}}$'), false) AS work_valid FROM g""",
    "signatures": "SELECT p_name, p_name || ' <0> and ' || CASE WHEN p_partkey % 3 = 0 THEN '<0>' ELSE '<1>' END AS signature, count(*) AS blocks FROM part GROUP BY ALL",
    "storage_sizes": f"SELECT doc_id, {bytes_sql('b')} AS size FROM (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT * [1, 37, 1024, 40000, 3000000, 1073741824][doc_id % 6 + 1] AS b FROM documents)",
    "browser_bytes": "SELECT user_id, sum(octet_length(encode('paper-reader-' || event_type || CASE WHEN event_id % 5 = 0 THEN '' ELSE props || 'é' END)))::BIGINT AS bytes FROM events WHERE event_id % 3 <> 0 GROUP BY user_id",
    "cyclic_results": "SELECT o_custkey, o_orderkey, coalesce(lead(o_orderkey) OVER w, first_value(o_orderkey) OVER w) AS next, coalesce(lag(o_orderkey) OVER w, last_value(o_orderkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "style_runs": """WITH s AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 4 < 2 THEN 'bold' ELSE 'plain' END AS style FROM events), n AS (SELECT *, CASE WHEN style = lag(style) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM s),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS run FROM n) SELECT user_id, run::INTEGER AS run, any_value(style) AS style, string_agg(event_type, '' ORDER BY event_id) AS text FROM r GROUP BY user_id, run""",
    "top_slots": """WITH s AS (SELECT o_custkey AS doc, row_number() OVER w - 1 AS slot, sum(h) OVER w - h + 8 AS top FROM (SELECT *, floor(o_totalprice)::BIGINT % 900 + 100 AS h FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
e AS (SELECT event_id AS scroll, event_id % 1500 AS doc, floor(value * 100)::BIGINT * 3 AS "offset" FROM events) SELECT scroll, coalesce(max(slot), 0)::INTEGER AS slot FROM e LEFT JOIN s ON s.doc = e.doc AND s.top <= "offset" + 1 GROUP BY scroll""",
    "endpoints": _endpoint_sql(),
    "work_fingerprints": """WITH p AS (SELECT doc_id, 'title ' || (doc_id % 40) AS title, regexp_replace(chr(10) || '12' || chr(10) || 'Abstract' || chr(10) || text || CASE WHEN doc_id % 4 = 0 THEN chr(10) || 'and so' ELSE chr(10) || '1. Introduction' || chr(10) || 'more' END, '(?m)^\\s*\\d{1,4}\\s*$', '', 'g') AS page FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, title, lower(trim(regexp_replace(regexp_replace(regexp_extract(page, '(?im)^\\s*abstract\\s*\\n((?s:.*?))^\\s*(?:1[.\\s]*)?introduction\\s*(?:\\n|\\z)', 1), '([A-Za-z])-\\s*\\n\\s*([a-z])', '\\1\\2', 'g'), '\\s+', ' ', 'g'))) AS abstract FROM p)
SELECT doc_id, CASE WHEN len(abstract) BETWEEN 200 AND 8000 AND len(regexp_replace(abstract, '[^\\p{L}]', '', 'g')) >= 120 THEN sha256(title || chr(10) || abstract) END AS work_id FROM a""",
    "sentence_pack": """WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(text, '([.!?])(\\s+)([A-Z_])', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), '([.!?])(\\s+)([A-Z_])', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), chr(1)) AS x FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, 1 AS i, 0 AS no, x[1] AS piece FROM s
  UNION ALL SELECT f.doc_id, i + 1, CASE WHEN len(piece) >= 180 THEN no + 1 ELSE no END, CASE WHEN len(piece) >= 180 THEN split_part(x[i + 1], chr(2), 2) ELSE piece || replace(x[i + 1], chr(2), '') END FROM f JOIN s ON s.doc_id = f.doc_id WHERE i < len(x))
SELECT doc_id, no, len(arg_max(piece, i)) AS length, md5(arg_max(piece, i)) AS hash FROM f GROUP BY doc_id, no""",
}
