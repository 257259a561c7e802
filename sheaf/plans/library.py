"""Queries on the catalogue, search, tokens and planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import catalog
from ..sources.tables import table

NOW = 1_000_000


def _reading_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "value", "event_type")
    return e.select("user_id", "event_id", F.floor(F.col("value") * 100).cast("long").alias("stamp"), F.col("event_type").alias("reading"), (F.floor(F.col("value") * 100) + F.col("event_id") % 7).cast("long").alias("read"))


def lww_reading_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.reading_state(_reading_events(spark, sf_dir), "user_id", "stamp", "event_id", "reading", "read", NOW)


def revision_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    return catalog.revisions(e, "user_id", "event_id", "event_type").groupBy("user_id").agg(F.max("revision").alias("revision"), F.max_by("event_type", "event_id").alias("latest"))


def outbox_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _reading_events(spark, sf_dir)
    newest = lambda d, n: d.groupBy("user_id").agg(F.max("stamp").alias(n))
    records, outbox = newest(e.filter("event_id % 2 = 0"), "saved"), newest(e.filter("event_id % 2 = 1"), "pending")
    return outbox.join(records, "user_id").filter("pending > saved").select("user_id", "pending", "saved")


def edition_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages", "page_id", "html")
    title = F.lower(tx.collapse(F.regexp_extract("html", r"<title>([^<]*)</title>", 1)))
    records = p.select("page_id", title.alias("title"), (F.col("page_id") % 3 != 0).alias("available"), (F.col("page_id") % 5 != 0).alias("unread"))
    return catalog.editions(records, F.col("title"), ["page_id"], "available", "page_id").select("group_id", "n_versions", "representative", "all_unread")


def library_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal")
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_read"), F.count("*").alias("n_orders"))
    view = c.join(o, "c_custkey", "left").withColumn("available", F.col("n_orders").isNotNull()).withColumn("n_orders", F.coalesce("n_orders", F.lit(0)))
    top = view.orderBy(F.col("available").desc(), F.col("last_read").desc_nulls_last(), F.col("c_acctbal").desc(), "c_custkey").limit(50)
    return top.select("c_custkey", "c_name", "available", "n_orders")


def legacy_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_name").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return s.unionByName(catalog.missing(c, s, "key"))


def recent_progress_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice")
    r = o.filter("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("recent"))
    p = o.filter("o_totalprice < 50000").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("progress"))
    return r.join(p, "k", "full").select("k", F.coalesce("recent", F.lit(0)).alias("recent"), F.coalesce("progress", F.lit(0)).alias("progress"))


def storage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "source", "text")
    return catalog.roll_up(d, "source", F.octet_length("text").cast("long"), ["src0", "src1", "src2"])


def reading_state_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "value", "props")
    k = F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999999")).cast("long")
    scale = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 100)
    checked = e.select("event_id", k.alias("k"), scale.alias("scale"))
    reason = F.when(F.col("k").isNull(), "no page").when(F.isnan("scale"), "not a number").when(~F.col("scale").between(0.25, 4), "out of range").otherwise("ok")
    return checked.select("event_id", "k", reason.alias("reason"))


def search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.literal_matches(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", "tion")


def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    at = F.locate("tion", F.col("text")) - 1
    return d.filter(F.contains("text", F.lit("tion"))).select("doc_id", tx.snippet(F.col("text"), at, 4).alias("snippet"))


def search_snippets_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snippet for each match; search_snippets has the first of each document, as its SQL says."""
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    hit = F.explode(tx.snippets(F.col("text"), "tion")).alias("hit")
    return d.filter(F.contains("text", F.lit("tion"))).select("doc_id", hit).select("doc_id", "hit.at", "hit.snippet")


def keyword_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", "p_partkey", "p_name").filter(tx.all_words(F.col("p_name"), "wid  RE")).select("p_partkey")


def collapse_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.sha2(tx.collapse(F.col("text")), 256).alias("digest"))


def multiset_token_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    other = F.when(F.col("doc_id") % 2 == 0, F.reverse(F.split("text", " "))).otherwise(F.split(F.replace("text", F.lit("the"), F.lit("tha")), " "))
    return d.select("doc_id", (F.array_sort(F.split("text", " ")) == F.array_sort(other)).alias("equal"))


def reply_id_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies by id: doubled ids give null, unknown ones are ignored."""
    d = table(spark, sf_dir, "documents", "doc_id", "n_chars")
    reply = d.select((F.col("doc_id") + F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)).alias("doc_id"), (F.col("n_chars") * 2).alias("answer"))
    single = reply.groupBy("doc_id").agg(F.count("*").alias("c"), F.max("answer").alias("answer")).filter("c = 1").drop("c")
    return d.join(single, "doc_id", "left").select("doc_id", "answer")


def cache_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows carried over by signature and place, the last of doubled ones; what has changed stays empty."""
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    old = line.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct("l_partkey", "l_quantity")).alias("m")).select("l_orderkey", "l_linenumber", F.col("m.l_partkey").alias("cached"), F.col("m.l_quantity").alias("signature"))
    new = line.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("signature"))
    return new.join(old, ["l_orderkey", "l_linenumber", "signature"], "left").select("l_orderkey", "l_linenumber", "cached")


def quote_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages that stand word for word in a document: an inner join on the passage's first 40 characters at
    each line or word start would miss none, but the passages are few; they are broadcast under a check of their number."""
    d, b = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", F.col("text").alias("quote"))
    small = F.broadcast(b) if b.count() <= 10_000 else b
    return d.join(small, F.contains("text", F.col("quote"))).select("doc_id", "item_id")


def work_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages", "page_id", "html")
    title = F.lower(tx.collapse(F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1)))
    return p.filter(F.length(title) > 0).select("page_id", F.sha2(title, 256).alias("work_id"))


def message_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failing check of a turn: empty, too short, no letter, shouting."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    t = F.col("text")
    issue = F.when(F.length(F.trim(t)) == 0, "empty").when(F.length(t) < 40, "short").when(~t.rlike("[A-Za-z]"), "no letter").when(F.upper(t) == t, "shouting").otherwise("ok")
    return c.select("conv_id", "turn", issue.alias("issue"))


def group_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_totalprice")
    return o.groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") == "O").alias("all_open"), F.bool_or(F.col("o_totalprice") > 300000).alias("some_large"), F.count_if(F.col("o_orderstatus") == "F").alias("n_final"))


def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate", "l_returnflag")
    late, early = (line.filter(f"l_returnflag = '{x}'").select("l_orderkey") for x in "NR")
    return late.exceptAll(early).groupBy("l_orderkey").agg(F.count("*").alias("n"))


def recent_notes_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four orders of each customer by date (bounded arrays)."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return o.withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).filter("r <= 4").select("o_custkey", "o_orderkey", "r")


_EVENTS = "e AS (SELECT user_id, event_id, CAST(floor(value * 100) AS BIGINT) AS stamp, event_type AS reading, CAST(floor(value * 100) AS BIGINT) + event_id % 7 AS rd FROM events)"

QUERIES = {f.__name__: f for f in (lww_reading_state, revision_merge, outbox_replay, edition_groups, library_view, legacy_migrate, recent_progress_outer, storage_rollup, reading_state_validate, search_literal, search_snippets, search_snippets_all, keyword_conjunction, collapse_ws, multiset_token_equality, reply_id_join, cache_migration, quote_grounding, work_fingerprint, message_validity, group_predicates, multiset_difference, recent_notes_top)}
ORACLE_SQL = {
    "lww_reading_state": f"""
WITH {_EVENTS},
s AS (SELECT * FROM e WHERE stamp BETWEEN 0 AND 1060000 AND rd BETWEEN 0 AND 1060000),
a AS (SELECT *, coalesce(max(stamp) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM s)
SELECT user_id, max(stamp) AS updated_at, max_by(reading, stamp) AS reading, max(rd) AS last_read, count(*) AS n_accepted FROM a WHERE stamp > top GROUP BY user_id""",
    "revision_merge": """
WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, CAST(sum(c) AS BIGINT) AS revision, max_by(event_type, event_id) AS latest FROM c GROUP BY user_id""",
    "outbox_replay": f"""
WITH {_EVENTS}, r AS (SELECT user_id, max(stamp) AS saved FROM e WHERE event_id % 2 = 0 GROUP BY 1), o AS (SELECT user_id, max(stamp) AS pending FROM e WHERE event_id % 2 = 1 GROUP BY 1)
SELECT user_id, pending, saved FROM o JOIN r USING (user_id) WHERE pending > saved""",
    "edition_groups": r"""
WITH r AS (SELECT page_id, lower(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g'))) AS g, page_id % 3 <> 0 AS available, page_id % 5 <> 0 AS unread FROM pages)
SELECT g AS group_id, count(*) AS n_versions, coalesce(min(CASE WHEN available THEN page_id END), min(page_id)) AS representative, bool_and(unread) AS all_unread FROM r GROUP BY g""",
    "library_view": """
WITH o AS (SELECT o_custkey AS c_custkey, max(o_orderdate) AS last_read, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, c_name, n IS NOT NULL AS available, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN o USING (c_custkey)
ORDER BY n IS NOT NULL DESC, last_read DESC NULLS LAST, c_acctbal DESC, c_custkey LIMIT 50""",
    "legacy_migrate": "SELECT s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "recent_progress_outer": """
WITH r AS (SELECT o_custkey AS k, count(*) AS recent FROM orders WHERE o_totalprice > 200000 GROUP BY 1), p AS (SELECT o_custkey AS k, count(*) AS progress FROM orders WHERE o_totalprice < 50000 GROUP BY 1)
SELECT k, coalesce(recent, 0) AS recent, coalesce(progress, 0) AS progress FROM r FULL JOIN p USING (k)""",
    "storage_rollup": """
WITH s AS (SELECT source, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(*) AS files FROM documents GROUP BY 1)
SELECT source AS category, bytes, files FROM s WHERE source IN ('src0', 'src1', 'src2')
UNION ALL SELECT 'other', CAST(sum(CASE WHEN source NOT IN ('src0', 'src1', 'src2') THEN bytes ELSE 0 END) AS BIGINT), CAST(sum(CASE WHEN source NOT IN ('src0', 'src1', 'src2') THEN files ELSE 0 END) AS BIGINT) FROM s""",
    "reading_state_validate": """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'no page' WHEN event_id % 11 = 0 THEN 'not a number' WHEN NOT (value / 100 BETWEEN 0.25 AND 4) THEN 'out of range' ELSE 'ok' END AS reason
FROM events""",
    "search_literal": """
WITH p AS (SELECT doc_id, string_split(text, 'tion') AS parts FROM documents)
SELECT doc_id, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + 4 * (i - 1) AS INTEGER) AS "at" FROM p, LATERAL unnest(range(1, len(parts))) t(i)""",
    "search_snippets": """
WITH p AS (SELECT doc_id, text, instr(text, 'tion') - 1 AS i FROM documents WHERE contains(text, 'tion')),
q AS (SELECT *, greatest(i - 40, 0) AS s, i + 64 AS e FROM p)
SELECT doc_id, CASE WHEN s > 0 THEN '…' ELSE '' END || replace(replace(replace(replace(substr(text, s + 1, e - s), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || CASE WHEN e < length(text) THEN '…' ELSE '' END AS snippet FROM q""",
    "search_snippets_all": """
WITH p AS (SELECT doc_id, text, string_split(text, 'tion') AS parts FROM documents),
h AS (SELECT doc_id, text, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + 4 * (i - 1) AS INTEGER) AS "at" FROM p, LATERAL unnest(range(1, len(parts))) t(i)),
q AS (SELECT *, greatest("at" - 40, 0) AS s, "at" + 64 AS e FROM h)
SELECT doc_id, "at", CASE WHEN s > 0 THEN '…' ELSE '' END || replace(replace(replace(replace(substr(text, s + 1, e - s), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || CASE WHEN e < length(text) THEN '…' ELSE '' END AS snippet FROM q""",
    "keyword_conjunction": "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'wid') AND contains(lower(p_name), 're')",
    "collapse_ws": r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents",
    "multiset_token_equality": """
SELECT doc_id, list_sort(string_split(text, ' ')) = list_sort(CASE WHEN doc_id % 2 = 0 THEN string_split(text, ' ') ELSE string_split(replace(text, 'the', 'tha'), ' ') END) AS equal FROM documents""",
    "reply_id_join": """
WITH r AS (SELECT doc_id + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS id, n_chars * 2 AS a FROM documents), s AS (SELECT id, max(a) AS a FROM r GROUP BY id HAVING count(*) = 1)
SELECT doc_id, a AS answer FROM documents LEFT JOIN s ON id = doc_id""",
    "cache_migration": """
WITH o AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS cached, max(l_quantity) FILTER (WHERE l_partkey = m) AS sig
  FROM (SELECT *, max(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS m FROM lineitem) GROUP BY 1, 2),
n AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS sig FROM lineitem GROUP BY 1, 2)
SELECT n.l_orderkey, n.l_linenumber, o.cached FROM n LEFT JOIN o USING (l_orderkey, l_linenumber, sig)""",
    "quote_grounding": "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "work_fingerprint": r"""
WITH t AS (SELECT page_id, lower(trim(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '\s+', ' ', 'g'))) AS t FROM pages)
SELECT page_id, sha256(t) AS work_id FROM t WHERE length(t) > 0""",
    "message_validity": """
SELECT conv_id, turn, CASE WHEN length(trim(text)) = 0 THEN 'empty' WHEN length(text) < 40 THEN 'short' WHEN NOT regexp_matches(text, '[A-Za-z]') THEN 'no letter' WHEN upper(text) = text THEN 'shouting' ELSE 'ok' END AS issue FROM conversations""",
    "group_predicates": "SELECT o_custkey, bool_and(o_orderstatus = 'O') AS all_open, bool_or(o_totalprice > 300000) AS some_large, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS n_final FROM orders GROUP BY 1",
    "multiset_difference": "SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N' EXCEPT ALL SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1",
    "recent_notes_top": "SELECT o_custkey, o_orderkey, CAST(r AS INTEGER) AS r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r <= 4",
}
