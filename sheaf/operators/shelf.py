"""The library of records: groups of editions, filters, search, integrity, merges; notes; cached pages; keys and signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HASH = "^[0-9a-f]{64}$"


def group_id(work: Column, digest: Column) -> Column:
    """Editions of one work share a group; a record without a valid work is its own."""
    return F.when(F.coalesce(work, F.lit("")).rlike(HASH), F.concat(F.lit("work-"), work)).otherwise(F.concat(F.lit("file-"), digest))


def has_words(text: Column, query: str) -> Column:
    """Whether a text has all words of a query, whatever the case."""
    plain, out = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))), F.lit(True)
    for word in query.lower().split():
        out = out & plain.contains(word)
    return out


def home(records: DataFrame, shown: str, query: str, limit: int) -> DataFrame:
    """The first groups of the home list: (position, group_id, hash of the representative, versions).

    In a group, and among groups by their first version, read ones come before unread, then the last read, the last imported,
    the least hash. The representative is the first version at hand, else the first. ``unread`` asks all versions of groups that
    aren't archived, ``archived`` the representative; a search any version."""
    order = F.struct((F.col("last_read") == 0).alias("u"), (-F.col("last_read")).alias("r"), (-F.col("imported_at")).alias("i"), F.col("hash").alias("h"))
    r = records.withColumn("group_id", group_id(F.col("work_id"), F.col("hash"))).withColumn("o", order)
    found = has_words(F.coalesce(F.nullif("display_title", F.lit("")), "title"), query) | has_words(F.col("title"), query) | has_words(F.col("file_name"), query)
    best = F.coalesce(F.min(F.when(F.col("available"), F.struct("o", "archived"))), F.min(F.struct("o", "archived")))
    g = r.groupBy("group_id").agg(F.min("o").alias("first"), best.alias("item"), F.max(F.col("last_read")).alias("read"), F.max(found).alias("found"), F.count("*").alias("versions"))
    archived = F.col("item.archived")
    kept = g.filter({"all": ~archived, "unread": ~archived & (F.col("read") == 0), "archived": archived}[shown] & F.col("found"))
    top = kept.orderBy("first").limit(limit)
    return top.select((F.row_number().over(Window.orderBy("first")) - 1).cast("long").alias("position"), "group_id", F.col("item.o.h").alias("hash"), "versions")


def resume(records: DataFrame) -> DataFrame:
    """The record to go on with: the last read one at hand that isn't archived, and how far it was read in percent."""
    at = records.filter(~F.col("archived") & F.col("available") & (F.col("last_read") > 0)).orderBy(F.col("last_read").desc(), F.col("imported_at").desc(), "hash").limit(1)
    return at.select("hash", progress(F.col("page"), F.col("page_count")).alias("percent"))


def progress(page: Column, count: Column) -> Column:
    return F.when(page.isNotNull() & (count > 0), F.least(F.lit(100.0), F.greatest(F.lit(0.0), page / count * 100))).otherwise(0.0)


def merged(current: DataFrame, entry: DataFrame, key: str) -> DataFrame:
    """Records after entries have come in: an entry's fields win, but not over a later reading, nor over a later presentation of the
    same group. Records on one side only stay as they are."""
    c, e = current.select(key, F.struct(*current.columns).alias("c")), entry.select(key, F.struct(*entry.columns).alias("e"))
    both = c.join(e, key, "full")
    late = F.col("c").isNotNull() & (F.coalesce("e.updated_at", F.lit(0)) < F.coalesce("c.updated_at", F.lit(0)))
    shown = F.col("c").isNotNull() & F.col("c.group_id").eqNullSafe(F.col("e.group_id")) & (F.coalesce("e.revision", F.lit(0)) < F.coalesce("c.revision", F.lit(0)))
    pick = lambda name, keep: F.when(F.col("e").isNull() | keep, F.col(f"c.{name}")).otherwise(F.col(f"e.{name}")).alias(name)
    return both.select(key, *[pick(n, late) for n in ("reading", "updated_at", "last_read")], *[pick(n, shown) for n in ("display_title", "revision")])


def note_valid(note: Column) -> Column:
    """Whether a note (quote, body, anchors of page and rects) is whole: an anchor, each with a page and rectangles of the unit square
    that aren't empty."""
    inside = lambda n: n.isNotNull() & ~F.isnan(n) & n.between(0, 1)
    rect = lambda r: (F.size(r) == 4) & F.forall(r, inside) & (F.element_at(r, 3) > F.element_at(r, 1)) & (F.element_at(r, 4) > F.element_at(r, 2))
    anchor = lambda a: (a["page"] >= 0) & (F.size(a["rects"]) > 0) & F.forall(a["rects"], lambda r: F.when(F.size(r) == 4, rect(r)).otherwise(False))
    return F.coalesce(note["quote"].isNotNull() & note["body"].isNotNull() & (F.size(note["anchors"]) > 0) & F.forall(note["anchors"], anchor), F.lit(False))


def hit_notes(rects: DataFrame, clicks: DataFrame) -> DataFrame:
    """(click, note): of a document's notes whose rectangle on that page holds the point, edges included, the last one made."""
    pair = clicks.join(rects, ["doc", "page"]).filter(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    return pair.groupBy("click").agg(F.max_by("note", F.struct("made", "note")).alias("note"))


def page_state(blocks: DataFrame) -> DataFrame:
    """What is stored of each page after a request: blocks (page, block, translate, valid, fresh, cached, partial, reason).

    A block that isn't translated keeps its text. Else the fresh translation counts, then the complete cache's, then the partial one's,
    each if valid. A page with all is complete; with some it is partial. Reasons of what is missing are listed once, in
    order of their first block."""
    have = ~F.col("translate") | F.col("fresh") | F.col("cached") | F.col("partial")
    b = blocks.withColumn("have", have)
    first = b.filter(~F.col("have")).groupBy("page", "reason").agg(F.min("block").alias("at")).groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "reason"))), lambda s: s["reason"]).alias("reasons"))
    out = b.groupBy("page").agg(F.min("have").alias("complete"), F.sum((~F.col("have")).cast("long")).alias("missing"), F.max(F.col("have") & F.col("translate")).alias("some"))
    stored = F.when(F.col("complete"), "complete").when(F.col("some"), "partial").otherwise("none")
    return out.join(first, "page", "left").select("page", stored.alias("stored"), "missing", F.coalesce(F.concat_ws("; ", "reasons"), F.lit("")).alias("reasons"))


def signature(text: Column, tokens: Column) -> Column:
    """A text with its tokens named by their place in the list, so that other numbers for the same tokens don't matter."""
    return F.aggregate(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), text, lambda x, p: F.replace(x, p["t"], F.concat(F.lit("<"), p["i"].cast("string"), F.lit(">"))))


def grounded(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """Anchors of points: of a point's first two quotes (point, k, page, block, quote) those of 12 to 390 characters that stand in the
    source (page, block, text) they name, the first of each block. White space is collapsed on both sides."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    q = quotes.filter("k < 2").withColumn("quote", plain(F.col("quote"))).filter(F.length("quote").between(12, 390))
    s = sources.select("page", "block", plain(F.col("text")).alias("text"))
    found = q.join(s, ["page", "block"]).filter(F.col("text").contains(F.col("quote")))
    return found.groupBy("point", "page", "block").agg(F.min_by("quote", "k").alias("quote"))


def style_runs(df: DataFrame, by: str, order: str, style: Column, text: str) -> DataFrame:
    """Successive pieces of one style as one run: (by, run, style, text)."""
    w = Window.partitionBy(by).orderBy(order)
    s = df.withColumn("style", style)
    s = s.withColumn("run", F.sum(F.when(F.lag("style").over(w).eqNullSafe(F.col("style")), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]))
    return s.groupBy(by, F.col("run").cast("int").alias("run")).agg(F.first("style").alias("style"), joined.alias("text"))


def cyclic(df: DataFrame, by: str, order: list[str], key: str) -> DataFrame:
    """Each row's next and previous one, the last's next being the first."""
    w = Window.partitionBy(by).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select(by, key, F.coalesce(F.lead(key).over(w), F.first(key).over(whole)).alias("next"), F.coalesce(F.lag(key).over(w), F.last(key).over(whole)).alias("previous"))


def top_slots(slots: DataFrame, scrolls: DataFrame) -> DataFrame:
    """(scroll, slot): of a document's slots (doc, slot, top) the last one whose top is at or above the offset and 1; else the first."""
    marks = slots.select("doc", F.col("top").alias("at"), F.lit(0).alias("kind"), "slot", F.lit(None).cast("long").alias("scroll"))
    asks = scrolls.select("doc", (F.col("offset") + 1).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("slot"), "scroll")
    w = Window.partitionBy("doc").orderBy("at", "kind", "slot").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(asks).withColumn("best", F.last("slot", ignorenulls=True).over(w)).filter("kind = 1").select("scroll", F.coalesce("best", F.lit(0)).alias("slot"))


def endpoint_valid(address: Column, key: Column) -> Column:
    """Whether an address is http or https with a host and without user, query or fragment, and a key is given."""
    return F.coalesce(F.trim(address), F.lit("")).rlike(r"^(?i)https?://[^/?#@\s:]+(:\d+)?(/[^?#]*)?$") & (F.trim(F.coalesce(key, F.lit(""))) != "")
