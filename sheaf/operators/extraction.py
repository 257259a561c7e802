"""Documents from the lines of their pages: paragraphs, bibliography entries, running heads out, sections, new numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import page, rules
from .repeated import symbols_only


def prepared(lines: DataFrame) -> DataFrame:
    """Upright lines with content that aren't slivers, with ``math`` by the formula rules. Lines have doc, page (one number over all
    documents), page_no, n, text, box, size, font, bold, italic, color, skip, whole, table, algorithm, source, dx, dy."""
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sliver = (height > 3 * width) & (F.length(F.trim("text")) > 1)
    flat = (F.col("dx") > 0.999) & (F.abs("dy") < 0.001)
    seen = lines.filter((F.trim("text") != "") & ~sliver)
    return seen.withColumn("rotated", ~flat).withColumn("math", rules.math_line(F.col("text"), F.col("font")))


def documents(lines: DataFrame) -> DataFrame:
    """(doc, page_no, id, text, skip, math, bold, lines, indent, box): blocks in reading order.

    Lines of a page become paragraphs; entries of a bibliography are set aside, by their marks and then by section; blocks that stand in
    the same box on 60 % of a document's pages (three at least) and blocks of symbols go; the others get new numbers."""
    flagged = prepared(lines)
    at = flagged.select("page", "doc", "page_no").distinct()
    blocks = page.paragraphs(flagged, ["n"])
    first = flagged.select("page", F.col("x0"), F.col("y0"), "math", "skip")
    own = first.groupBy("page", F.col("y0").alias("top")).agg(F.max("math").alias("math"), F.max("skip").alias("skip"))
    blocks = blocks.join(own, (own["page"] == blocks["page"]) & (own["top"] == blocks["y0"]), "left").select(blocks["*"], F.coalesce("math", F.lit(False)).alias("math"), F.coalesce("skip", F.lit(False)).alias("skip"))
    entries = page.reference_entries(blocks.withColumn("n", F.col("no")))
    blocks = blocks.drop("skip").join(entries.withColumnRenamed("n", "no"), ["page", "no"]).join(at, "page")
    box = F.struct(*[F.round(c, 2) for c in page.BOX])
    keyed = blocks.withColumn("box", box)
    pages = at.groupBy("doc").agg(F.count("*").alias("pages"))
    often = keyed.groupBy("doc", "box", "text").agg(F.countDistinct("page").alias("seen")).join(pages, "doc").filter(F.col("seen") >= F.greatest(F.lit(3), F.floor(F.col("pages") * 0.6)))
    kept = keyed.join(often, ["doc", "box", "text"], "left_anti").filter(~symbols_only(F.col("text")))
    text = rules.strip(F.col("text"))
    event = F.when(text.rlike(rules.CAPTIONS["references"]), True).when(F.col("bold") & text.rlike(rules.AFTER_REFERENCES), False)
    order = Window.partitionBy("doc").orderBy("page_no", "no").rowsBetween(Window.unboundedPreceding, 0)
    marked = kept.withColumn("skip", F.col("skip") | F.coalesce(F.last(event, ignorenulls=True).over(order), F.lit(False)))
    number = F.row_number().over(Window.partitionBy("doc", "page_no").orderBy("no")) - 1
    return marked.select("doc", "page_no", number.cast("int").alias("id"), "text", "skip", "math", "bold", "lines", "indent", *page.BOX)
