"""Pages as rows of boxes: paragraphs from lines, bibliography entries, visual rows, tables by their grid, captions and charts,
columns, reading anchors. A box has x0, y0, x1, y1 in points, y downward.

What depends on the rows before it in more than a running sum (a paragraph's box so far, a row's baseline) is folded by one
task for a page: a page is bounded by what is printed on it. All else is joins, windows and aggregates."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import rules
from .components import components
from .grouped import fold_rows

BOX = ("x0", "y0", "x1", "y1")


def fold_pages(df: DataFrame, by: str, order: list[str], step: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """The rows that step makes of each page's rows in order."""
    return fold_rows(df, [by], order, lambda rows: iter(step(list(rows))), schema)


def may_join(a: dict, b: dict) -> bool:
    """Whether line b goes on with paragraph a. A box ``a`` is that of all its lines; ``source`` is its last line's."""
    for c in ("table", "algorithm", "math", "skip"):
        if a[c] != b[c]:
            return False
    if any(x[c] for x in (a, b) for c in ("whole", "rotated")):
        return False
    gap, size = b["y0"] - a["y1"], min(a["size"], b["size"])
    advance = (b["y0"] + b["y1"]) / 2 - (a["y0"] + a["y1"]) / 2
    if gap < 0 and not (advance > 0.55 * size and gap >= -0.55 * size):
        return False
    if gap > max(4.0, 0.9 * size) or abs(b["x0"] - a["x0"]) > max(12.0, 1.25 * size):
        return False
    special = any(x[c] for x in (a, b) for c in ("math", "skip"))
    same = a["source"] is not None and a["source"] == b["source"] and not special
    open_ = same and not re.search(r"[.!?]\s*$", a["text"])
    if abs(b["size"] - a["size"]) > (0.2 * size if open_ else 0.6):
        return False
    if (a["bold"], a["italic"]) != (b["bold"], b["italic"]):
        broken = same and re.search(r"[A-Za-z]{2}-$", a["text"]) and re.match("[a-z]", b["text"])
        led = same and not a["table"] and not a["algorithm"] and (len(re.findall("[A-Za-z㐀-鿿]+", a["text"])) >= 8 or re.search(r"[.:;：；。]\s*$", a["text"]))
        if not (broken or led):
            return False
    return not (special and a["color"] != b["color"])


def _paragraphs(rows: list[dict]) -> list[dict]:
    out: list[dict] = []
    for line in rows:
        last = out[-1] if out else None
        if last is None or not may_join(last, line):
            out.append(line | {"lines": 1, "indent": 0.0, "first": line["x0"]})
            continue
        if last["lines"] == 1:
            last["indent"] = max(0.0, last["first"] - line["x0"])
        ours, theirs = len(last["text"]), len(line["text"])
        last["bold"] = last["bold"] * ours + line["bold"] * theirs > (ours + theirs) / 2
        start = line["text"].lstrip()
        broken = re.search("[A-Za-z]{2}-$", last["text"]) and re.match("[a-z]", start)
        last["text"] = last["text"][:-1] + start if broken else last["text"] + " " + line["text"]
        last |= {"x0": min(last["x0"], line["x0"]), "y0": min(last["y0"], line["y0"]), "x1": max(last["x1"], line["x1"]), "y1": max(last["y1"], line["y1"]), "lines": last["lines"] + 1, "source": line["source"]}
    return [p | {"no": i} for i, p in enumerate(out)]


def paragraphs(lines: DataFrame, order: list[str]) -> DataFrame:
    """Paragraphs of the lines (page, text, box, size, bold, italic, color, math, skip, whole, rotated, table, algorithm, source):
    (page, no, lines, indent, bold, text, box)."""
    schema = "page long, no int, lines int, indent double, bold boolean, text string, x0 double, y0 double, x1 double, y1 double"
    keep = [c.split()[0] for c in schema.split(", ")]
    return fold_pages(lines, "page", order, lambda rows: [{k: p[k] for k in keep} for p in _paragraphs(rows)], schema)


def _entries(rows: list[dict]) -> list[dict]:
    out, edge, bottom = [], None, 0.0
    for r in rows:
        said = False
        if not (r["math"] or r["skip"]):
            said = edge is not None and r["x0"] > edge + 3 and r["y0"] - bottom < 14
            if said:
                bottom = r["y1"]
            else:
                edge = None
                if r["reference"]:
                    said, edge, bottom = True, r["x0"], r["y1"]
        out.append({"page": r["page"], "n": r["n"], "skip": said or r["skip"]})
    return out


def reference_entries(lines: DataFrame) -> DataFrame:
    """(page, n, skip): lines that begin a bibliography entry (a citation mark, the heading, a short line with a reference mark)
    and the indented ones that follow closely."""
    text = F.col("text")
    mark = text.rlike(rules.CAPTIONS["citation"]) | text.rlike(rules.CAPTIONS["references"]) | ((F.length(text) < 60) & text.rlike(rules.CAPTIONS["reference_mark"]))
    return fold_pages(lines.withColumn("reference", mark).select("page", "n", "x0", "y0", "y1", "math", "skip", "reference"), "page", ["n"], _entries, "page long, n int, skip boolean")


def _rows(lines: list[dict]) -> list[dict]:
    out, held, row = [], None, -1
    for r in lines:
        near = held is not None and abs(r["baseline"] - held["baseline"]) <= max(3.5, 0.5 * max(r["size"], held["size"])) and r["x0"] >= held["x0"] - 2
        if not near:
            held, row = r, row + 1
        out.append({"page": r["page"], "n": r["n"], "row": row})
    return out


def visual_rows(lines: DataFrame) -> DataFrame:
    """(page, n, row): lines that stand on one row, as scripts split them: within half a font size of the row's first baseline, not
    left of it. Small fractions under a row aren't looked for."""
    return fold_pages(lines.select("page", "n", "x0", "size", F.col("y1").alias("baseline")), "page", ["n"], _rows, "page long, n int, row int")


def union_box(df: DataFrame, *by: str) -> DataFrame:
    """The box around all boxes of each group."""
    return df.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def clusters(df: DataFrame, by: str, value: str, gap: float, name: str) -> DataFrame:
    """df with a number from 0 for each chain of values that are at most gap apart."""
    w = Window.partitionBy(by).orderBy(value)
    step = F.when(F.col(value) - F.lag(value).over(w) > gap, 1).otherwise(0)
    return df.withColumn("__step", step).withColumn(name, F.sum("__step").over(w.rangeBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__step")


DATA_CELL = r"(?i)^(?:[\s\d.,%+−–-]+|yes|no|N/?A)$"


def table_cells(lines: DataFrame, width: float) -> DataFrame:
    """(page, n) of the lines that are cells of a table: small lines in a grid of chained rows and columns, joined to the next cell of
    their row or column; a component is a table by its cells, its data, its rows and columns and how full it is."""
    text = F.col("text")
    small = lines.filter(~(F.col("skip") | F.col("math")) & ~text.rlike(rules.CAPTIONS["table"]) & ~text.rlike(rules.CAPTIONS["figure"]) & (F.col("y1") - F.col("y0") < 30) & (F.col("x1") - F.col("x0") < 0.6 * width) & (F.length(text) < 40))
    grid = clusters(clusters(small, "page", "x0", 5, "col"), "page", "y0", 5, "row")
    grid = grid.withColumn("key", F.struct("page", "n"))
    across, down = Window.partitionBy("page", "row").orderBy("x0", "n"), Window.partitionBy("page", "col").orderBy("y0", "n")
    edges = grid.select(F.col("key").alias("a"), F.lead("key").over(across).alias("b"), (F.lead("x0").over(across) - F.col("x1")).alias("gap")).filter(F.col("gap") <= 0.24 * width)
    edges = edges.unionByName(grid.select(F.col("key").alias("a"), F.lead("key").over(down).alias("b"), (F.lead("y0").over(down) - F.col("y1")).alias("gap")).filter("gap <= 30")).select("a", "b")
    found = grid.join(components(grid.select("key"), edges, "key"), "key")
    size = found.groupBy("component").agg(F.count("*").alias("cells"), F.sum(text.rlike(DATA_CELL).cast("int")).alias("data"), F.countDistinct("col").alias("cols"), F.countDistinct("row").alias("rows"), F.array_sort(F.collect_set("y0")).alias("tops"))
    gaps = F.array_sort(F.zip_with(F.slice("tops", 2, 10_000), F.slice(F.col("tops"), F.lit(1), F.greatest(F.size("tops") - 1, F.lit(0))), lambda b, a: b - a))
    median = F.when(F.size(gaps) > 0, F.element_at(gaps, (F.size(gaps) / 2).cast("int") + 1))
    tables = size.filter((F.col("cells") >= 6) & (F.col("data") >= 3) & F.col("cols").between(2, 16) & (F.col("rows") >= 3) & (F.col("cells") >= 0.5 * F.col("cols") * F.col("rows")) & (F.coalesce(median, F.lit(0.0)) <= 30))
    return found.join(tables.select("component"), "component", "left_semi").select("page", "n")


def near_captions(tables: DataFrame, captions: DataFrame) -> DataFrame:
    """Pairs of a page's tables (t, box) and captions (c, box): 60 % of the narrower's width in common, the caption close above or below."""
    c = captions.select("page", "c", *[F.col(k).alias(f"c{k}") for k in BOX])
    pair = tables.join(c, "page")
    overlap = F.least("x1", "cx1") - F.greatest("x0", "cx0")
    above, below = F.col("y0") - F.col("cy1"), F.col("cy0") - F.col("y1")
    return pair.filter((overlap >= 0.6 * F.least(F.col("x1") - F.col("x0"), F.col("cx1") - F.col("cx0"))) & (above.between(-8, 65) | below.between(-8, 32))).select("page", "t", "c")


def image_text(blocks: DataFrame, protected: DataFrame) -> DataFrame:
    """(page, n) of the blocks inside a protected area: 80 % of their own, or the centre of one with less than five words."""
    r = protected.select("page", *[F.col(k).alias(f"r{k}") for k in BOX])
    pair = blocks.filter(~(F.col("math") | F.col("skip"))).join(r, "page")
    w = F.greatest(F.least("x1", "rx1") - F.greatest("x0", "rx0"), F.lit(0.0))
    h = F.greatest(F.least("y1", "ry1") - F.greatest("y0", "ry0"), F.lit(0.0))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    few = F.size(rules.found(F.col("text"), rules.WORD)) < 5
    inside = (few & cx.between(F.col("rx0"), F.col("rx1")) & cy.between(F.col("ry0"), F.col("ry1"))) | ((area > 0) & (w * h >= 0.8 * area))
    return pair.filter(inside).select("page", "n").distinct()


def chart_labels(graphics: DataFrame, lines: DataFrame, width: float) -> DataFrame:
    """Graphics (page, g, box) grown by the labels left of them, where there are three or more."""
    names = lines.select("page", *[F.col(k).alias(f"l{k}") for k in BOX], "text", "size")
    beside = (F.col("y0") <= F.col("ly0")) & (F.col("ly1") <= F.col("y1")) & (F.col("x0") - F.col("lx1")).between(0, 14)
    fits = (F.col("lx1") - F.col("lx0") < 0.4 * width) & (F.length("text") < 80) & (F.col("size") <= 12)
    labels = graphics.join(names, "page").filter(beside & fits).groupBy("page", "g").agg(F.count("*").alias("labels"), F.min("lx0").alias("lx0"), F.min("ly0").alias("ly0"), F.max("lx1").alias("lx1"), F.max("ly1").alias("ly1")).filter("labels >= 3")
    grown = graphics.join(labels, ["page", "g"], "left")
    return grown.select("page", "g", F.least("x0", "lx0").alias("x0"), F.least("y0", "ly0").alias("y0"), F.greatest("x1", "lx1").alias("x1"), F.greatest("y1", "ly1").alias("y1"))


def background_frames(fills: DataFrame, lines: DataFrame, width: float) -> DataFrame:
    """(page, f) of light fills behind prose, and of the frames they stand in: same sides and bottom, a top up to 26 higher."""
    big = fills.filter((F.col("x1") - F.col("x0") >= 0.35 * width) & (F.col("y1") - F.col("y0") >= 40))
    other = big.select("page", F.col("f").alias("frame"), F.col("shade").alias("oshade"), *[F.col(k).alias(f"o{k}") for k in BOX])
    framed = big.filter("shade >= 0.88").join(other, "page").filter((F.col("frame") != F.col("f")) & (F.col("oshade") != F.col("shade")) & (F.abs(F.col("ox0") - F.col("x0")) <= 3) & (F.abs(F.col("ox1") - F.col("x1")) <= 3) & (F.abs(F.col("oy1") - F.col("y1")) <= 3) & (F.col("y0") - F.col("oy0")).between(0, 26))
    prose = lines.filter(F.size(rules.found(F.col("text"), "[A-Za-z]{2,}")) >= 7).select("page", *[F.col(k).alias(f"l{k}") for k in BOX])
    inside = (F.col("lx0") >= F.col("x0")) & (F.col("ly0") >= F.col("y0")) & (F.col("lx1") <= F.col("x1")) & (F.col("ly1") <= F.col("y1")) & (F.col("lx1") - F.col("lx0") >= 0.55 * (F.col("x1") - F.col("x0")))
    kept = framed.join(prose, "page").filter(inside)
    return kept.select("page", "f").unionByName(kept.select("page", F.col("frame").alias("f"))).distinct()


def side(x0: Column, x1: Column, width: float) -> Column:
    """-1 for a box in the left half, 1 in the right half, else 0; each may pass the middle by 3."""
    return F.when(x1 <= width / 2 + 3, -1).when(x0 >= width / 2 - 3, 1).otherwise(0)


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """How far two intervals are apart; 0 if they meet."""
    return F.greatest(F.lit(0.0), F.greatest(a0, b0) - F.least(a1, b1))


def cover_header(blocks: DataFrame, width: float, height: float) -> DataFrame:
    """(page, n) of a first page's blocks that cross the middle, about centred, above the abstract (or in the upper 26 %)."""
    body = blocks.filter(~(F.col("math") | F.col("skip")))
    head = body.filter(F.col("text").rlike(r"(?i)^\s*(abstract|summary)\b")).groupBy("page").agg(F.min_by("y0", "n").alias("cutoff"))
    centre = (F.col("x0") + F.col("x1")) / 2
    return body.join(head, "page", "left").filter((F.col("y1") < F.coalesce("cutoff", F.lit(0.26 * height)) - 1) & (F.col("x0") < width / 2) & (F.col("x1") > width / 2) & (F.abs(centre - width / 2) <= 0.1 * width)).select("page", "n")


def column_layout(blocks: DataFrame, width: float, height: float) -> DataFrame:
    """(page, column, x0, x1, top, bottom, blocks): two columns where narrow blocks stand on both sides of the middle, each side has
    substance, they don't meet, and all other blocks cross the middle above both; else one."""
    mid, slack = width / 2, max(3.0, 0.012 * width)
    body = blocks.filter(~(F.col("math") | F.col("skip")))
    centre = (F.col("x0") + F.col("x1")) / 2
    at = F.when((centre < mid) & (F.col("x1") <= mid + slack), "l").when((centre >= mid) & (F.col("x0") >= mid - slack), "r").otherwise("o")
    b = body.withColumn("at", at)
    heavy = (F.col("y1") - F.col("y0") >= 0.12 * height) | (F.length("text") >= 160)
    own = b.groupBy("page", "at").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("top"), F.max_by("y1", F.struct("y0", "n")).alias("bottom"), F.count("*").alias("blocks"), ((F.count("*") >= 2) | F.max(heavy)).alias("heavy"))
    l, r = (own.filter(F.col("at") == k).select("page", *[F.col(c).alias(k + c) for c in ("x0", "x1", "top", "heavy")]) for k in "lr")
    other = b.filter("at = 'o'").groupBy("page").agg(F.max("y1").alias("ob"), F.min(((F.col("x0") < mid) & (F.col("x1") > mid)).cast("int")).alias("cross"))
    two = l.join(r, "page").join(other, "page", "left").filter(F.col("lheavy") & F.col("rheavy") & (F.col("rx0") > F.col("lx1") + 4) & (F.col("ob").isNull() | ((F.col("cross") == 1) & (F.col("ob") <= F.least("ltop", "rtop") - 1)))).select("page")
    split = own.filter("at <> 'o'").join(two, "page", "left_semi").select("page", F.when(F.col("at") == "l", 0).otherwise(1).alias("column"), "x0", "x1", "top", "bottom", "blocks")
    whole = b.join(two, "page", "left_anti").groupBy("page").agg(F.lit(0).alias("column"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("top"), F.max_by("y1", F.struct("y0", "n")).alias("bottom"), F.count("*").alias("blocks"))
    return split.unionByName(whole)


def equation_columns(equations: DataFrame, columns: DataFrame) -> DataFrame:
    """(page, n, column): the column that an equation overlaps most, the first of equals."""
    c = columns.select("page", "column", F.col("x0").alias("cx0"), F.col("x1").alias("cx1"))
    overlap = F.least("x1", "cx1") - F.greatest("x0", "cx0")
    return equations.join(c, "page").groupBy("page", "n").agg(F.max_by("column", F.struct(overlap, -F.col("column"))).alias("column"))


def reading_anchor(blocks: DataFrame, x: Column, guide: Column) -> DataFrame:
    """(page, n, offset): the block nearest to a point, sideways distances counting 0.12, and how far down it the point is."""
    v = F.greatest(F.lit(0.0), F.col("y0") - guide, guide - F.col("y1"))
    h = F.greatest(F.lit(0.0), F.col("x0") - x, x - F.col("x1"))
    at = (guide - F.col("y0")) / F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    best = blocks.groupBy("page").agg(F.min(F.struct((v + h * 0.12).alias("d"), F.col("n").alias("n"), at.alias("offset"))).alias("m"))
    return best.select("page", "m.n", "m.offset")
