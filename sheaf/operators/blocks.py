"""Folds over one group's sorted rows, where a row is compared with what has been accumulated: rectangles, paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouped import fold_rows, type_of


def merge_rectangles(df: DataFrame, by: list[str]) -> DataFrame:
    """Rectangles x0, y0, x1, y1 in ascending order, each joined with the last result if they intersect (touching does not
    count), else a result of its own. Not a closure: earlier results are not looked at again. Gives (by, no, x0, y0, x1, y1)."""

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        last = None
        for r in rows:
            if last and max(last["x0"], r["x0"]) < min(last["x1"], r["x1"]) and max(last["y0"], r["y0"]) < min(last["y1"], r["y1"]):
                last |= {"x0": min(last["x0"], r["x0"]), "y0": min(last["y0"], r["y0"]), "x1": max(last["x1"], r["x1"]), "y1": max(last["y1"], r["y1"])}
                continue
            if last:
                yield last
            last = r | {"no": last["no"] + 1 if last else 0}
        if last:
            yield last

    box = ["x0", "y0", "x1", "y1"]
    slim = df.select(*by, *[F.col(c).cast("double").alias(c) for c in box])
    return fold_rows(slim, by, box, step, ", ".join([*[type_of(df, c) for c in by], "no int", *[f"{c} double" for c in box]]))


def merge_paragraphs(df: DataFrame, by: list[str], order: str, kind: str, text: str, most: int) -> DataFrame:
    """Successive rows of one kind joined by spaces while the accumulated text stays within most characters. Gives (by, no, kind, n, body)."""

    def step(rows: Iterator[dict]) -> Iterator[dict]:
        head, parts, size, no = None, [], 0, 0
        for r in rows:
            body = r[text] or ""
            if head and head[kind] == r[kind] and size + 1 + len(body) <= most:
                parts.append(body)
                size += 1 + len(body)
                continue
            if head:
                yield {**{c: head[c] for c in by}, "no": no, kind: head[kind], "n": len(parts), "body": " ".join(parts)}
                no += 1
            head, parts, size = r, [body], len(body)
        if head:
            yield {**{c: head[c] for c in by}, "no": no, kind: head[kind], "n": len(parts), "body": " ".join(parts)}

    schema = [*[type_of(df, c) for c in by], "no int", type_of(df, kind), "n int", "body string"]
    return fold_rows(df.select(*by, order, kind, text), by, [order, kind, text], step, ", ".join(schema))


def title_candidate(df: DataFrame, by: str, size: Column, top: Column, text: str) -> DataFrame:
    """Of each group's rows the text with the greatest size; of equals the one higher on the page, then the greatest text."""
    return df.groupBy(by).agg(F.max(F.struct(size.alias("s"), (-top).alias("h"), F.col(text).alias("t"))).alias("m")).select(by, F.col("m.t").alias("title"))


def untranslatable(text: Column) -> Column:
    """The first rule by which a text needs no translation, or null: empty, symbols, address, code, capitals, number with unit."""
    return (
        F.when(F.length(F.trim(text)) == 0, "empty")
        .when(~text.rlike("[A-Za-z]") & ~text.rlike(r"\p{L}"), "symbols")
        .when(text.rlike(r"^\s*(https?://|www\.)\S+\s*$") | text.rlike(r"^\s*\S+@\S+\.\S+\s*$"), "address")
        .when(text.rlike(r"^\s*[\w.]+\([^)]*\)\s*;?\s*$"), "code")
        .when((F.length(text) < 12) & (F.upper(text) == text), "capitals")
        .when(text.rlike(r"^\s*[0-9.,]+\s*[A-Za-z%]{1,3}\s*$"), "quantity")
    )
