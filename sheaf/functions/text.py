"""Text expressions: white space, search, snippets, tokens, and the Unicode normal forms that need Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def collapse(x: Column) -> Column:
    """Runs of any white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def literal_offsets(text: Column, needle: str) -> Column:
    """Offsets from 0 of all non-overlapping occurrences from left to right; none of an empty needle."""
    if not needle:
        return F.array().cast("array<int>")
    parts = F.split(text, r"\Q" + needle + r"\E", -1)
    sizes = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.length(p) + len(needle))
    ends = F.aggregate(sizes, F.array().cast("array<int>"), lambda a, s: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + s))
    return F.transform(ends, lambda e: e - len(needle))


def literal_matches(df: DataFrame, key: str, text: str, needle: str, name: str = "at") -> DataFrame:
    """(key, at) of all non-overlapping occurrences, one row each: the pieces between them are rows, and running sums of their
    lengths are the offsets. Linear in the pieces; rows that repeat a key are told apart."""
    rows = df.select(key, text, F.monotonically_increasing_id().alias("__row"))
    parts = rows.select(key, "__row", F.posexplode(F.split(F.col(text), r"\Q" + needle + r"\E", -1)).alias("__i", "__part"))
    sizes = parts.select(key, "__row", "__i", F.length("__part").alias("__n"))
    w = Window.partitionBy(key, "__row").orderBy("__i")
    upto = F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__i") * len(needle)
    last = F.lead("__i").over(w).isNull()
    return sizes.select(key, upto.cast("int").alias(name), last.alias("__last")).filter("not __last").drop("__last")


def snippet(text: Column, at: Column, size: int, before: int = 40, after: int = 60) -> Column:
    """What stands around a match, HTML-escaped, with ellipses where it is cut."""
    start = F.greatest(at - before, F.lit(0))
    end = at + size + after
    body = F.substring(text, start + 1, end - start)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        body = F.replace(body, F.lit(a), F.lit(b))
    return F.concat(F.when(start > 0, F.lit("…")).otherwise(""), body, F.when(end < F.length(text), F.lit("…")).otherwise(""))


def snippets(text: Column, needle: str) -> Column:
    """(at, snippet) of all matches of literal_offsets."""
    return F.transform(literal_offsets(text, needle), lambda at: F.struct(at.alias("at"), snippet(text, at, len(needle)).alias("snippet")))


def all_words(text: Column, query: str) -> Column:
    """Whether every word of the query is a substring of the lowered text."""
    low = F.lower(text)
    return F.forall(F.split(F.lit(" ".join(query.lower().split())), " "), lambda w: F.contains(low, w))


def tokens(text: Column, pattern: str) -> Column:
    """Sorted multiset of what matches."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Compatibility normal form; Spark has no expression for it."""
    return x.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.StringType())
def casefold(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else v.casefold())


def clean_title(x: Column) -> Column:
    """Normal form, soft hyphens dropped, words wrapped by a hyphen joined, line breaks between CJK characters dropped, white space collapsed."""
    x = F.replace(nfkc(x), F.lit("­"), F.lit(""))
    x = F.regexp_replace(x, r"(\p{L}{2,})-\s*\n\s*(\p{Ll})", "$1$2")
    x = F.regexp_replace(x, r"([㐀-鿿])\s*\n\s*(?=[㐀-鿿])", "$1")
    return collapse(x)
