"""Lines that a group of documents repeats (running headers and footers), and dense numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed value: text of white space, digits, dashes and marks only, at least one of them.
SYMBOLS_ONLY = r"^[\s\d\-–—·°.,;:()\[\]{}<>+=*/|_~^%&$#@!?'\"\\]+$"


def split_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each \\n-split line: the other columns, ``line_no`` from 0, ``line``. A null text has none."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def symbols_only(text: Column) -> Column:
    return text.rlike(SYMBOLS_ONLY)


def repeated(lines: DataFrame, group: str, unit: str, line: str, ratio: float = 0.6, least: int = 3) -> DataFrame:
    """The (group, line) pairs that stand in at least ``max(least, floor(ratio * units))`` distinct units of the group."""
    units = lines.groupBy(group).agg(F.countDistinct(unit).alias("__units"))
    seen = lines.select(group, unit, line).distinct().groupBy(group, line).agg(F.count("*").alias("n_units"))
    return seen.join(units, group).filter(F.col("n_units") >= F.greatest(F.lit(least), F.floor(F.col("__units") * ratio))).drop("__units")


def drop_repeated(lines: DataFrame, group: str, unit: str, line: str, order: str, ratio: float = 0.6, least: int = 3) -> DataFrame:
    """lines without repeated and symbol-only ones, with a dense ``new_no`` from 0 in each unit."""
    found = repeated(lines, group, unit, line, ratio, least).select(group, line)
    kept = lines.join(found, [group, line], "left_anti").filter(~symbols_only(F.col(line)))
    return renumber(kept, [unit], [order])


def renumber(df: DataFrame, by: list[str], order: list[str], name: str = "new_no") -> DataFrame:
    """df with a dense number from 0 in each group."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
