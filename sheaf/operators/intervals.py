"""One-dimensional intervals, as-of look-ups and rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_intervals(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Unions of overlapping intervals; those that only touch stay apart. Gives (by, start, end, n)."""
    w = Window.partitionBy(*by).orderBy(F.col(start), F.col(end).desc())
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("__new", F.when(F.col(start) < before, 0).otherwise(1))
    island = opened.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__island")


def last_before(df: DataFrame, events: DataFrame, by: list[str], at: str, value: str, name: str) -> DataFrame:
    """As-of join: for each row of df the value of the latest of events at or before it, by one sorted pass over both."""
    both = df.withColumn("__kind", F.lit(1)).withColumn(name, F.lit(None).cast(events.schema[value].dataType)).unionByName(events.select(*by, at, F.col(value).alias(name)).withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at, "__kind", name).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last(name, ignorenulls=True).over(w)).filter("__kind = 1").drop("__kind")


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of a rectangle, 0 if it is empty."""
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def overlap_share(a: str, b: str) -> Column:
    """Which part of the area of rectangle a lies in b; columns are a_x0, a_y0 and so on."""
    c = lambda p, k: F.col(f"{p}_{k}").cast("double")
    common = area(F.greatest(c(a, "x0"), c(b, "x0")), F.greatest(c(a, "y0"), c(b, "y0")), F.least(c(a, "x1"), c(b, "x1")), F.least(c(a, "y1"), c(b, "y1")))
    own = area(c(a, "x0"), c(a, "y0"), c(a, "x1"), c(a, "y1"))
    return F.when(own > 0, common / own).otherwise(0.0)


def inside(rects: DataFrame, regions: DataFrame, on: list[str], share: float = 0.8, anti: bool = False) -> DataFrame:
    """Rectangles (a_...) that lie to at least the share in some region (b_...) with the same keys, or with anti the others."""
    return rects.alias("a").join(regions.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on] + [overlap_share("a", "b") >= share], "left_anti" if anti else "left_semi")
