"""Weighted statistics: means, majorities, modes, the three medians, one-dimensional clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def weighted_mean(value: Column, weight: Column, default: float = 10.0) -> Column:
    """Sum of value times weight over the sum of weights; a null value counts as the default."""
    return F.sum(F.coalesce(value, F.lit(default).cast("decimal(3,1)")) * weight).cast("double") / F.sum(weight).cast("double")


def weighted_majority(flag: Column, weight: Column) -> Column:
    """Whether more than half of the weight has the flag."""
    return F.coalesce(F.sum(F.when(flag, weight)), F.lit(0)) * 2 > F.sum(weight)


def weighted_mode(df: DataFrame, by: list[str], value: str, weight: str, ordinal: str) -> DataFrame:
    """For each group the value with the most weight; of equals the one seen first."""
    sums = df.groupBy(*by, value).agg(F.sum(weight).alias("__w"), F.min(ordinal).alias("__first"))
    return sums.groupBy(*by).agg(F.max_by(value, F.struct("__w", -F.col("__first"))).alias("mode"))


def upper_median(value: str) -> Column:
    """The element at place n div 2 of the sorted values (the upper one of an even number). Aggregates partially by distinct value."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str, upper: bool) -> DataFrame:
    """The first value whose cumulative weight is at least (upper: over) half of the group's. Weights of equal values are added before any window."""
    sums = df.groupBy(*by, value).agg(F.sum(weight).alias("__w"))
    along, whole = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    total = sums.withColumn("__c", F.sum("__w").over(along)).withColumn("__t", F.sum("__w").over(whole))
    reached = F.col("__c") * 2 > F.col("__t") if upper else F.col("__c") * 2 >= F.col("__t")
    return total.filter(reached).groupBy(*by).agg(F.min(value).alias("median"))


def clusters(df: DataFrame, by: list[str], value: Column, order: list[str], tolerance: float, name: str = "cluster") -> DataFrame:
    """Single-linkage clusters of sorted values: a new one begins where the gap to the value before exceeds the tolerance."""
    w = Window.partitionBy(*by).orderBy(*order)
    opened = df.withColumn("__v", value).withColumn("__new", (F.col("__v") - F.lag("__v").over(w) > tolerance).cast("int"))
    return opened.withColumn(name, F.coalesce(F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("long")).drop("__v", "__new")
