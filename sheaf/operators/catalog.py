"""The document catalogue: last-writer-wins state, groups of editions, views, migration, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def accepted(events: DataFrame, key: str, stamp: str, arrival: str) -> DataFrame:
    """Events that were newer, when they arrived, than every accepted one before: those over the running maximum (0 at first)."""
    w = Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("__top", F.coalesce(F.max(stamp).over(w), F.lit(0))).filter(F.col(stamp) > F.col("__top")).drop("__top")


def reading_state(events: DataFrame, key: str, stamp: str, arrival: str, value: str, read: str, now: int, tolerance: int = 60_000) -> DataFrame:
    """Last-writer-wins state by key: the last accepted value and stamp, and the greatest ``read`` of accepted events only.
    Stamps outside 0 to now + tolerance are rejected first."""
    sane = events.filter(F.col(stamp).between(0, now + tolerance) & F.col(read).between(0, now + tolerance))
    return accepted(sane, key, stamp, arrival).groupBy(key).agg(F.max(stamp).alias("updated_at"), F.max_by(value, stamp).alias("reading"), F.max(read).alias("last_read"), F.count("*").alias("n_accepted"))


def revisions(edits: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Edits with a revision from 1 that grows only when the value really changes."""
    w = Window.partitionBy(key).orderBy(order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return edits.withColumn("__c", changed).withColumn("revision", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def editions(records: DataFrame, group: Column, order: list, available: str, key: str) -> DataFrame:
    """Groups of editions: size, representative (the first available one, else the first), whether all are unread."""
    w = Window.partitionBy("group_id").orderBy(*order)
    ranked = records.withColumn("group_id", group).withColumn("__r", F.row_number().over(w))
    return ranked.groupBy("group_id").agg(F.count("*").alias("n_versions"), F.coalesce(F.min_by(key, F.when(F.col(available), F.col("__r"))), F.min_by(key, "__r")).alias("representative"), F.bool_and("unread").alias("all_unread"))


def missing(records: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Records whose key isn't there yet; existing ones win."""
    return records.join(existing.select(key), key, "left_anti")


def roll_up(files: DataFrame, category: str, size: Column, known: list[str]) -> DataFrame:
    """Bytes and files by known category, and ``other``: what the total has beyond them, not below 0."""
    sums = files.groupBy(category).agg(F.sum(size).alias("bytes"), F.count("*").alias("files"))
    named = sums.filter(F.col(category).isin(known)).select(F.col(category).alias("category"), "bytes", "files")
    total = sums.agg(F.sum("bytes").alias("tb"), F.sum("files").alias("tf"))
    own = named.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("kb"), F.coalesce(F.sum("files"), F.lit(0)).alias("kf"))
    other = total.crossJoin(own).select(F.lit("other").alias("category"), F.greatest(F.col("tb") - F.col("kb"), F.lit(0)).alias("bytes"), F.greatest(F.col("tf") - F.col("kf"), F.lit(0)).alias("files"))  # one row each
    return named.unionByName(other)
