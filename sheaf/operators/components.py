"""Connected components of edge tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import shared_folder


def _cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read from there, so that the planner knows its real size (a
    checkpoint would hand down an estimate that is squared every round)."""
    folder = f"{shared_folder(df.sparkSession)}/components-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def grid_edges(cells: DataFrame, row: str, column: str, key: str, gap: int) -> DataFrame:
    """Edges between successive cells of a row, and of a column, whose distance is at most the gap."""
    out = None
    for line, place in ((row, column), (column, row)):
        w = Window.partitionBy(line).orderBy(place, key)
        near = cells.select(F.col(key).alias("a"), F.lead(key).over(w).alias("b"), (F.lead(place).over(w) - F.col(place)).alias("d")).filter(F.col("d") <= gap).select("a", "b")
        out = near if out is None else out.unionByName(near)
    return out


def components(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, component): the least key that edges (a, b) between nodes reach. Alternating steps join each node's greater
    neighbours, then its lesser ones, to the least neighbour, so that roots are hooked too, until a round leaves the
    edges as they were; there is no bound on the rounds. Partial minima are taken before each shuffle, and lineage
    is cut at every round."""
    current = _cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    held = None
    while True:
        least = current.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
        large = current.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        current = _cut(small.filter("u <> v").distinct())
        mark = current.agg(F.count("*").alias("n"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)").alias("x")).first()
        if held == mark:
            break
        held = mark
    root = current.groupBy(F.col("u").alias(key)).agg(F.min("v").alias("root"))
    return nodes.select(key).join(root, key, "left").select(key, F.coalesce("root", key).alias("component"))
