"""Contiguous, byte-balanced shards from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._session import cut, documents, others, shuffle_partitions


def shard_by_bytes(df: DataFrame, order: list[str], size: str, n_shards: int) -> DataFrame:
    """df with ``shard`` (0 to n_shards-1) and ``slot`` (0, 1, ... inside the shard), contiguous in the given order.

    The rows are dealt by range and sorted once; each partition gives its total of sizes and rows, the few
    totals are summed up to where each partition begins, and a row goes to the shard in whose equal part of all
    bytes its middle lies. So a shard is off its part by no more than the largest row, and no task holds more
    than one range, whatever key is frequent: rows equal in the whole order are told apart by a salt.

    Nulls in the order come first; a null size counts 0; rows that are equal in all columns keep their number
    and take neighbouring slots; an empty table gives none; other columns are carried along, but those that are named
    ``shard`` or ``slot``, or begin with ``__``, give way to the result's. Each row is written with the number of its partition, so
    places don't depend on how the result is read later.
    """
    spark = df.sparkSession
    parts = max(1, shuffle_partitions(spark))
    rest = others(df, "shard", "slot", keep=[*order, size])
    keys = [f"__o{i}" for i in range(len(order))]
    slim = df.select(*rest, *[F.col(c).alias(k) for c, k in zip(order, keys)], F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__size"), F.xxhash64(F.monotonically_increasing_id()).alias("__salt"))
    ranged = slim.repartitionByRange(parts, *keys, "__salt").sortWithinPartitions(*keys, "__salt")
    ordered = cut(ranged.select(*rest, "__size", F.spark_partition_id().alias("__part")))
    totals = ordered.groupBy("__part").agg(F.sum("__size").alias("bytes"), F.count("*").alias("rows")).orderBy("__part").collect()  # one row for each partition
    begins, at, rank = {}, 0, 0
    for t in totals:
        begins[t["__part"]] = (at, rank)
        at, rank = at + t["bytes"], rank + t["rows"]
    total = at

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, byte, row = None, 0, 0
        for batch in batches:
            part = batch.column("__part").to_numpy()
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(edges, edges[1:]):
                if b == a:
                    continue
                if part[a] != now:
                    now = part[a]
                    byte, row = begins[int(now)]
                some = batch.slice(a, b - a)
                sizes = some.column("__size").to_numpy()
                ends = byte + np.cumsum(sizes)
                twice = 2 * ends - sizes  # twice the middle; as Python's numbers where products may pass 64 bits
                if total * n_shards > 1 << 61:
                    shard = np.array([min(n_shards - 1, t * n_shards // (2 * total)) for t in twice.tolist()], np.int64)
                else:
                    shard = np.minimum(n_shards - 1, twice * n_shards // max(1, 2 * total))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in rest), pa.array(shard, pa.int32()), pa.array(row + np.arange(b - a), pa.int64())], [*rest, "__shard", "__rank"])
                byte, row = int(ends[-1]), row + b - a

    placed = ordered.mapInArrow(place, T.StructType([*(ordered.schema[c] for c in rest), T.StructField("__shard", T.IntegerType()), T.StructField("__rank", T.LongType())]))
    firsts = {r[0]: r[1] for r in placed.groupBy("__shard").agg(F.min("__rank")).collect()}  # n_shards rows at most
    base = F.create_map(*[F.lit(x) for k, v in firsts.items() for x in (k, v)])[F.col("__shard")] if firsts else F.lit(0)
    return placed.select(*rest, F.col("__shard").alias("shard"), (F.col("__rank") - base).cast("long").alias("slot"))


def op3(spark: SparkSession, sf_dir: str, n_shards: int = 24) -> DataFrame:
    """All documents in ascending doc_id order in 24 shards under the law ``bytes``."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    slim = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"))
    out = shard_by_bytes(slim, ["doc_id", "text_crc32", "size"], "size", n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL = r"""
WITH crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
  FROM documents
), c AS (
  SELECT doc_id, size::BIGINT AS size, xor(list_reduce([4294967295::BIGINT] || bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM d, crc
), s AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, sum(size) OVER ()::BIGINT AS total,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS n
  FROM c
), p AS (SELECT *, least(23, ((2 * upto - size) * 24) // (2 * total))::INTEGER AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (n - min(n) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM p
"""

QUERIES = {"op3_byte_shards": op3}
ORACLE_SQL = {"op3_byte_shards": SQL}
