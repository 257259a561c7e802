"""Token ids of documents in files: context-mixed, range-coded segments in ascending document order.

The format is a folder of Parquet files. A row is a segment, a run of whole documents of about ``SEGMENT`` ids
together (or one longer document):

* ``part``, ``segment``: its place; parts, then segments, follow each other in ascending document key;
* ``before``: ids in the part's earlier segments; ``n_tokens``: ids in this one;
* ``doc_ids``, ``lengths``: the documents and how many ids each has, its end id included;
* ``block``, ``header``, ``block_bytes``, ``block_crc``, ``payload``: the code (see ``_coder``).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _coder
from ._session import documents, new_folder, shuffle_partitions
from ._text import Texts, pieces, released
from ._tokens import Pieces, default_path

SEGMENT = 2 << 20
SCHEMA = "part int, segment int, before long, n_tokens long, doc_ids array<long>, lengths array<long>, block int, header binary, block_bytes binary, block_crc binary, payload binary"


def _ids_of(texts: Texts, memory: Pieces, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts on end, each with the end id; ids per text)."""
    found, counts = memory.encode(texts)
    out = np.full(len(found) + texts.n, end, np.int64)
    to = np.repeat(np.arange(texts.n), counts)
    to += np.arange(len(found))
    out[to] = found
    return out, counts + 1


def write_tokens(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, end: int = 0) -> None:
    """Encodes every whole text, appends the end id, and writes the ids in ascending order of key (nulls first, then ties by text).

    Documents are dealt by ranges of the key; a salt parts rows whose key and text are equal, so no value can fill
    one task. A null text counts as empty: its only id is the end id. Repeated rows are written as often as they occur. An
    empty table gives a folder without segments. Executors write through Spark's committer to the shared folder.
    """
    path = path or default_path()
    spark = docs.sparkSession
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim = slim.withColumn("h", F.xxhash64("text")).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    ordered = slim.repartitionByRange(max(1, shuffle_partitions(spark)), "doc_id", "h", "salt").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, before = TaskContext.get().partitionId(), 0, 0
        memory = Pieces(path)
        held, docs_, lengths, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held, docs_, lengths, size, number, before
            ids = np.concatenate(held)
            code = _coder.encode(ids)
            row = {"part": part, "segment": number, "before": before, "n_tokens": len(ids), "doc_ids": [x for d in docs_ for x in d], "lengths": np.concatenate(lengths).tolist(), **code}
            number, before = number + 1, before + len(ids)
            held, docs_, lengths, size = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for piece in pieces(batch):
                ids, counts = _ids_of(Texts(piece.column("text")), memory, end)
                if size and size + len(ids) > SEGMENT:
                    yield flush()
                held.append(ids)
                docs_.append(piece.column("doc_id").to_pylist())
                lengths.append(counts)
                size += len(ids)
        if size:
            yield flush()
        released()

    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("block", pa.int32()), ("header", pa.binary()), ("block_bytes", pa.binary()), ("block_crc", pa.binary()), ("payload", pa.binary())])
    rows = ordered.mapInArrow(segments, SCHEMA)
    rows.write.mode("overwrite").option("compression", "none").option("parquet.block.size", str(16 << 20)).option("parquet.page.size.row.check.min", "1").parquet(folder)


def read_tokens(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """The documents of a folder: doc_id, start (ids of all documents before it), n_tokens, and either ``ids`` or, with
    digest, ``ids_crc32`` (unsigned, of the ids as little-endian 32-bit integers). A damaged block fails the read."""
    files = spark.read.schema(SCHEMA).parquet(folder)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each part
    begins, at = {}, 0
    for r in totals:
        begins[r["part"]] = at
        at += r["n"]

    def documents_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i] for c in batch.schema.names}
                n, lengths = r["n_tokens"].as_py(), r["lengths"].values.to_numpy().astype(np.int64)
                ids = _coder.decode(n, r["block"].as_py(), *(r[c].as_py() for c in ("header", "block_bytes", "block_crc", "payload")))
                ends = np.cumsum(lengths)
                start = begins[r["part"].as_py()] + r["before"].as_py() + ends - lengths
                if digest:
                    raw, cuts = memoryview(ids).cast("B"), (4 * np.concatenate([[0], ends])).tolist()
                    last = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])], pa.int64())
                    yield pa.RecordBatch.from_arrays([r["doc_ids"].values, pa.array(start), pa.array(lengths), last], ["doc_id", "start", "n_tokens", "ids_crc32"])
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([r["doc_ids"].values, pa.array(start), pa.array(lengths), last], ["doc_id", "start", "n_tokens", "ids"])
                del ids
                released()

    return files.mapInArrow(documents_, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids by byte_bpe_50k.json, written and read back."""
    folder = new_folder(spark, "tokens")
    write_tokens(documents(spark, sf_dir, "doc_id", "text"), folder)
    return read_tokens(spark, folder, digest=True)


QUERIES = {"op6_token_file": op6}
ORACLE_SQL: dict[str, str] = {}
