"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder
from ..streaming.reading import reading_state_stream
from .library import ORACLE_SQL as LIBRARY_SQL
from .library import NOW


def lww_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    e = e.select("user_id", "event_id", F.floor(F.col("value") * 100).cast("long").alias("stamp"), F.col("event_type").alias("reading"), (F.floor(F.col("value") * 100) + F.col("event_id") % 7).cast("long").alias("read"))
    place = f"{shared_folder(spark)}/reading-{uuid.uuid4().hex}"

    def upsert(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/states/batch={number}")  # a batch that is run again replaces its own

    query = reading_state_stream(e, NOW).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.parquet(f"{place}/states")
    return last.groupBy("user_id").agg(F.max("updated_at").alias("updated_at"), F.max_by("reading", "n_accepted").alias("reading"), F.max("last_read").alias("last_read"), F.max("n_accepted").alias("n_accepted")).filter("n_accepted > 0")


QUERIES = {"lww_stream": lww_stream}
ORACLE_SQL = {"lww_stream": LIBRARY_SQL["lww_reading_state"]}
