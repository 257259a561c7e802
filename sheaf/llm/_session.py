"""What every operator here needs of the session: the shared folder, and cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a new one, but only if all
    run in this one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="sheaf-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there, in the same partitions."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """(df written to the shared folder as Parquet and read from there, the folder)."""
    folder = new_folder(df.sparkSession, "round")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner find plans that nothing refers to any more, so that it removes their shuffle files now and
    not when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def n_words(text):
    """Number of words: runs of characters other than ASCII white space (space, tab to carriage return)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def others(df: DataFrame, *results: str, keep: list[str] | tuple[str, ...] = ()) -> list[str]:
    """Columns of df that an operator carries along: all but those that have a result's name or begin with ``__``, which
    give way to the operator's own. Columns in ``keep`` stay unless a result has their name. Names are compared as Spark does."""
    taken = {r.lower() for r in results}
    return [c for c in df.columns if c.lower() not in taken and (not c.startswith("__") or c in keep)]
