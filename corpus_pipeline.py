"""A corpus pipeline: documents in, token ids out, each stage by one of the operators of sheaf.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import decontamination, jaccard_join, mixing, token_file, toxicity
from sheaf.llm._session import new_folder, remove


#: Columns that stages look at; all others are carried under names that no operator gives.
READ = ("doc_id", "text", "source")


def _aside(docs: DataFrame) -> tuple[DataFrame, list]:
    """(docs with all columns but those in READ renamed, expressions that name them back in their order)."""
    new = {c: c if c in READ else f"carried_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in new.items()]), [F.col(n).alias(c) for c, n in new.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain doesn't reject; it learns from the labelled ones among them. Null and empty texts, and all
    documents where there are no labels, stay; repeated rows get one verdict; an empty table gives none; columns keep names and values."""
    slim, back = _aside(docs)
    return toxicity.judge(slim, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter(~F.col("toxic")).select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of links: the one with the least id, null being the last. Each row is given an id of its
    own, written once, so rows that share a doc_id or have none are rows like all others."""
    folder = new_folder(spark, "pipeline-rows")
    docs.withColumn("__row", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    found = jaccard_join.components(rows, "__row").select("__row", "component_id").join(rows.select("__row", "doc_id"), "__row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first")
    kept = found.groupBy("component_id").agg(first).select(F.col("first.__row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Null and empty texts stay, repeated rows all go or stay, columns stay as they are."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Texts without words cost nothing and are taken by their source's epochs; a null source
    is one source; of equal rows as many are taken as fit; an empty table gives none; columns keep names and values."""
    slim, back = _aside(docs)
    mixed = mixing.mix_sources(mixing.sized(slim), "source", "size", "quality_weight", ["doc_id", "size"])
    return mixed.filter("repeats > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select(*back)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, written to a folder and read back: doc_id, start, n_tokens, ids_crc32. A null text is an empty one;
    each copy of a row is written; an empty table gives none."""
    folder = new_folder(spark, "pipeline-tokens")
    token_file.write_tokens(docs, folder)
    return token_file.read_tokens(spark, folder, digest=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", write_tokens),
]

#: SQL cannot express the models, the index search and the coder; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each stage's result is written as Parquet and read again, and the one before it is removed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        folder = new_folder(spark, "pipeline-stage")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove(spark, before)
        before = folder
    return docs
