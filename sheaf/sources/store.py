"""The document store: a folder of JSON files by document hash, read and written by Spark alone.

``<hash>.pages.json`` has the extracted pages, ``<hash>.meta.json`` file name and outline, ``<hash>.json`` in ``library`` a record, in
``library/presentation`` a group's presentation, in ``cache`` the translations by key. Damaged files give a row that says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

BLOCK = "struct<id:int,bbox:array<double>,text:string,font:string,font_size:double,color:string,bold:boolean,italic:boolean,math:boolean,skip:boolean,display_math:boolean,translation_text:string,inline_math:array<struct<token:string,text:string>>,inline_styles:array<struct<token:string,bold:boolean,italic:boolean>>>"
PAGES = f"array<struct<page:int,width:double,height:double,rotation:int,blocks:array<{BLOCK}>,protected:array<array<double>>>>"
META = "struct<file_name:string,extract_ver:int,outline:array<array<string>>>"
RECORD = "struct<hash:string,title:string,file_name:string,page_count:double,imported_at:double,last_read:double,updated_at:double,work_id:string,reading:map<string,string>>"
PRESENTATION = "struct<display_title:string,archived:boolean,presentation_revision:int>"
CACHE = "map<string,array<string>>"


def _files(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    """(name, value, damaged) of the files in a folder whose names match; none if there is no folder."""
    try:
        raw = spark.read.option("wholetext", True).text(f"{folder}/{pattern}")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        raw = spark.createDataFrame([], "value string").withColumn("_metadata", F.struct(F.lit("").alias("file_name")))
    value = F.from_json("value", schema)
    rows = raw.select(F.col("_metadata.file_name").alias("file"), value.alias("value"))
    return rows.select(F.regexp_extract("file", r"^([^.]*)", 1).alias("name"), "value", F.col("value").isNull().alias("damaged"))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(hash, page, width, height, rotation, protected, block) of all documents' blocks; pages without a block give one row."""
    f = _files(spark, folder, "*.pages.json", PAGES)
    p = f.select(F.col("name").alias("hash"), F.explode("value").alias("p"))
    return p.select("hash", "p.page", "p.width", "p.height", "p.rotation", "p.protected", F.explode_outer("p.blocks").alias("block"))


def write_pages(pages: DataFrame, folder: str) -> None:
    """Pages (hash, page, width, height, rotation, protected, block) as JSON, a folder for each hash; Spark's committer shows a
    folder only when it is whole."""
    block = F.collect_list(F.when(F.col("block").isNotNull(), F.col("block")))
    one = pages.groupBy("hash", "page").agg(*[F.first(c).alias(c) for c in ("width", "height", "rotation", "protected")], F.array_sort(block, lambda a, b: a["id"] - b["id"]).alias("blocks"))
    one.write.mode("overwrite").partitionBy("hash").json(folder)


def read_meta(spark: SparkSession, folder: str) -> DataFrame:
    """(hash, file_name, extract_ver) of each document."""
    return _files(spark, folder, "*.meta.json", META).filter("not damaged").select(F.col("name").alias("hash"), "value.file_name", "value.extract_ver")


def read_outline(spark: SparkSession, folder: str) -> DataFrame:
    """(hash, no, level, title, page): entries that aren't a level, a title and a page are left out."""
    o = _files(spark, folder, "*.meta.json", META).select(F.col("name").alias("hash"), F.posexplode("value.outline").alias("no", "e"))
    number = lambda i: F.expr(f"try_cast(e[{i}] AS int)")
    return o.filter(F.size("e") >= 3).select("hash", "no", number(0).alias("level"), F.col("e")[1].alias("title"), number(2).alias("page")).filter("level is not null and page is not null")


def whole_record(r: Column, name: Column) -> Column:
    """Whether a record can be shown: its hash is its name, texts are there, numbers are finite and not negative."""
    numbers = F.lit(True)
    for c in ("page_count", "imported_at", "last_read", "updated_at"):
        numbers = numbers & F.coalesce((r[c] >= 0) & (r[c] < float("inf")), F.lit(False))
    return F.coalesce((r["hash"] == name) & r["title"].isNotNull() & r["file_name"].isNotNull() & numbers, F.lit(False))


def read_library(spark: SparkSession, folder: str, uploads: str) -> DataFrame:
    """(name, record, presentation, available, damaged): every record of the library with its group's presentation, if its file is there.
    A damaged presentation or record counts; a missing presentation is the default one."""
    records = _files(spark, f"{folder}/library", "*.json", RECORD).withColumn("damaged", ~whole_record(F.col("value"), F.col("name")))
    work = F.col("value.work_id")
    records = records.withColumn("group", F.when(F.coalesce(work, F.lit("")).rlike("^[0-9a-f]{64}$"), F.concat(F.lit("work-"), work)).otherwise(F.concat(F.lit("file-"), F.col("name"))))
    shown = _files(spark, f"{folder}/library/presentation", "*.json", PRESENTATION)
    p = F.col("presentation")
    good = p["display_title"].isNotNull() & p["archived"].isNotNull() & (p["presentation_revision"] >= 1)
    shown = shown.select(F.col("name").alias("group"), F.col("value").alias("presentation"), F.lit(True).alias("edited")).withColumn("spoiled", ~F.coalesce(good, F.lit(False)))
    files = file_stats(spark, uploads, "*.pdf").select(F.regexp_extract("name", r"^([^.]*)", 1).alias("name"), F.lit(True).alias("there"))
    default = F.struct(F.lit("").alias("display_title"), F.lit(False).alias("archived"), F.lit(0).alias("presentation_revision"))
    out = records.join(shown, "group", "left").join(files, "name", "left")
    use = F.when(F.col("edited") & ~F.col("spoiled"), p).otherwise(default)
    return out.select("name", F.col("value").alias("record"), use.alias("presentation"), F.coalesce("there", F.lit(False)).alias("available"), (F.col("damaged") | F.coalesce("spoiled", F.lit(False))).alias("damaged"))


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """(hash, key, partial, values) of the translations; unreadable caches are empty."""
    c = _files(spark, f"{folder}/cache", "*.json", CACHE).filter("not damaged").select(F.col("name").alias("hash"), F.explode("value").alias("k", "values"))
    return c.select("hash", F.regexp_replace("k", r"^partial\|", "").alias("key"), F.col("k").startswith("partial|").alias("partial"), "values")


def cached_pages(cache: DataFrame, keys: DataFrame, counts: DataFrame) -> DataFrame:
    """(hash, page, values): what is cached of each page under its key (hash, page, key), the complete entry before the partial one,
    if it has as many values as the page has blocks (hash, page, blocks)."""
    c = cache.join(keys, ["hash", "key"]).groupBy("hash", "page").agg(F.min_by("values", "partial").alias("values"))
    return c.join(counts, ["hash", "page"]).filter(F.size("values") == F.col("blocks")).select("hash", "page", "values")


def file_stats(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(name, bytes) of the files under a folder, without reading them; none if there is no folder."""
    try:
        f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], "name string, bytes long")
    return f.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("bytes"))


def storage(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, files, bytes): papers, extracted pages and meta, translations, records, and all else."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.col("path")
    kind = F.when(path.rlike(r"/cache/[^/]*\.json$"), "translations").when(path.rlike(r"/library/.*\.json$"), "records").when(path.rlike(r"\.(pages|meta)\.json$"), "extracted").when(path.endswith(".pdf"), "papers").otherwise("other")
    return f.groupBy(kind.alias("kind")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
