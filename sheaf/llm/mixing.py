"""Mixing sources to target weights by weighted sampling without replacement, in whole epochs and a rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._session import cut, documents, n_words, others

#: Key buckets to each doubling of the sampling key; only the bucket of a source that holds its budget's edge is sorted.
FINE = 256
#: Sources up to which the plan is broadcast (some 100 bytes each); beyond, rows are joined to it by shuffles.
FEW_SOURCES = 50_000
OUT = ("source_size", "target", "sampling_key", "repeats", "taken")


def quality_weight(text: Column, words: Column) -> Column:
    """1 for plain prose, less the more of ``#*$%&|<>`` and ``!!`` stands among the words; over 0."""
    marks = F.regexp_count(text, F.lit(r"[#*$%&|<>]|!!")).cast("double")
    return F.when(words > 0, 1.0 / (1.0 + 10.0 * marks / words)).otherwise(F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): words that each source should give.

    Sources in code point order, null last, take weights in turn; all share ``share`` of all words; a source stops at
    ``most`` times its own, and what it leaves is shared anew by weight until none is above. In ascending order of size by
    weight the sources that stop are the first ones, so running sums find where that ends. One row for each source
    is sorted in one task."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weighed = sizes.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int")))
    fill = Window.orderBy(F.col("source_size") / F.col("__w"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    run = weighed.select("*", (F.sum("source_size").over(Window.partitionBy()) * share - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most).alias("__left"), F.sum("__w").over(after).alias("__open"))
    run = run.withColumn("__open_here", F.col("__left") * F.col("__w") / F.col("__open") <= F.col("source_size") * most)
    first = F.min(F.when(F.col("__open_here"), F.struct(F.col("source_size") / F.col("__w"), F.col("source").isNull(), F.col("source"), F.col("__left").alias("l"), F.col("__open").alias("o")))).over(Window.partitionBy())
    run = run.withColumn("__at", first).withColumn("__level", F.max(F.col("__open_here")).over(before))
    own = F.col("__at.l") * F.col("__w") / F.col("__at.o")
    return run.select("source", "source_size", F.when(F.col("__open_here") | F.coalesce("__level", F.lit(False)), own).otherwise(F.col("source_size") * most).cast("double").alias("target"))


def _with_plan(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """rows (with ``__s``) joined to the plan (with ``__source``), each source's row to all of its rows."""
    return rows.join(F.broadcast(plan) if few else plan, F.col("__s").eqNullSafe(F.col("__source")))


def mix_sources(df: DataFrame, source: str, size: str, weight: str, order: list[str], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix-1") -> DataFrame:
    """df with ``source_size``, ``target``, ``sampling_key``, ``repeats`` and ``taken`` (size times repeats).

    Each source gives ``floor(target / source_size)`` whole epochs of all its rows first; the rest of its target
    is filled in ascending order of the Efraimidis-Spirakis key ``-ln(u) / weight``, u being a uniform hash (MD5) of the
    seed and the order columns, so that reruns agree. Rows are taken while their middle lies inside the budget:
    the words taken are off the target by half of one row at most.

    The prefix sums are not made by one task for a source: rows are counted by source and key bucket, the few
    sums of buckets tell which bucket holds the budget's edge, and only that bucket's rows are summed up in order, a row
    for all that are equal in key, order columns and size. Of these equal rows as many are taken as fit, numbered by
    partition. A source, or a group of equal rows, may hold any share of all rows. Up to ``FEW_SOURCES``
    sources the plan is broadcast; beyond that it is joined by shuffles.

    Null or empty texts have size 0 and are taken 0 words; null sources are one source, the last; null weights count 1; an
    empty table gives none; other columns are carried along, but those that have a result's name, or begin with ``__``,
    give way to the result's.
    """
    rest = others(df, *OUT, keep=[source, size, weight, *order])
    filled = F.coalesce(F.col(size), F.lit(0)).cast("long")
    names = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order])
    u = (F.conv(F.substring(F.md5(names.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    key = -F.log(u) / F.greatest(F.coalesce(F.col(weight), F.lit(1.0)), F.lit(1e-6))
    keyed = df.select(*[F.col(c) for c in rest], F.col(source).alias("__s"), filled.alias("__size"), key.alias("__key"), F.struct(key.alias("k"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], filled.alias("n")).alias("__place"))
    keyed = keyed.withColumn("__bucket", F.floor(F.log2("__key") * FINE).cast("int"))
    slim = cut(keyed.groupBy("__s", "__bucket", "__place").agg(F.count("*").alias("__times")))
    here = F.col("__place.n") * F.col("__times")
    buckets = cut(slim.groupBy("__s", "__bucket").agg(F.sum(here).alias("__words")))
    sizes = buckets.groupBy(F.col("__s").alias("source")).agg(F.sum("__words").alias("source_size"))
    plan = source_targets(sizes, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.select(F.col("source").alias("__source"), "source_size", "target", epochs.alias("__epochs"))
    plan = cut(plan.withColumn("__rest", F.col("target") - F.col("source_size") * F.col("__epochs")))
    few = plan.count() <= FEW_SOURCES
    before = Window.partitionBy("__s").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        _with_plan(buckets.withColumn("__before", F.coalesce(F.sum("__words").over(before), F.lit(0))), plan.select("__source", "__rest"), few)
        .filter((F.col("__before") < F.col("__rest")) & (F.col("__before") + F.col("__words") >= F.col("__rest")))
        .select("__source", F.col("__bucket").alias("__edge"), "__before", "__rest")
    )  # a row for each source at most
    w = Window.partitionBy("__s").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    within = _with_plan(slim, edges, few).filter("__bucket = __edge").withColumn("__from", F.coalesce(F.sum(here).over(w), F.lit(0)) + F.col("__before"))
    # of rows of n words from a place on, the i-th one's middle is from + (i - 1/2) n
    fit = F.when(F.col("__place.n") > 0, F.ceil((F.col("__rest") - F.col("__from")) / F.col("__place.n") - 0.5)).when(F.col("__from") < F.col("__rest"), F.col("__times")).otherwise(0)
    within = within.withColumn("__fit", F.least(F.greatest(fit, F.lit(0)), F.col("__times")))
    last = within.groupBy(F.col("__source").alias("__s")).agg(F.first("__edge").alias("__edge"), F.max(F.when(F.col("__fit") > 0, F.struct("__place", "__fit", "__times"))).alias("__last"))
    plan = cut(plan.join(last, F.col("__source").eqNullSafe(F.col("__s")), "left").drop("__s"))
    known = _with_plan(keyed, plan, few)
    first, at = F.col("__bucket") < F.col("__edge"), F.col("__bucket") == F.col("__edge")
    whole = first | (at & (F.col("__place") < F.col("__last.__place"))) | (at & (F.col("__place") == F.col("__last.__place")) & (F.col("__last.__fit") == F.col("__last.__times")))
    split = F.coalesce(at & (F.col("__place") == F.col("__last.__place")) & (F.col("__last.__fit") < F.col("__last.__times")), F.lit(False))
    clear = known.filter(~split).withColumn("__more", F.coalesce(whole, F.lit(False)).cast("long"))
    tied = plan.filter("__last.__fit < __last.__times").limit(1).count()
    if tied:  # equal rows of which only some fit: numbered by partition, so that none has to hold them all
        equal = cut(known.filter(split).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()))
        counts = equal.groupBy("__source", "__part").agg(F.count("*").alias("__n"))
        counts = counts.withColumn("__base", F.sum("__n").over(Window.partitionBy("__source").orderBy("__part")) - F.col("__n")).select(F.col("__source").alias("__t"), F.col("__part").alias("__u"), "__base")
        numbered = equal.withColumn("__i", F.row_number().over(Window.partitionBy("__source", "__part").orderBy("__id")))
        numbered = numbered.join(counts, F.col("__source").eqNullSafe(F.col("__t")) & (F.col("__part") == F.col("__u")))
        clear = clear.unionByName(numbered.withColumn("__more", (F.col("__i") + F.col("__base") <= F.col("__last.__fit")).cast("long")).select(*clear.columns))
    repeats = (F.col("__epochs") + F.col("__more")).cast("long")
    return clear.select(*[F.col("__size").alias(c) if c == size else F.col(c) for c in rest], "source_size", "target", F.col("__key").alias("sampling_key"), repeats.alias("repeats"), (F.col("__size") * repeats).alias("taken"))


def sized(docs: DataFrame) -> DataFrame:
    """docs with ``size`` in words and ``quality_weight``."""
    return docs.withColumn("size", n_words(F.col("text"))).withColumn("quality_weight", quality_weight(F.coalesce(F.col("text"), F.lit("")), F.col("size")))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to 150 % of their words with source weights 3, 1, 2."""
    slim = sized(documents(spark, sf_dir, "doc_id", "source", "text")).drop("text")
    out = mix_sources(slim, "source", "size", "quality_weight", ["doc_id", "size"])
    return out.select("doc_id", "size", "source_size", "target", "taken", F.col("repeats").cast("int").alias("repeats"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]|!!'))::DOUBLE AS marks
  FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS w FROM s),
f AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER before, 0) * 2.0::DOUBLE AS remaining, sum(w) OVER later AS open, row_number() OVER (ORDER BY source_size / w, source IS NULL, source) AS n
  FROM w
  WINDOW before AS (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         later AS (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), cutoff AS (SELECT remaining, open, n FROM f WHERE remaining * w / open <= source_size * 2.0::DOUBLE ORDER BY n LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN f.n >= cutoff.n THEN cutoff.remaining * w / cutoff.open ELSE source_size * 2.0::DOUBLE END::DOUBLE AS target
  FROM f LEFT JOIN cutoff ON true
), p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
k AS (
  SELECT doc_id, source, size, -ln((('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || size), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
    / greatest(CASE WHEN size > 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + 10.0::DOUBLE * marks / size) ELSE 1.0::DOUBLE END, 0.000001::DOUBLE) AS key
  FROM d
), r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle FROM k)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN middle < target - source_size * epochs THEN 1 ELSE 0 END))::BIGINT AS taken,
  (epochs + CASE WHEN middle < target - source_size * epochs THEN 1 ELSE 0 END)::INTEGER AS repeats
FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source
"""

QUERIES = {"op1_mix_sources": op1}
ORACLE_SQL = {"op1_mix_sources": SQL}
