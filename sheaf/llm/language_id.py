"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._linear import char_grams
from ._session import documents, others
from ._text import Texts, group_sums, pieces

BITS = 15
SIZES = (1, 2, 3)
#: Rows of one language that the fit reads, in the mean; a language with fewer gives all.
SAMPLE = 3000
ALPHA = 0.5


def _counts(texts: Texts, row: np.ndarray, languages: int) -> np.ndarray:
    out = np.zeros((languages, len(SIZES) << BITS), np.int64)
    for k, size in enumerate(SIZES):
        bucket, n = char_grams(texts, size, BITS)
        key = np.repeat(row, n) * (1 << BITS) + bucket
        out[:, k << BITS : (k + 1) << BITS] += np.bincount(key, minlength=languages << BITS).reshape(languages, -1)
    return out


def fit_languages(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages in code point order, log probabilities by language and n-gram bucket, float32).

    The fit reads a bounded sample: of each language the rows whose key hash lies under ``sample`` of its rows,
    all if it has no more. Each task sends one count matrix (languages x 3 x 2**15) as sparse cells, which Spark sums.
    Rows with null text or language are not learned from; a table without any gives no languages.
    """
    known = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = known.groupBy(lang).count().collect()  # a row for each language
    names = sorted(r[0] for r in rows)
    if not names:
        return [], np.zeros((0, len(SIZES) << BITS), np.float32)
    share = F.create_map(*[F.lit(x) for r in rows for x in (r[0], min(1.0, sample / r[1]))])
    u = F.shiftrightunsigned(F.xxhash64(F.lit("lang-fit"), key), 11).cast("double") / float(1 << 53)
    number = F.create_map(*[F.lit(x) for i, s in enumerate(names) for x in (s, i)])
    chosen = known.filter(u < share[F.col(lang)]).select(F.col(text).alias("text"), number[F.col(lang)].alias("row"))
    languages = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((languages, len(SIZES) << BITS), np.int64)
        for batch in batches:
            for piece in pieces(batch):
                total += _counts(Texts(piece.column("text")), piece.column("row").to_numpy(), languages)
        r, c = np.nonzero(total)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(total[r, c])], ["r", "c", "n"])

    cells = chosen.mapInArrow(count, "r int, c int, n long").groupBy("r", "c").agg(F.sum("n").alias("n")).toPandas()  # at most languages x 3 x 2**15
    n = np.zeros((languages, len(SIZES) << BITS))
    n[cells["r"], cells["c"]] = cells["n"]
    table = np.empty_like(n, np.float32)
    for k in range(len(SIZES)):
        part = n[:, k << BITS : (k + 1) << BITS] + ALPHA
        table[:, k << BITS : (k + 1) << BITS] = np.log(part / part.sum(1, keepdims=True))
    return names, table


def predict_languages(df: DataFrame, names: list[str], table: np.ndarray, text: str = "text") -> DataFrame:
    """df without its text, with ``lang_pred`` and ``score`` (the posterior under equal priors, n-grams of a text
    tempered to the square root of their number so that it doesn't saturate).

    The whole text counts. ``und`` and score 0 if the text is null or without a letter, or if nothing was learned.
    Ties go to the first language in code point order. Every row is judged by its own text, so repeated rows get equal
    results; an empty table gives none. Other columns are carried along, but those that have a result's name, or begin with
    ``__``, give way to the result's.
    """
    spark = df.sparkSession
    held = spark.sparkContext.broadcast((names, table))  # languages x 3 x 2**15 floats
    keep = others(df.drop(text), "lang_pred", "score")
    named = df.select(*keep, F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("__text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = held.value
        for batch in batches:
            for piece in pieces(batch, "__text"):
                texts = Texts(piece.column("__text"))
                empty = np.asarray(piece.column("__text").is_null())
                total = np.zeros((len(names), texts.n))
                grams = np.zeros(texts.n, np.int64)
                for k, size in enumerate(SIZES):
                    bucket, n = char_grams(texts, size, BITS)
                    grams += n
                    for i in range(len(names)):
                        total[i] += group_sums(table[i, (k << BITS) + bucket].astype(np.float64), n)
                if len(names):
                    total -= total.max(0)
                    p = np.exp(total / np.sqrt(np.maximum(1, grams)))
                    p /= p.sum(0)
                    best = total.argmax(0)
                    said = np.array(names, object)[best]
                    score = p[best, np.arange(texts.n)]
                else:
                    said, score = np.full(texts.n, "und", object), np.zeros(texts.n)
                said[empty], score[empty] = "und", 0.0
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in keep], pa.array(said, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    schema = named.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return named.mapInArrow(predict, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32(doc_id) mod 4 is not 2."""
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = documents(spark, sf_dir, "doc_id", "text", "lang").withColumn("held_out", F.coalesce(out, F.lit(False)))
    names, table = fit_languages(docs.filter(~F.col("held_out")))
    return predict_languages(docs.drop("lang"), names, table).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op2_language_id": op2}
ORACLE_SQL: dict[str, str] = {}
