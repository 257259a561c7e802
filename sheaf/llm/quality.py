"""Quality rules: counts on whole texts, and a calibrated logistic regression on hashed words, pairs of words and runs of three characters."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._labels import labelled_sample
from ._linear import Rows, char_grams, fit_logistic, fit_platt, folds, sigmoid, text_means
from ._session import documents, others
from ._text import Texts, group_sums, owners, pieces, repeats, windows

WORD_BITS, CHAR_BITS, GRAM = 13, 13, 3
WIDTH = 2 * (1 << WORD_BITS) + (1 << CHAR_BITS)
#: Labelled rows of either quality that the fit reads, in the mean.
SAMPLE = 1500
THRESHOLD = 0.5
SCALE = 30.0
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_POINT = np.ones(256, np.int64)  # a code point's first byte
_POINT[0x80:0xC0] = 0


class Model(NamedTuple):
    weights: np.ndarray
    intercept: float
    slope: float
    offset: float


def _features(texts: Texts, words: tuple) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, how many each text has) of words, pairs of successive words, and runs of characters."""
    starts, ends, counts = words
    hashes = texts.hashes(starts, ends)
    pair, _ = windows(hashes, counts, 2)
    gram, n = char_grams(texts, GRAM, CHAR_BITS)
    word, pair = ((h >> np.uint64(64 - WORD_BITS)).astype(np.int64) for h in (hashes, pair))
    return [(word, counts), (pair + (1 << WORD_BITS), np.maximum(0, counts - 1)), (gram + (2 << WORD_BITS), n)]


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's features as (index, value): shares of its words, its pairs and its grams, times SCALE."""
    for batch in batches:
        for piece in pieces(batch):
            texts = Texts(piece.column("text"))
            index, value, counts = [], [], []
            parts = [np.split(bucket, np.cumsum(n)[:-1]) for bucket, n in _features(texts, texts.words())]
            for own in zip(*parts):
                held = 0
                for part in own:
                    found, times = np.unique(part, return_counts=True)
                    index.append(found)
                    value.append(times * (SCALE / max(1, len(part))))
                    held += len(found)
                counts.append(held)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("y"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(index), pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(value), pa.float32()))],
                ["doc_id", "y", "index", "value"],
            )


def gather(table: pa.Table) -> tuple[np.ndarray, np.ndarray, Rows]:
    """(ids, labels, matrix) of collected training rows, in ascending order of id."""
    table = table.sort_by("doc_id").combine_chunks()
    index = table.column("index").combine_chunks() if table.num_rows else None
    if index is None:
        return np.zeros(0, np.int64), np.zeros(0), Rows(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
    value = table.column("value").combine_chunks()
    counts = np.diff(index.offsets.to_numpy())
    return table.column("doc_id").to_numpy(), table.column("y").to_numpy().astype(float), Rows(index.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy().astype(np.float64), counts)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of ``labels.quality`` (1 good) on a bounded sample of labelled documents, calibrated on the scores
    that three folds get from models of the others. None unless both labels occur."""
    rows = labelled_sample(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), labels.select("doc_id", "quality"), "quality", sample, "quality-fit")
    rows = rows.select("doc_id", "text", F.col("quality").cast("double").alias("y"))
    ids, y, x = gather(rows.mapInArrow(_training_rows, "doc_id long, y double, index array<int>, value array<float>").toArrow())
    if len(set(y > 0)) < 2:
        return None
    y = (y > 0).astype(float)
    fold, out = folds(ids, 3), np.zeros(len(y))
    for k in range(3):
        train = fold != k
        if len(set(y[train])) == 2 and not train.all():
            w, b = fit_logistic(x.take(train), y[train], WIDTH, steps=80)
            out[~train] = x.take(~train).times(w) + b
    w, b = fit_logistic(x, y, WIDTH, steps=80)
    return Model(w, b, *fit_platt(out, y))


def base_counts(texts: Texts, words: tuple) -> dict[str, np.ndarray]:
    """The counts of whole texts on which the base rules rest."""
    starts, ends, counts = words
    hashes = texts.hashes(starts, ends)
    points = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(_POINT[texts.data], out=points[1:])
    word_chars = group_sums(points[ends] - points[starts], counts)
    line_starts, line_ends, line_counts = texts.lines()
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    owner = owners(line_counts)
    _, again = repeats(texts.hashes(line_starts[has_word], line_ends[has_word]), owner[has_word])
    dup_lines = np.bincount(owner[has_word][again], minlength=texts.n)
    window, at = windows(hashes, counts, 8)
    owner = owners(counts)
    twice, _ = repeats(window, owner[at])
    change = np.zeros(len(hashes) + 9, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + 8, -1)
    covered = np.cumsum(change)[: len(hashes)] > 0
    return {"n_words": counts, "word_chars": word_chars, "n_symbols": texts.sums(_SYMBOL), "n_dup_lines": dup_lines, "n_repeat_words": np.bincount(owner[covered], minlength=texts.n)}


def score_quality(df: DataFrame, model: Model | None, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """df without its text, with the base counts, ``base_failed``, ``quality`` (calibrated probability) and ``kept``.

    ``base_failed``: fewer than 20 words, or more than 30 % of the words in repeated 8-word windows; such a text
    is not kept. A null or empty text has no words and fails. Without a model the probability is 1 and the base rules
    decide alone. Every row is judged by its own text alone, so repeated rows get equal verdicts; an empty table gives none.
    Other columns are carried along, but those that have a result's name, or begin with ``__``, give way to the result's.
    """
    held = df.sparkSession.sparkContext.broadcast(model)  # WIDTH weights
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keep = others(df.drop(text), *longs, "base_failed", "quality", "kept")
    named = df.select(*keep, F.col(text).alias("__text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for piece in pieces(batch, "__text"):
                texts = Texts(piece.column("__text"))
                words = texts.words()
                base = base_counts(texts, words)
                p = np.ones(texts.n)
                if model:
                    z = SCALE * sum(text_means(model.weights[bucket], n) for bucket, n in _features(texts, words)) + model.intercept
                    p = sigmoid(model.slope * z + model.offset)
                failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
                arrays = [*[piece.column(c) for c in keep], *[pa.array(base[c].astype(np.int64)) for c in longs], pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
                yield pa.RecordBatch.from_arrays(arrays, [*keep, *longs, "base_failed", "quality", "kept"])

    schema = named.select(*keep).schema
    for c in longs:
        schema = schema.add(c, "long")
    return named.mapInArrow(score, schema.add("base_failed", "boolean").add("quality", "double").add("kept", "boolean"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the quality verdict on every document."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model)


QUERIES = {"op4_quality_rules": op4}
ORACLE_SQL: dict[str, str] = {}
