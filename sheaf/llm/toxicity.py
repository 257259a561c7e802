"""Toxicity: a chain of linear classifiers, each of which sees what the earlier ones said."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._labels import labelled_sample
from ._linear import Rows, fit_logistic, fit_platt, folds, sigmoid
from ._session import documents, others
from ._text import Texts, mix, owners, pieces

#: Bits of a hashed feature: so many that words of a large corpus hardly ever share one.
BITS = 40
#: A word gives itself, and its first bytes of these numbers if it is longer (its stem).
STEMS = (4, 5, 6)
#: Buckets that a model looks at: those whose presence differs most between the classes.
FEATURES = 1000
#: How many standard errors that difference must be.
SURE = 4.5
#: Labelled rows of either toxicity that the fit reads, in the mean.
SAMPLE = 2500
FOLDS = 4
THRESHOLD = 0.4


class Link(NamedTuple):
    """One classifier of the chain: its buckets, their weights, the weights of the earlier categories' log odds, the intercept and the calibration."""

    buckets: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    intercept: float
    slope: float
    offset: float


def _presence(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features of all words and stems, the text of each)."""
    starts, ends, counts = texts.words(plain=True)
    owner, found, who = owners(counts), [texts.hashes(starts, ends)], [owners(counts)]
    for size in STEMS:
        longer = ends - starts > size
        found.append(texts.hashes(starts[longer], starts[longer] + size) + np.uint64(size))
        who.append(owner[longer])
    return np.concatenate(found) >> np.uint64(64 - BITS), np.concatenate(who)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            texts = Texts(piece.column("text"), lower=True)
            feature, owner = _presence(texts)
            order = np.lexsort((feature, owner))
            feature, owner = feature[order], owner[order]
            new = np.ones(len(owner), bool)
            new[1:] = (feature[1:] != feature[:-1]) | (owner[1:] != owner[:-1])
            bucket, n = feature[new].astype(np.int64), np.bincount(owner[new], minlength=texts.n)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("ys"), pa.ListArray.from_arrays(offsets, pa.array(bucket, pa.int64()))], ["doc_id", "ys", "index"])


def _choose(x: Rows, y: np.ndarray, most: int = FEATURES) -> np.ndarray:
    """Buckets by how surely their presence tells the classes apart (difference of shares over its standard error)."""
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    names, column = np.unique(x.index, return_inverse=True)
    in1 = np.bincount(column, y[x.owner], minlength=len(names))
    both = np.bincount(column, minlength=len(names))
    share = (both + 1) / (n1 + n0 + 2)
    z = np.abs(in1 / n1 - (both - in1) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    z[both < 4] = 0
    order = np.argsort(-z, kind="stable")[:most]
    return np.sort(names[order[z[order] > SURE]])


def _places(feature: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Place of each feature among the sorted buckets, -1 if it is none of them."""
    if not len(buckets):
        return np.full(len(feature), -1)
    near = np.zeros(1 << 16, bool)
    near[buckets.astype(np.int64) & 0xFFFF] = True
    out = np.full(len(feature), -1)
    maybe = np.flatnonzero(near[feature.astype(np.int64) & 0xFFFF])
    at = np.minimum(np.searchsorted(buckets, feature[maybe]), len(buckets) - 1)
    same = buckets[at] == feature[maybe]
    out[maybe[same]] = at[same]
    return out


def _one_of_each(x: Rows) -> np.ndarray:
    """One row of each group of copies (rows whose six least-hash buckets agree), so that a text copied often
    doesn't make all its words look telling."""
    if not len(x.index):
        return np.arange(len(x.counts)) < 1
    filled = np.flatnonzero(x.counts)
    begins = (np.cumsum(x.counts) - x.counts)[filled]
    sketch = np.zeros((len(x.counts), 6), np.uint64)
    for k in range(6):
        sketch[filled, k] = np.minimum.reduceat(mix(x.index.astype(np.uint64) + np.uint64((k + 1) << 40)), begins)
    _, first = np.unique(sketch, axis=0, return_index=True)
    keep = np.zeros(len(x.counts), bool)
    keep[first] = True
    return keep


def _narrow(x: Rows, buckets: np.ndarray, earlier: np.ndarray) -> Rows:
    """Columns of x for the chosen buckets, then one for each earlier category."""
    found = _places(x.index, buckets)
    inner = found >= 0
    n, k = earlier.shape
    owner = np.concatenate([x.owner[inner], np.repeat(np.arange(n), k)])
    index = np.concatenate([found[inner], np.tile(np.arange(k) + len(buckets), n)])
    value = np.concatenate([np.ones(inner.sum()), earlier.ravel()])
    order = np.argsort(owner, kind="stable")
    return Rows(index[order], value[order], np.bincount(owner, minlength=n))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 4


def _fit_link(x: Rows, y: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    buckets = _choose(x, y)
    w, b = fit_logistic(_narrow(x, buckets, earlier), y, len(buckets) + earlier.shape[1], l2=3e-4, steps=200)
    return buckets, w, b


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], by: str, sample: int = SAMPLE) -> dict[str, Link | None]:
    """A classifier for each category in the given order, fitted on a bounded sample of labelled documents.

    Each is fitted with the log odds of the earlier categories as further features. In training these come
    from models of the other folds, as they will from unseen texts later. A category that has one class
    only in the sample is left out; without labels the chain is empty."""
    rows = labelled_sample(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), labels, by, sample, "toxicity-fit")
    rows = rows.select("doc_id", "text", F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in categories.values()]).alias("ys"))
    table = rows.mapInArrow(_rows, "doc_id long, ys array<double>, index array<long>").toArrow()
    if not table.num_rows:
        return dict.fromkeys(categories)
    table = table.sort_by("doc_id").combine_chunks()
    index = table.column("index").combine_chunks()
    counts = np.diff(index.offsets.to_numpy())
    flat = index.flatten().to_numpy().astype(np.int64)
    x = Rows(flat, np.ones(len(flat)), counts)
    ys = np.array(table.column("ys").to_pylist())
    fold = folds(table.column("doc_id").to_numpy(), FOLDS)
    one = _one_of_each(x)
    x, ys, fold = x.take(one), ys[one], fold[one]
    earlier, chain = np.zeros((len(ys), 0)), {}
    for k, name in enumerate(categories):
        y = (ys[:, k] > 0).astype(float)
        if len(set(y)) < 2:
            chain[name] = None
            continue
        out = np.zeros(len(y))
        for f in range(FOLDS):
            train = fold != f
            if len(set(y[train])) < 2 or train.all():
                continue
            buckets, w, b = _fit_link(x.take(train), y[train], earlier[train])
            out[~train] = _narrow(x.take(~train), buckets, earlier[~train]).times(w) + b
        slope, offset = fit_platt(out, y)
        buckets, w, b = _fit_link(x, y, earlier)
        chain[name] = Link(buckets, w[: len(buckets)], w[len(buckets) :], b, slope, offset)
        earlier = np.column_stack([earlier, _log_odds(sigmoid(slope * out + offset))])
    return chain


def score_chain(df: DataFrame, chain: dict[str, Link | None], verdict: str, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """df with ``p_<category>`` for each link of the chain, and ``toxic``: whether the verdict category's probability reaches the threshold.

    Whole texts count. A null or empty text, and any text if the verdict's link is missing, has no evidence: it is
    not toxic; the probability of a missing link is null.
    Repeated rows get equal verdicts; an empty table gives none; other columns are carried along, the text among them, but
    those that have a result's name, or begin with ``__``, give way to the result's."""
    held = df.sparkSession.sparkContext.broadcast(chain)  # FEATURES weights a link
    names = others(df, *[f"p_{c}" for c in chain], "toxic")
    read = text if text in names else "__text"
    df = df.select(*names, *([] if text in names else [F.col(text).alias("__text")]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = held.value
        for batch in batches:
            for piece in pieces(batch, read):
                texts = Texts(piece.column(read), lower=True)
                feature, owner = _presence(texts)
                feature = feature.astype(np.int64)
                earlier, said = np.zeros((texts.n, 0)), {c: None for c in chain}
                for name, link in chain.items():
                    if not link:
                        continue
                    found = _places(feature, link.buckets)
                    inner = found >= 0
                    key = np.unique(owner[inner] * len(link.buckets) + found[inner])
                    z = np.bincount(key // max(1, len(link.buckets)), link.weights[key % max(1, len(link.buckets))], minlength=texts.n) + earlier @ link.earlier + link.intercept
                    p = sigmoid(link.slope * z + link.offset)
                    said[name] = p
                    earlier = np.column_stack([earlier, _log_odds(p)])
                toxic = np.zeros(texts.n, bool) if said.get(verdict) is None else (said[verdict] >= threshold) & (np.bincount(owner, minlength=texts.n) > 0)
                shown = [pa.nulls(texts.n, pa.float64()) if p is None else pa.array(p) for p in said.values()]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), *shown, pa.array(toxic)], [*names, *[f"p_{c}" for c in chain], "toxic"])

    schema = T.StructType([df.schema[c] for c in names])
    for c in chain:
        schema = schema.add(f"p_{c}", "double")
    return df.mapInArrow(score, schema.add("toxic", "boolean"))


def label_categories() -> dict[str, Column]:
    """The chain of the label table: low quality, then toxic, then both."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1, "toxic_low_quality": (F.col("toxic") == 1) & (F.col("quality") == 0)}


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    chain = fit_chain(docs.select("doc_id", "text"), labels.select("doc_id", "quality", "toxic"), label_categories(), "toxic")
    return score_chain(docs, chain, "toxic")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: the chain's probabilities and the verdict."""
    return judge(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")


QUERIES = {"op9_toxicity": op9}
ORACLE_SQL: dict[str, str] = {}
