"""Benchmark decontamination: a BM25 index of test items that every passage of every document is searched in.

Each document is cut into overlapping passages of words; each passage is a query. The index is inverted: terms to the
units (whole items, or stretches of long ones) that have them, units in blocks, each term with its greatest
impact in all units and in each block. Search goes as in block-max WAND, for many passages at once: of a passage's
terms in ascending order of greatest impact, those whose impacts together stay below the threshold cannot
by themselves lift a unit over it, so only the blocks of the others are candidates; a candidate block is left
if its block maxima cannot reach the threshold; only what remains is scored exactly. Impacts are divided by
the unit's own full score, so that a threshold says which part of a unit's score a passage must reach. What is retrieved
is verified: so many of the word trigrams of the item's question, and of its answer, must stand in the document's passages.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._session import documents
from ._text import Texts, owners, pieces, windows

K1, B = 1.2, 0.75
#: Words of a unit at most; longer items are indexed in stretches.
UNIT = 128
#: Units of a block.
BLOCK = 8
#: Part of a unit's own score that a passage must reach, and part of the trigrams of question and answer that must be found.
SCORE, OVERLAP = 0.6, 0.5
#: Bytes of items that one index holds. A larger benchmark is searched index by index.
INDEX_BYTES = 8 << 20
#: Cells up to which a sparse matrix is held dense.
DENSE = 1 << 23


class Index(NamedTuple):
    ids: list  # item ids
    terms: np.ndarray  # word hashes, ascending
    rank: np.ndarray  # of each of them: its place by ascending greatest impact
    most: np.ndarray  # by rank: greatest impact
    block_at: np.ndarray  # by rank: where its blocks begin in blocks
    blocks: np.ndarray
    block_max: object  # looked up by (rank, block)
    impact: object  # looked up by (rank, unit)
    n_units: int
    item_of: np.ndarray  # by unit
    stride: int  # words
    question: list  # by item: (size, hashes of its runs of so many words)
    answer: list


class Cells:
    """A sparse matrix for look-ups, dense if small."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, columns: int):
        self.columns = columns
        if rows * columns <= DENSE:
            self.dense = np.zeros(rows * columns)
            self.dense[row * columns + column] = value
        else:
            self.dense = None
            key = row * columns + column
            order = np.argsort(key)
            self.key, self.value = key[order], value[order]

    def get(self, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        key = row * self.columns + column
        if self.dense is not None:
            return self.dense[key]
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.value[at], 0.0)


def _answer_start(text: str) -> int:
    """Where an item's answer begins: its last line, else its last sentence, else its last quarter."""
    body = text.rstrip()
    at = body.rfind("\n")
    if at <= 0:
        at = max(body.rfind(". ", 0, max(0, len(body) - 2)), body.rfind("? "))
    return at + 1 if at > 0 else 3 * len(body) // 4


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    return windows(hashes, np.array([len(hashes)]), size)[0]


def _short(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """(size, distinct runs of words) of a question or answer: trigrams, or all of it if it is shorter."""
    size = min(3, len(hashes))
    return size, np.unique(_grams(hashes, size))


class Statistics(NamedTuple):
    """What BM25 needs to know of all items: distinct terms in ascending order, how many units have each, the number of units,
    their mean length, and the longest one's."""

    terms: np.ndarray
    df: np.ndarray
    n_units: int
    mean: float
    longest: int


def _units(items: list[tuple], unit: int) -> tuple[list, list[np.ndarray], list[int], list, list]:
    """(ids, units, item of each unit, question runs, answer runs) of the items that have a word."""
    items = [(i, t) for i, t in items if t and t.strip()]
    texts = Texts(pa.array([t for _, t in items], pa.large_string()), lower=True)
    starts, ends, counts = texts.words(plain=True)
    hashes = texts.hashes(starts, ends)
    ids = [i for (i, _), h in zip(items, counts > 0) if h]
    at, units, of, question, answer = 0, [], [], [], []
    for (_, text), n, begin in zip(items, counts.tolist(), texts.offsets[:-1].tolist()):
        if not n:
            continue
        own = hashes[at : at + n]
        cut = int(np.searchsorted(starts[at : at + n], begin + len(text[: _answer_start(text)].encode())))
        cut = min(max(cut, 1), n) if n > 1 else n
        question.append(_short(own[:cut]))
        answer.append(_short(own[cut:] if cut < n else own))
        k = -(-n // unit)
        for j in range(k):
            units.append(own[j * n // k : (j + 1) * n // k])
            of.append(len(question) - 1)
        at += n
    return ids, units, of, question, answer


def survey(blocks: Iterable[list[tuple]], unit: int = UNIT) -> Statistics:
    """Statistics of all blocks of items together; the driver holds 16 bytes for each distinct word of the items."""
    terms, df, n, total, longest = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0, 0
    for block in blocks:
        units = _units(block, unit)[1]
        if not units:
            continue
        found, times = np.unique(np.concatenate([np.unique(u) for u in units]), return_counts=True)
        both = np.unique(np.concatenate([terms, found]))
        count = np.zeros(len(both), np.int64)
        count[np.searchsorted(both, terms)] += df
        count[np.searchsorted(both, found)] += times
        terms, df = both, count
        n, total, longest = n + len(units), total + sum(map(len, units)), max(longest, max(map(len, units)))
    return Statistics(terms, df, n, total / max(1, n), longest)


def build_index(items: list[tuple], unit: int = UNIT, known: Statistics | None = None) -> Index | None:
    """The index of (id, text) items by the statistics of all items (these ones alone if none are given), so that scores and
    passages don't depend on which items share an index. Items without a word are left out; None if none is left."""
    ids, units, of, question, answer = _units(items, unit)
    if not ids:
        return None
    known = known or survey([items], unit)
    lengths = np.array([len(u) for u in units])
    terms = np.unique(np.concatenate(units))
    unit_of = np.repeat(np.arange(len(units)), lengths)
    cell, tf = np.unique(np.searchsorted(terms, np.concatenate(units)) * len(units) + unit_of, return_counts=True)
    term, unit_no = cell // len(units), cell % len(units)
    df = known.df[np.searchsorted(known.terms, terms)]
    idf = np.log1p((known.n_units - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[unit_no] / known.mean))
    impact /= np.bincount(unit_no, impact, minlength=len(units))[unit_no]
    most = np.zeros(len(terms))
    np.maximum.at(most, term, impact)
    order = np.argsort(most, kind="stable")
    rank = np.empty(len(terms), np.int64)
    rank[order] = np.arange(len(terms))
    n_blocks = -(-len(units) // BLOCK)
    pair, place = np.unique(rank[term] * n_blocks + unit_no // BLOCK, return_inverse=True)
    top = np.zeros(len(pair))
    np.maximum.at(top, place, impact)
    block_at = np.searchsorted(pair, np.arange(len(terms) + 1) * n_blocks)
    return Index(ids, terms, rank, most[order], block_at, pair % n_blocks, Cells(pair // n_blocks, pair % n_blocks, top, len(terms), n_blocks), Cells(rank[term], unit_no, impact, len(terms), n_blocks * BLOCK), len(units), np.array(of), known.longest, question, answer)


def _expand(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, position) of all positions of some ranges."""
    n = end - begin
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)


def retrieve(index: Index, hashes: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All (passage's first word, its end, unit, score) with a score of at least threshold, for the words of some texts."""
    none = np.zeros(0, np.int64)
    s = index.stride
    low = (index.terms & np.uint64(0xFFFF)).astype(np.int64)
    near = np.zeros(1 << 16, bool)
    near[low] = True
    maybe = np.flatnonzero(near[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(index.terms, hashes[maybe]), len(index.terms) - 1)
    hit = index.terms[at] == hashes[maybe]
    word, rank = maybe[hit], index.rank[at[hit]]
    if not len(word):
        return none, none, none, np.zeros(0)
    # passages of 2s words begin at every s-th word of a text; each word is in one or two of them
    base = np.cumsum(counts) - counts
    per = np.maximum(1, -(-counts // s))
    first = np.cumsum(per) - per
    owner = owners(counts)[word]
    step = (word - base[owner]) // s
    earlier = step > 0
    passage = np.concatenate([first[owner] + step, (first[owner] + step - 1)[earlier]])
    key = np.unique(passage * len(index.most) + np.concatenate([rank, rank[earlier]]))
    passage, rank = key // len(index.most), key % len(index.most)  # terms of a passage by ascending greatest impact
    gain = np.cumsum(index.most[rank])
    starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    before = np.repeat(np.concatenate([[0.0], gain[starts[1:] - 1]]), np.diff(np.append(starts, len(passage))))
    essential = np.flatnonzero(gain - before >= threshold - 1e-9)
    if not len(essential):
        return none, none, none, np.zeros(0)
    which, place = _expand(index.block_at[rank[essential]], index.block_at[rank[essential] + 1])
    n_blocks = -(-index.n_units // BLOCK)
    candidate = np.unique(passage[essential][which] * n_blocks + index.blocks[place])
    found_p, found_u, found_s = [], [], []
    begin_of, end_of = np.searchsorted(passage, np.arange(per.sum())), np.searchsorted(passage, np.arange(per.sum()), "right")
    for part in np.array_split(candidate, max(1, len(candidate) // 20_000)):
        p, b = part // n_blocks, part % n_blocks
        which, place = _expand(begin_of[p], end_of[p])
        bound = np.bincount(which, index.block_max.get(rank[place], b[which]), minlength=len(p))
        live = bound >= threshold - 1e-9
        p, b = np.repeat(p[live], BLOCK), (b[live][:, None] * BLOCK + np.arange(BLOCK)).ravel()
        which, place = _expand(begin_of[p], end_of[p])
        score = np.bincount(which, index.impact.get(rank[place], b[which]), minlength=len(p))
        over = score >= threshold - 1e-9
        found_p.append(p[over]), found_u.append(b[over]), found_s.append(score[over])
    p, u, score = np.concatenate(found_p), np.concatenate(found_u), np.concatenate(found_s)
    text = np.searchsorted(first, p, "right") - 1
    begin = base[text] + (p - first[text]) * s
    return begin, np.minimum(begin + 2 * s, base[text] + counts[text]), u, score


def matches(index: Index, column: pa.Array, threshold: float = SCORE, overlap: float = OVERLAP) -> list[tuple[int, int, float, float, float]]:
    """Verified (row, item number, best score, question overlap, answer overlap) of a column of texts."""
    texts = Texts(column, lower=True)
    starts, ends, counts = texts.words(plain=True)
    hashes = texts.hashes(starts, ends)
    begin, end, unit, score = retrieve(index, hashes, counts, threshold)
    if not len(begin):
        return []
    base = np.cumsum(counts) - counts
    row = np.searchsorted(base, begin, "right") - 1
    item = index.item_of[unit]
    out = []
    order = np.lexsort((begin, item, row))
    cuts = np.flatnonzero((np.diff(row[order]) != 0) | (np.diff(item[order]) != 0)) + 1
    for part in np.split(order, cuts):
        r, t = int(row[part[0]]), int(item[part[0]])
        stop = base[r] + counts[r]
        spans = [hashes[max(base[r], a - index.stride) : min(stop, b + index.stride)] for a, b in {(int(begin[i]), int(end[i])) for i in part}]
        q, a = (float(np.isin(grams, np.concatenate([_grams(x, size) for x in spans])).mean()) for size, grams in (index.question[t], index.answer[t]))
        if q >= overlap and a >= overlap:
            out.append((r, t, float(score[part].max()), q, a))
    return out


def item_blocks(items: DataFrame, key: str, text: str, limit: int = INDEX_BYTES) -> Iterator[list[tuple]]:
    """The items in lists of about limit bytes, streamed to the driver in ascending order of key."""
    block, size = [], 0
    for r in items.select(key, text).orderBy(key).toLocalIterator():
        block.append((r[0], r[1]))
        size += len((r[1] or "").encode())
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", threshold: float = SCORE, overlap: float = OVERLAP) -> DataFrame:
    """(doc key, item key, score, question_overlap, answer_overlap, contaminated) of all verified pairs.

    Every passage of every whole document is searched in all items; the index of a block of at most about
    ``INDEX_BYTES`` of items is broadcast, a larger benchmark takes several passes. Null or empty texts, of documents
    or items, match nothing. Equal items and repeated documents give each their own pairs; null keys are given as they are.
    No items: no rows. Other columns of either table are left out, whatever their names; where both keys have one name, the
    item's is called ``item_`` and that name.
    """
    spark = docs.sparkSession
    if item_key.lower() == doc_key.lower():
        items, item_key = items.withColumnRenamed(item_key, f"item_{item_key}"), f"item_{item_key}"
    known = survey(item_blocks(items, item_key, text))
    schema = T.StructType([T.StructField(doc_key, docs.schema[doc_key].dataType), T.StructField(item_key, items.schema[item_key].dataType)]).add("score", "double").add("question_overlap", "double").add("answer_overlap", "double").add("contaminated", "boolean")
    out = None
    for block in item_blocks(items, item_key, text):
        index = build_index(block, known=known)
        if index is None:
            continue
        held = spark.sparkContext.broadcast(index)  # of INDEX_BYTES of text

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                for piece in pieces(batch, text):
                    rows = matches(index, piece.column(text), threshold, overlap)
                    if rows:
                        r, t, s, q, a = zip(*rows)
                        yield pa.RecordBatch.from_arrays([piece.column(doc_key).take(pa.array(r)), pa.array([index.ids[i] for i in t]), pa.array(s), pa.array(q), pa.array(a), pa.array([True] * len(r))], schema.names)

        found = docs.select(doc_key, text).mapInArrow(find, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame, item_key: str = "item_id", text: str = "text", threshold: float = SCORE, overlap: float = OVERLAP) -> DataFrame:
    """docs without those that ``search`` finds an item in. All columns, rows without a text and repeated rows stay as they are."""
    spark, names = docs.sparkSession, docs.columns
    known = survey(item_blocks(items, item_key, text))
    for block in item_blocks(items, item_key, text):
        index = build_index(block, known=known)
        if index is None:
            continue
        held = spark.sparkContext.broadcast(index)  # of INDEX_BYTES of text

        def clean(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in pieces(batch, text):
                    keep = np.ones(piece.num_rows, bool)
                    keep[[m[0] for m in matches(held.value, piece.column(text), threshold, overlap)]] = False
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in piece.columns], names)

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document searched for all benchmark items."""
    return search(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op7_decontamination": op7}
ORACLE_SQL: dict[str, str] = {}
