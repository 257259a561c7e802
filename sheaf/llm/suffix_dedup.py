"""Removal of byte strings that stand in an earlier document too, by two-stage suffix sorting.

What is searched are windows of ``SIZE`` bytes that a document with a smaller id has as well. Sorting all suffixes of
a corpus in one place cannot be done, so windows are first routed: of the 16-byte grams of a window the one with the
least hash (the last of equals) is its anchor. The anchor depends on nothing but the window's bytes, so equal windows have
equal anchors. Successive windows of one anchor are a unit; its string has at most 84 bytes.

1. Documents go into chunks of some MB, a bucketed table. Each chunk sends, for each distinct unit, the anchor's hash, a hash
   of the unit's string and the least document that has it, packed by part of the anchor's hash.
2. Each part answers by two bits for each unit: whether a smaller document has the very same unit (so all its windows
   are repeated, and the other document's unit stands for it from now on), or else whether another document has another
   unit with this anchor. Units with neither can share no window.
3. The strings of the units that share an anchor go to its part, where their suffixes are sorted: directly
   those that are smaller than their successors; the others are induced from them by scanning the buckets of
   first bytes in ascending order. Suffixes next to each other with a common prefix of SIZE bytes are equal windows; those
   of a document that isn't the least in its run are repeated.
4. Each chunk covers the repeated windows and removes what is covered.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._session import cut, documents, shared_dir, shuffle_partitions
from ._text import Texts, mix, pieces, released

SIZE, GRAM = 50, 16
SPAN = SIZE - GRAM + 1
#: Bytes of text of a chunk.
CHUNK_BYTES = 2 << 20
#: Bytes of text for which there is one part of all anchors: a part's task gets about as many.
PART_BYTES = 8 << 20
#: Places whose grams are hashed at a time.
TILE = 1 << 15
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9], np.uint64)


def _words(text: np.ndarray, more: int) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number, zeros after the end, and so for ``more`` positions beyond."""
    n = len(text) + more
    out = np.zeros(n + 8, np.uint64)
    out[: len(text)] = text
    for step in (1, 2, 4):
        out[:-step] = out[:-step] << np.uint64(8 * step) | out[step:]
    return out[:n]


def _by_number(x: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0 on, by 16 bits at a time."""
    order = np.argsort(x.astype(np.uint16), kind="stable")
    bits = 16
    while int(x.max()) >> bits:
        order = order[np.argsort((x[order] >> bits).astype(np.uint16), kind="stable")]
        bits += 16
    return order


def two_stage(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all suffixes of a byte array in ascending order of their first ``depth`` bytes (at least; equal ones in
    any order). A suffix that ends sorts before its continuations."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    # smaller than its successor: by the next differing byte; a run of equal bytes goes as its end does
    rise = np.zeros(n, bool)
    differs = np.flatnonzero(text[1:] != text[:-1])
    up = text[1:][differs] > text[:-1][differs]
    rise[: len(differs) and differs[-1] + 1] = np.repeat(up, np.diff(differs, prepend=-1))
    direct = np.flatnonzero(rise)
    eight = _words(text, depth + 16)
    words = -(-(depth + 8) // 8)
    order = np.arange(len(direct))
    group = np.zeros(len(direct), np.int64)  # of suffixes that are equal so far
    open_ = np.arange(len(direct))
    for k in range(words):  # by eight bytes at a time, only where the bytes before are equal
        if not len(open_):
            break
        key = eight[direct[order[open_]] + 8 * k]
        rank = np.argsort(key)
        if k:
            rank = rank[_by_number(group[open_][rank])]
        order[open_] = order[open_][rank]
        key, own = key[rank], group[open_]
        new = np.ones(len(open_), bool)
        new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        label = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        group[open_] = label
        last = np.ones(len(open_), bool)
        last[:-1] = new[1:]
        open_ = open_[~(new & last)]
    direct = direct[order]
    cuts = np.searchsorted(text[direct], np.arange(257))
    queued: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def pass_on(found: np.ndarray, here: int | None) -> np.ndarray:
        """Queues the predecessors that are greater than their successors; gives those of this very bucket."""
        before = found[found > 0] - 1
        before = before[~rise[before]]
        first = text[before]
        rank = np.argsort(first, kind="stable")
        before, first = before[rank], first[rank]
        edges = np.searchsorted(first, np.arange(257))
        for c in np.unique(first).tolist():
            if c != here:
                queued[c].append(before[edges[c] : edges[c + 1]])
        return before[edges[here] : edges[here + 1]] if here is not None else before[:0]

    end = np.array([n - 1])  # the last suffix has no successor: it is greater than the empty one
    queued[int(text[-1])].append(end)
    for c in range(256):
        fresh = np.concatenate(queued[c]) if queued[c] else np.zeros(0, np.int64)
        while len(fresh):  # successive equal bytes: each is induced by the next
            out.append(fresh)
            fresh = pass_on(fresh, c)
        sorted_ = direct[cuts[c] : cuts[c + 1]]
        if len(sorted_):
            out.append(sorted_)
            pass_on(sorted_, None)
    return np.concatenate(out)


def repeated_windows(strings: np.ndarray, lengths: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which of all positions of some strings on end begin a window of SIZE bytes inside one string that a string
    of a smaller owner has too."""
    n = len(strings)
    ends = np.cumsum(lengths)
    order = two_stage(strings, SIZE)
    which = np.repeat(np.arange(len(lengths)), lengths)
    left = ends[which] - np.arange(n)
    order = order[left[order] >= SIZE]
    flagged = np.zeros(n, bool)
    if len(order) < 2:
        return flagged
    same = np.ones(len(order) - 1, bool)
    eight = _words(strings, 0)
    for j in (*range(0, SIZE - 7, 8), SIZE - 8):  # common prefixes of neighbours, as long as any is left
        live = np.flatnonzero(same)
        if not len(live):
            return flagged
        same[live] = eight[order[live] + j] == eight[order[live + 1] + j]
    begin = np.flatnonzero(np.concatenate([[True], ~same]))
    own = owner[which[order]]
    least = np.minimum.reduceat(own, begin)
    flagged[order] = own > np.repeat(least, np.diff(np.append(begin, len(order))))
    return flagged


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, a view."""
    return np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), 0, (1,))


def _anchors(data: np.ndarray) -> np.ndarray:
    """Of the window that begins at each place, the least hash of its grams and the complement of that gram's place, by
    which the last of equal ones is least; a tile at a time, so that all that is held for it stays in the cache."""
    n = len(data) - SIZE + 1
    words = _eights(data)
    out, buffers = np.empty(n, np.uint64), np.empty((2, TILE + SPAN + 8), np.uint64)
    for a in range(0, n, TILE):
        b = min(n, a + TILE)
        k = b - a + SPAN - 1
        word = words[a : a + k + 8].copy()
        x, y = buffers[0, :k], buffers[1, :k]
        np.multiply(word[:k], _ODD[0], out=x)
        np.multiply(word[8:], _ODD[1], out=y)
        x ^= y
        np.right_shift(x, np.uint64(32), out=y)
        x ^= y
        x *= _ODD[2]
        x &= _HIGH
        x |= np.arange(int(_LOW) - a, int(_LOW) - a - k, -1).view(np.uint64)
        step = 1
        while 2 * step <= SPAN:
            k -= step
            np.minimum(x[:k], x[step : step + k], out=y[:k])
            x, y, step = y, x, 2 * step
        np.minimum(x[: b - a], x[SPAN - step : SPAN - step + b - a], out=out[a:b])
    return out


class Units:
    """Units of the windows of some texts: first window, last window, anchor hash, hash of anchor and string, text."""

    def __init__(self, texts: Texts):
        data, offsets = texts.data, texts.offsets
        n = len(data)
        lengths = np.diff(offsets)
        self.first = self.last = self.text = np.zeros(0, np.int64)
        self.anchor = self.string = np.zeros(0, np.uint64)
        if n < SIZE:
            return
        key = _anchors(data)
        long = lengths >= SIZE
        ok = np.zeros(len(key) + 1, np.int8)  # windows that lie in one text
        ok[offsets[:-1][long]] += 1
        ok[offsets[1:][long] - SIZE + 1] -= 1
        ok = np.cumsum(ok[:-1], dtype=np.int8).view(bool)
        goes_on = ok[1:] & ok[:-1] & (key[1:] == key[:-1])
        np.logical_not(goes_on, out=goes_on)
        edge = ok.copy()
        edge[1:] &= goes_on
        self.first = np.flatnonzero(edge)
        if not len(self.first):
            return
        ok[:-1] &= goes_on
        self.last = np.flatnonzero(ok)
        place = (key[self.first] & _LOW ^ _LOW).astype(np.int64)
        words = _eights(data)
        self.anchor = mix(words[place] + mix(words[place + 8] + np.uint64(1)))  # least hashes crowd together, this one doesn't
        self.string = mix(texts.short_hashes(self.first, self.last + SIZE) + (place - self.first).astype(np.uint64))
        self.text = np.searchsorted(offsets, self.first, "right") - 1


class _Chunk:
    """A chunk's texts and units, the same each time: rows in order of their number."""

    def __init__(self, table: pa.Table, parts: int):
        self.table = table.sort_by("rid").combine_chunks()
        self.texts = Texts(self.table.column("text"))
        self.doc = self.table.column("doc_id").fill_null(-(1 << 63)).to_numpy().astype(np.int64)
        units = self.units = Units(self.texts)
        owner = self.doc[units.text]
        order = np.argsort(units.string)
        new = np.ones(len(order), bool)
        a, s = units.anchor[order], units.string[order]
        new[1:] = s[1:] != s[:-1]
        if (a[1:] != a[:-1])[~new[1:]].any():
            order = np.lexsort((units.anchor, units.string))
            a = units.anchor[order]
            new[1:] |= a[1:] != a[:-1]
        begin, own = np.flatnonzero(new), owner[order]
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = group = np.cumsum(new) - 1
        least = np.minimum.reduceat(own, begin) if len(begin) else own
        self.rep = np.minimum.reduceat(np.where(own == least[group], order, len(order)), begin) if len(begin) else order  # one unit of each kind: of the least document
        self.later = owner > least[self.kind]
        part = (units.anchor[self.rep] % np.uint64(parts)).astype(np.int64)
        self.order = np.argsort(part, kind="stable")  # kinds as they are sent
        self.cuts = np.searchsorted(part[self.order], np.arange(parts + 1))
        self.owner = owner

    def kinds(self, answers: pa.Table, column: str) -> np.ndarray:
        """The parts' answers, a byte for each kind."""
        out = np.zeros(len(self.rep), np.uint8)
        for p, raw in zip(answers.column("p").to_pylist(), answers.column(column).to_pylist()):
            own = self.order[self.cuts[p] : self.cuts[p + 1]]
            out[own] = np.frombuffer(raw, np.uint8)
        return out


def _send_kinds(parts: int):
    def send(table: pa.Table) -> pa.Table:
        c = _Chunk(table, parts)
        chunk, rows = table.column("chunk")[0].as_py(), []
        for p in range(parts):
            own = c.rep[c.order[c.cuts[p] : c.cuts[p + 1]]]
            if len(own):
                s = c.units.string[own]
                rows.append((chunk, p, (c.units.anchor[own] >> np.uint64(32)).astype("<u4").tobytes(), (s & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), (s >> np.uint64(32)).astype("<u4").tobytes(), c.owner[own].astype("<i8").tobytes()))
        return pa.table({k: pa.array(v, t) for k, v, t in zip(_KINDS.names, zip(*rows) if rows else [()] * 6, _KINDS.types)})

    return send


_KINDS = pa.schema([("chunk", pa.int32()), ("p", pa.int32()), ("anchor", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("doc", pa.binary())])


def _answer(table: pa.Table) -> pa.Table:
    """For each kind: 1 if a smaller document has it, 2 if it is left and another document's kind that is left has its anchor."""
    get = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    anchors = get("anchor", "<u4")
    sizes = np.array([len(a) for a in anchors])
    anchor = np.concatenate(anchors)
    string = np.concatenate(get("low", "<u4")).astype(np.uint64) | np.concatenate(get("high", "<u4")).astype(np.uint64) << np.uint64(32)
    doc = np.concatenate(get("doc", "<i8"))
    order = np.lexsort((doc, string, anchor))
    a, s, d = anchor[order], string[order], doc[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    least = np.repeat(d[new], np.diff(np.append(np.flatnonzero(new), len(a))))
    said = (d > least).astype(np.uint8)
    left = np.flatnonzero(said == 0)
    la, ld = a[left], d[left]
    begin = np.flatnonzero(np.concatenate([[True], la[1:] != la[:-1]])) if len(la) else np.zeros(0, np.int64)
    if len(begin):
        n = np.diff(np.append(begin, len(la)))
        several = np.repeat(np.minimum.reduceat(ld, begin) != np.maximum.reduceat(ld, begin), n)
        said[left[several]] = 2
    out = np.empty(len(a), np.uint8)
    out[order] = said
    ends = np.cumsum(sizes)
    return pa.table({"chunk": table.column("chunk"), "p": table.column("p"), "said": pa.array([out[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())], pa.binary())})


def _send_strings(parts: int):
    def send(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if texts.num_rows:
            c = _Chunk(texts, parts)
            said, chunk = c.kinds(answers, "said"), texts.column("chunk")[0].as_py()
            for p in range(parts):
                kinds = c.order[c.cuts[p] : c.cuts[p + 1]]
                kinds = kinds[said[kinds] == 2]
                if len(kinds):
                    own = c.rep[kinds]
                    size = c.units.last[own] - c.units.first[own] + SIZE
                    ends = np.cumsum(size)
                    at = np.arange(int(ends[-1])) + np.repeat(c.units.first[own] - (ends - size), size)
                    rows.append((chunk, p, kinds.astype("<u4").tobytes(), c.owner[own].astype("<i8").tobytes(), size.astype("<u1").tobytes(), c.texts.data[at].tobytes()))
        return pa.table({k: pa.array(v, t) for k, v, t in zip(_STRINGS.names, zip(*rows) if rows else [()] * 6, _STRINGS.types)})

    return send


_STRINGS = pa.schema([("chunk", pa.int32()), ("p", pa.int32()), ("kinds", pa.binary()), ("doc", pa.binary()), ("size", pa.binary()), ("bytes", pa.binary())])


def _sort_strings(table: pa.Table) -> pa.Table:
    """Repeated windows of the kinds of a part: a byte for each window of each kind."""
    released()
    get = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    sizes, bytes_ = get("size", "<u1"), get("bytes", np.uint8)
    flagged = repeated_windows(np.concatenate(bytes_), np.concatenate(sizes).astype(np.int64), np.concatenate(get("doc", "<i8")))
    ends = np.cumsum([len(b) for b in bytes_])
    return pa.table({"chunk": table.column("chunk"), "kinds": table.column("kinds"), "size": table.column("size"), "flags": pa.array([np.packbits(flagged[e - len(b) : e]).tobytes() for e, b in zip(ends.tolist(), bytes_)], pa.binary())})


def _remove(parts: int, columns: list[str]):
    def remove(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _RESULT.empty_table()
        c = _Chunk(texts, parts)
        answers = answers.to_pylist()
        said = np.zeros(len(c.rep), np.uint8)
        n = len(c.texts.data)
        for r in answers:
            if r["said"] is not None:
                said[c.order[c.cuts[r["p"]] : c.cuts[r["p"] + 1]]] = np.frombuffer(r["said"], np.uint8)
        starts = np.zeros(n + 1, np.int8)  # windows from first to last, both included
        unit = np.flatnonzero(c.later | (said[c.kind] == 1))
        starts[c.units.first[unit]] += 1
        starts[c.units.last[unit] + 1] -= 1
        starts = np.cumsum(starts[:-1], dtype=np.int8).view(bool)
        hot = np.zeros(len(c.rep), bool)
        for r in answers:
            if r["said"] is None:
                kinds, size = np.frombuffer(r["kinds"], "<u4").astype(np.int64), np.frombuffer(r["size"], "<u1").astype(np.int64)
                flag = np.flatnonzero(np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=int(size.sum())))
                ends = np.cumsum(size)
                which = np.searchsorted(ends, flag, "right")
                starts[c.units.first[c.rep[kinds[which]]] + flag - (ends - size)[which]] = True
                hot[kinds[which]] = True
        for u in np.flatnonzero(hot[c.kind]).tolist():  # other units of the same kind and document
            of = int(c.rep[c.kind[u]])
            if u != of:
                a, b = int(c.units.first[of]), int(c.units.first[u])
                m = int(c.units.last[u]) - b + 1
                starts[b : b + m] |= starts[a : a + m]
        offsets, data = c.texts.offsets, c.texts.data
        edge = starts.copy()
        edge[1:] &= ~starts[:-1]
        first = np.flatnonzero(edge)
        edge = starts
        edge[:-1] &= ~edge[1:]
        end = np.flatnonzero(edge) + SIZE
        text = np.searchsorted(offsets, first, "right") - 1
        apart = np.ones(len(first), bool)
        apart[1:] = (first[1:] > end[:-1]) | (text[1:] != text[:-1])
        first, text = first[apart], text[apart]
        end = end[np.append(apart[1:], True)] if len(end) else end
        spans = np.bincount(text, minlength=c.texts.n)
        removed = np.bincount(text, end - first, c.texts.n).astype(np.int64)
        gone = np.zeros(n + 1, np.int8)
        gone[first] += 1
        gone[end] -= 1
        data = memoryview(data[~np.cumsum(gone[:-1], dtype=np.int8).view(bool)])
        cuts = (offsets - np.concatenate([[0], np.cumsum(removed)])).tolist()
        kept = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        sums = [hashlib.sha256(k).hexdigest() for k in kept]
        return pa.table([c.table.column("doc_id").cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans.astype(np.int64)), pa.array(sums, pa.string()), *([pa.array([k.tobytes() for k in kept], pa.binary())] if "kept" in columns else [])], names=columns)

    return remove


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document after removal of each byte that is covered
    by a string of SIZE bytes that also begins in a document with a smaller key.

    Texts are UTF-8 bytes; null ones are empty. Overlaps count, matches never cross documents, and strings are judged on
    the input. Rows with equal keys don't remove from each other; a null key is smaller than all others. An empty
    table gives no rows; other columns are left out. Chunks are drawn at random, so no key, copy or source can fill one.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, shuffle_partitions(spark), -(-total // PART_BYTES))
    chunks = max(1, shuffle_partitions(spark), -(-total // CHUNK_BYTES))
    name = f"sheaf_repeats_{uuid.uuid4().hex}"
    rows = slim.withColumn("rid", F.monotonically_increasing_id()).withColumn("chunk", F.pmod(F.xxhash64("rid"), F.lit(chunks)).cast("int"))
    rows.repartition(chunks, "chunk").write.bucketBy(chunks, "chunk").format("parquet").saveAsTable(name)
    try:
        table = spark.table(name)
        kinds = table.groupBy("chunk").applyInArrow(_send_kinds(parts), "chunk int, p int, anchor binary, low binary, high binary, doc binary")
        said = cut(kinds.groupBy("p").applyInArrow(_answer, "chunk int, p int, said binary"))
        strings = table.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(_send_strings(parts), "chunk int, p int, kinds binary, doc binary, size binary, bytes binary")
        flags = strings.groupBy("p").applyInArrow(_sort_strings, "chunk int, kinds binary, size binary, flags binary")
        answers = said.unionByName(flags, allowMissingColumns=True)
        result = table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_remove(parts, _RESULT.names), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        return cut(result)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-byte strings of earlier ones."""
    return remove_repeats(documents(spark, sf_dir, "doc_id", "text"))


SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS raw, hex(encode(coalesce(text, ''))) AS x FROM documents),
place AS (SELECT doc_id, x, octet_length(raw) AS n, unnest(range(greatest(0, octet_length(raw) - 49))) AS i FROM d),
win AS MATERIALIZED (SELECT doc_id, i, substr(x, (2 * i + 1)::BIGINT, 100) AS s FROM place),
first AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS MATERIALIZED (SELECT w.doc_id, w.i FROM win w JOIN first f ON f.s = w.s WHERE f.d < w.doc_id),
run AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 WHEN lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM hit),
grp AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM run),
span AS MATERIALIZED (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS b FROM grp GROUP BY doc_id, g),
kept AS (
  SELECT doc_id, a AS cut_a, b AS cut_b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_, a AS to_ FROM span
  UNION ALL SELECT doc_id, NULL, NULL, max(b), NULL FROM span GROUP BY doc_id
), rest AS (
  SELECT k.doc_id, string_agg(CASE WHEN to_ IS NULL THEN substr(x, (2 * from_ + 1)::BIGINT) ELSE substr(x, (2 * from_ + 1)::BIGINT, (2 * (to_ - from_))::BIGINT) END, '' ORDER BY from_) AS x, sum(cut_b - cut_a) AS removed, count(cut_a) AS spans
  FROM kept k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id
)
SELECT d.doc_id, octet_length(d.raw)::BIGINT AS n_bytes, coalesce(r.removed, 0)::BIGINT AS n_removed, coalesce(r.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(r.x, d.x))) AS kept_sha256
FROM d LEFT JOIN rest r ON r.doc_id = d.doc_id
"""

QUERIES = {"op10_suffix_dedup": op10}
ORACLE_SQL = {"op10_suffix_dedup": SQL}
