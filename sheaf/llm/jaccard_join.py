"""Exact Jaccard self-join of shingle sets by universe partition, and its connected components.

Two sets of sizes r <= s with similarity t or more differ in at most ``(r + s)(1 - t)/(1 + t)`` elements. Hashing parts
the universe of elements into segments; if the segments' thresholds add up to more than that, then in some segment the
sets differ in fewer elements than its threshold (pigeonhole). A segment with threshold 1 is indexed by its
subset; one with threshold 2 also by the subset's one-deletion neighbourhood. How many of either kind a band of sizes
gets is chosen by cost. Contents of less than two elements are not indexed, as they are shared by chance: a set whose
remaining thresholds still add up to enough is safe without them, and a pair is found if one of its two sets is safe; the
few sets that are not index these contents too. Candidates are verified on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._session import cut, documents, new_folder, remove, shuffle_partitions, tidy, written
from ._text import Texts, mix, pieces, windows

SHINGLE = 5
#: Similarity as a fraction: a pair links when DEN * shared >= NUM * united.
NUM, DEN = 80, 100
#: Ratio of a band's greatest size to the next lower band's.
BAND = 1.25
#: Least bits of the parity vector by which pairs of a shared content are compared before their sets are.
PARITY = 2048
#: Elements up to which a segment's content is light: not indexed by safe sets.
LIGHT = 1
#: Shingles of all documents for which there is one part of all signatures.
PART = 8 << 20
#: Documents, and signatures, of a chunk that leaves a task together.
CHUNK, SIGNATURES = 8192, 2 << 20


def element_sets(texts: Texts, size: int = SHINGLE) -> list[np.ndarray]:
    """Ascending distinct hashes of each text's word shingles; of fewer words the whole sequence is one."""
    starts, ends, counts = texts.words()
    hashes = texts.hashes(starts, ends)
    shingle, at = windows(hashes, counts, size)
    word_ends = np.cumsum(counts)
    cuts = np.searchsorted(at, word_ends)
    begin = np.concatenate([[0], cuts[:-1]])
    out = []
    for i, (a, b, n, e) in enumerate(zip(begin.tolist(), cuts.tolist(), counts.tolist(), word_ends.tolist())):
        if n >= size:
            out.append(np.unique(shingle[a:b]))
        elif n:
            out.append(windows(hashes[e - n : e], np.array([n]), n)[0] + np.uint64(n))
        else:
            out.append(shingle[:0])
    return out


def node_of(elements: np.ndarray) -> int:
    """Fingerprint of a set: equal sets are one node."""
    return int(mix(np.array([mix(elements + np.uint64(0x1234567)).sum() + np.uint64(len(elements))], np.uint64)).view(np.int64)[0])


def most_different(r: int, s: int) -> int:
    """Elements in which sets of these sizes can differ and still link: the greatest d with shared = (r+s-d)/2."""
    return (r + s) * (DEN - NUM) // (DEN + NUM)


@lru_cache(maxsize=None)
def band_top(band: int) -> int:
    top = 1
    for _ in range(band):
        top = max(top + 1, int(top * BAND))
    return top


@lru_cache(maxsize=None)
def band_of(size: int) -> int:
    band = 0
    while band_top(band) < size:
        band += 1
    return band


@lru_cache(maxsize=None)
def allocation(band: int) -> tuple[int, int]:
    """(segments with threshold 1, segments with threshold 2) of a band.

    Of all that add up to what the band needs and some to spare, the ones with the least cost: signatures of a set of
    the greatest size, and the chance that its empty contents use up what is spare times a set's price for that."""
    top = band_top(band)
    need = most_different(top, top) + 1
    best = None
    for twos in {0, 1, 2, 3, need // 2, (need + 1) // 2}:
        for spare in range(0, 12 + need // 4):
            ones = need + spare - 2 * twos
            if ones < 0 or ones + twos == 0:
                continue
            share = top / (ones + 2 * twos)
            lost = ones * math.exp(-share) * (1 + share) + twos * math.exp(-2 * share) * (2 + 4 * share + 2 * share * share)
            over = 0.5 * math.erfc((spare + 0.5 - lost) / math.sqrt(2 * (lost + 1e-9))) if lost > 1e-6 and top > 1 else 0.0
            if ones + twos == 1:
                over = 0.0
            cost = ones + twos * (1 + 2 * share) + over * 200
            if best is None or cost < best[0]:
                best = (cost, ones, twos)
    return best[1], best[2]


def signatures(elements: np.ndarray) -> np.ndarray:
    """All signatures of a set: for its own band, and for the higher bands that hold sets it may link with."""
    n, out = len(elements), []
    weight = mix(elements ^ np.uint64(0x5851F42D4C957F2D))
    for band in range(band_of(n), band_of(n * DEN // NUM) + 1):
        ones, twos = allocation(band)
        width, segments = ones + 2 * twos, ones + twos
        unit = (((elements >> np.uint64(32)) * np.uint64(width)) >> np.uint64(32)).astype(np.int64)
        segment = np.where(unit < ones, unit, ones + (unit - ones) // 2)
        size = np.bincount(segment, minlength=segments)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(weight, out=total[1:])
        end = np.cumsum(size)
        content = total[end] - total[end - size]
        salt = mix(np.uint64(band << 32) + np.arange(segments, dtype=np.uint64))
        strength = np.clip(size - LIGHT, 0, np.where(np.arange(segments) < ones, 1, 2))
        safe = strength.sum() > most_different(n, min(band_top(band), n * DEN // NUM))
        shown = size > LIGHT if safe else size >= 0
        out.append(mix(content[shown] + salt[shown]))
        if twos:
            wide = segment >= ones
            if safe:
                wide &= size[segment] > LIGHT + 1
            out.append(mix(content[segment[wide]] - weight[wide] + salt[segment[wide]]))
    return np.unique(np.concatenate(out))


def parity(elements: np.ndarray) -> bytes:
    """A bit for each class of elements: whether the set has an odd number of it. Two vectors differ in no more bits than
    the sets in elements. There are PARITY classes, doubled until they are as many as elements; a longer vector's
    halves can be folded onto each other by exclusive or."""
    bits = PARITY
    while bits < len(elements):
        bits *= 2
    return np.packbits(np.bincount((elements % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8).tobytes()


def _folded(vectors: list[bytes]) -> np.ndarray:
    """Parity vectors of the shortest's length, a row for each."""
    words = min(map(len, vectors)) // 8
    out = np.empty((len(vectors), words), np.uint64)
    for i, v in enumerate(vectors):
        x = np.frombuffer(v, np.uint64)
        while len(x) > words:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * shared >= NUM * (len(a) + len(b) - shared)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            sets = element_sets(Texts(piece.column("text"), lower=True))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "n_shingles", "node"])


def _signer(parts: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, held = [], []
        seen: set[int] = set()

        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal total
            total = 0
            signature = np.concatenate(held)
            which = np.repeat(np.arange(len(held), dtype=np.uint16), [len(h) for h in held])
            part = (signature % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            short, which, cuts = (signature >> np.uint64(32)).astype("<u4")[order], which[order], np.searchsorted(part[order], np.arange(parts + 1))
            names = np.array(nodes, "<i8")
            rows = [(p, names[(own := np.unique(which[a:b]))].tobytes(), np.searchsorted(own, which[a:b]).astype("<u2").tobytes(), short[a:b].tobytes()) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            nodes.clear(), held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["p", "nodes", "which", "short"])

        for batch in batches:
            for piece in pieces(batch):
                for s in element_sets(Texts(piece.column("text"), lower=True)):
                    if len(s) and (node := node_of(s)) not in seen:
                        if len(seen) < 200_000:  # equal sets of one task are signed once, as far as it remembers
                            seen.add(node)
                        nodes.append(node)
                        held.append(signatures(s))
                        total += len(held[-1])
                        if len(held) == CHUNK or total > SIGNATURES:
                            yield flush()
        if held:
            yield flush()

    return sign


def _lists(table: pa.Table) -> pa.Table:
    """The distinct lists of two or more nodes that share a signature, of one part of all signatures."""
    node, short = [], []
    for names, which, own in zip(*(table.column(c).to_pylist() for c in ("nodes", "which", "short"))):
        node.append(np.frombuffer(names, "<i8")[np.frombuffer(which, "<u2")])
        short.append(np.frombuffer(own, "<u4"))
    node, short = np.concatenate(node), np.concatenate(short)
    order = np.argsort(short, kind="stable")
    short, node = short[order], node[order]
    again = np.zeros(len(short), bool)
    again[1:] = short[1:] == short[:-1]
    again[:-1] |= again[1:]
    short, node = short[again], node[again]
    order = np.lexsort((node, short))
    short, node = short[order], node[order]
    new = np.ones(len(short), bool)
    new[1:] = (short[1:] != short[:-1]) | (node[1:] != node[:-1])
    short, node = short[new], node[new]
    begin = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]])) if len(short) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(short)))
    name = mix(np.add.reduceat(mix(node.view(np.uint64)), begin) + size.astype(np.uint64)).view(np.int64) if len(begin) else np.zeros(0, np.int64)
    _, first = np.unique(name, return_index=True)
    first = first[size[first] > 1]
    size, begin, name = size[first], begin[first], name[first]
    ends = np.cumsum(size)
    inner = np.arange(int(size.sum())) + np.repeat(begin - (ends - size), size)
    return pa.table({"list": pa.array(name), "nodes": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(node[inner]))})


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (a, b) rows whose texts' sets link."""
    last, kept = None, None
    for batch in batches:
        for piece in pieces(batch, "text_b"):
            ours = piece.column("a").to_pylist()
            new = [i for i, a in enumerate(ours) if a != (ours[i - 1] if i else last)]
            sets_a = dict(zip((ours[i] for i in new), element_sets(Texts(piece.column("text_a").take(pa.array(new, pa.int64())), lower=True))))
            if last is not None:
                sets_a.setdefault(last, kept)
            keep = [linked(sets_a[a], b) for a, b in zip(ours, element_sets(Texts(piece.column("text_b"), lower=True)))]
            last, kept = ours[-1], sets_a[ours[-1]]
            yield pa.RecordBatch.from_arrays([piece.column("a").filter(pa.array(keep)), piece.column("b").filter(pa.array(keep))], ["a", "b"])


def _fits(vector: np.ndarray, size: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """(bits in which the rows' vectors differ from all, whether sizes and bits leave a link possible)."""
    apart = np.bitwise_count(vector[rows, None, :] ^ vector[None, :, :]).sum(2, dtype=np.int32)
    ours, all_ = size[rows, None], size[None, :]
    return apart, (apart <= (ours + all_) * (DEN - NUM) // (DEN + NUM)) & (DEN * np.minimum(ours, all_) >= NUM * np.maximum(ours, all_))


def _across(nearest: bool):
    """For one list: pairs of nodes of different components that sizes and parity vectors don't rule out. With nearest
    only those that would join the components by least distances (a spanning forest), else all."""

    def pairs(table: pa.Table) -> pa.Table:
        node, root, size = (table.column(c).to_numpy() for c in ("node", "root", "size"))
        vector = _folded(table.column("parity").to_pylist())
        n = len(node)
        label = np.unique(root, return_inverse=True)[1]
        block = max(1, 1_000_000 // (n * vector.shape[1]))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while True:
            found = 0
            best = np.full((n, 2), -1, np.int64)  # distance and place of the nearest node of another component
            for at in range(0, n, block):
                apart, fits = _fits(vector, size, slice(at, at + block))
                fits &= label[at : at + block, None] != label[None, :]
                if not nearest:
                    i, j = np.nonzero(fits)
                    a.append(i[i + at < j] + at), b.append(j[i + at < j])
                    continue
                apart[~fits] = 1 << 30
                j = apart.argmin(1)
                d = apart[np.arange(len(j)), j]
                best[at : at + block, 0], best[at : at + block, 1] = d, np.where(d < 1 << 30, j, -1)
            if not nearest:
                break
            has = np.flatnonzero(best[:, 1] >= 0)
            order = has[np.lexsort((has, best[has, 0], label[has]))]
            first = order[np.concatenate([[True], label[order][1:] != label[order][:-1]])] if len(order) else order
            found = len(first)
            if not found:
                break
            a.append(first), b.append(best[first, 1])
            for x, y in zip(first.tolist(), best[first, 1].tolist()):
                if label[x] != label[y]:
                    label[label == label[x]] = label[y]
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b])})

    return pairs


def roots(edges: DataFrame, label: str = "node", most: int | None = None) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the least node of the connected component.

    Alternating steps join each node's greater neighbours, then its lesser ones, to the least neighbour, until nothing
    changes; partial minima are taken before each shuffle. Each round is written as Parquet and read again, which cuts lineage
    and tells the planner the real size (a checkpoint would hand down an estimate that is squared every round). There is no bound on
    the rounds unless ``most`` gives one; if it is reached, that is an error."""
    spark = edges.sparkSession
    current, folder = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    held, rounds = None, 0
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after, new = written(small.filter("u != v").distinct())
        mark = after.agg(F.count("*").alias("n"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)").alias("x")).first()
        current, large, low, small, both, least, after = after, None, None, None, None, None, None
        tidy(spark)
        remove(spark, folder)
        folder = new
        if held == mark:
            break
        held, rounds = mark, rounds + 1
        if rounds == most:
            raise RuntimeError(f"components are not joined after {most} rounds")
    return current.groupBy(F.col("u").alias(label)).agg(F.min("v").alias("root"))


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every document: the least key that links reach, itself included.

    Shingles are five words, ASCII capitals lowered; links need ``100 * shared >= 80 * united``. Null, empty and wordless
    texts have no shingles and link with nothing; equal sets are one node, so copies cost one. Rows that
    repeat a key are documents of their own. Rows with a null key link like others, but name no component: its
    component_id is the least key that isn't null, and null if there is none. An empty table gives an empty result. Other columns are left out.

    Signatures go out packed by part of their hash; each part gives the distinct lists of nodes that share one. Of a
    list, first each node is verified against its least companion of all lists; where that leaves a list in several
    components, against the closest of each; and at last against all that the parity vectors don't rule out.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    described = cut(slim.mapInArrow(_describe, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_shingles long, node long"))
    nodes = described.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size"))
    shingles = described.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(4 * shuffle_partitions(spark), -(-shingles // PART))
    packed = slim.filter("text is not null").mapInArrow(_signer(parts), "p int, nodes binary, which binary, short binary")
    lists = packed.groupBy("p").applyInArrow(_lists, "list long, nodes array<long>").groupBy("list").agg(F.first("nodes").alias("nodes"))
    lists = cut(lists)
    members = lists.select("list", F.explode("nodes").alias("node"), F.col("nodes")[0].alias("least"))
    first = members.filter("node != least").groupBy("node").agg(F.min("least").alias("a"))
    first = cut(first.select("a", F.col("node").alias("b")))
    needed = members.select("node").distinct()
    folder = new_folder(spark, "join-texts")
    chosen = nodes.join(needed, "node").select("node", "rep")
    keyed = slim.join(chosen, slim["doc_id"] == chosen["rep"]).select("node", "text")
    keyless = slim.filter("doc_id is null and text is not null").select("text").mapInArrow(_named, "node long, text string")
    keyless = keyless.join(chosen.filter("rep is null").select("node"), "node", "left_semi").dropDuplicates(["node"])
    picked = keyed.unionByName(keyless).mapInArrow(_own, "node long, text string, size long, parity binary")
    picked.write.parquet(folder)
    del packed, picked, keyed, keyless
    tidy(spark)
    texts = spark.read.schema("node long, text string, size long, parity binary").parquet(folder)

    def verified(pairs: DataFrame) -> DataFrame:
        t = texts.select("node", "text")
        with_b = pairs.join(t.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        both = with_b.join(t.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        return cut(both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long"))

    links, tested = verified(first), first
    tidy(spark)
    root = cut(roots(links))
    for nearest in (True, False):
        at = members.select("list", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = at.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("list")
        several = at.join(mixed, "list").join(texts.select("node", "size", "parity"), "node")
        pairs = several.groupBy("list").applyInArrow(_across(nearest), "a long, b long").distinct()
        pairs = cut(pairs.join(tested, ["a", "b"], "left_anti"))
        more = verified(pairs)
        tidy(spark)
        tested = tested.unionByName(pairs)
        links = links.unionByName(more)
        root = cut(roots(links))
    named = nodes.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_node = named.join(least, "root").select("node", "component_id")
    out = cut(described.join(of_node, "node", "left").select(F.col("doc_id").alias(key), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
    remove(spark, folder)
    return out


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) of texts, each node once in a task."""
    seen: set[int] = set()
    for batch in batches:
        for piece in pieces(batch):
            keep = {}
            for i, s in enumerate(element_sets(Texts(piece.column("text"), lower=True))):
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)
                    keep[node] = i
            yield pa.RecordBatch.from_arrays([pa.array(list(keep), pa.int64()), piece.column("text").take(pa.array(list(keep.values()), pa.int64()))], ["node", "text"])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (node, text) rows those whose text's set is the node, once in a task, with size and parity vector."""
    seen: set[int] = set()
    for batch in batches:
        for piece in pieces(batch):
            sets = element_sets(Texts(piece.column("text"), lower=True))
            keep = []
            for i, (node, s) in enumerate(zip(piece.column("node").to_pylist(), sets)):
                if len(s) and node not in seen and node_of(s) == node:
                    seen.add(node)
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column("node").take(at), piece.column("text").take(at), pa.array([len(sets[i]) for i in keep], pa.int64()), pa.array([parity(sets[i]) for i in keep], pa.binary())], ["node", "text", "size", "parity"])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set sizes and link components of all documents."""
    return components(documents(spark, sf_dir, "doc_id", "text"))


SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles
  FROM w
), nodes AS MATERIALIZED (
  SELECT min(doc_id) AS node, list_sort(shingles) AS shingles FROM sets WHERE len(shingles) > 0 GROUP BY list_sort(shingles)
), e AS MATERIALIZED (SELECT node, len(shingles) AS n, unnest(shingles) AS s FROM nodes),
links AS MATERIALIZED (
  SELECT a.node AS x, b.node AS y FROM e a JOIN e b ON a.s = b.s AND a.node < b.node AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), way AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT node, node AS least FROM nodes UNION SELECT b.y, r.least FROM reach r JOIN way b ON b.x = r.node),
root AS (SELECT node, min(least) AS least FROM reach GROUP BY node)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, coalesce(r.least, s.doc_id)::BIGINT AS component_id
FROM sets s LEFT JOIN nodes n ON n.shingles = list_sort(s.shingles) LEFT JOIN root r ON r.node = n.node
"""

QUERIES = {"op5_jaccard_join": op5}
ORACLE_SQL = {"op5_jaccard_join": SQL}
