"""Token counts of whole texts. Huge ones are encoded in overlapping chunks that are spliced where they agree."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._session import documents, others
from ._tokens import Memory, byte_lengths, default_path, encode, plain
from ._text import pieces

#: Bytes of a chunk, and by how many the next one overlaps it at first.
CHUNK, OVERLAP = 32_768, 512
#: Successive tokens on whose bounds both encodings must agree before a splice.
AGREE = 8

Encode = Callable[[str], np.ndarray]


def bounds(path: str) -> Encode:
    """A function that gives where each token of a text begins, in bytes, and at last the text's length."""
    lengths = byte_lengths(path)
    return lambda text: np.concatenate([[0], np.cumsum(lengths[encode(path, text)])])


@lru_cache(maxsize=65536)
def _kind(char: str) -> str:
    """L, N, S (white space) or M (any other) as the pre-tokenizer tells characters apart, or an empty string for those that
    an older edition of Unicode classes otherwise, so that libraries may differ on them."""
    new, old = unicodedata.category(char), unicodedata.ucd_3_2_0.category(char)
    if new != old or new[0] == "C":
        return "S" if char in "\t\n\v\f\r" else ""
    return "S" if new[0] == "Z" else new[0] if new[0] in "LN" else "M"


def _stable(data: bytes, at: int) -> bool:
    """Whether a byte-level pre-tokenizer breaks before data[at] whatever encloses it, in any script: at a single space
    between characters that are not white space, or where letters, digits and marks meet, but not after an apostrophe (which
    may begin a contraction). No merge crosses such a place; one near the opening of a special token's string doesn't count."""
    if not 0 < at < len(data) - 1 or data[at] & 0xC0 == 0x80 or b"<|" in data[max(0, at - 16) : at + 16]:
        return False
    here = data[at : at + 8].decode(errors="ignore")
    before = data[max(0, at - 8) : at].decode(errors="ignore")[-1:]
    if not before or len(here) < 2:
        return False
    last, first = _kind(before), _kind(here[0])
    if here[0] == " ":
        return last in "LNM" and last != "" and _kind(here[1]) not in ("", "S")
    return last != "" and first != "" and "S" not in (last, first) and last != first and before != "'"


def resynchronised(text: str, starts: Encode, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """(tokens, chunks encoded) of a text that is encoded in overlapping chunks of bytes.

    Each chunk begins ``overlap`` bytes before the end of the one before it. Both are encoded with offsets. They are
    spliced at the first common boundary that is proven stable: a token begins there in both encodings, the next
    ``AGREE`` tokens have equal bounds in both, and the text has a break there that the pre-tokenizer makes whatever
    surrounds it (so no merge crosses it). If there is none, the overlap is widened fourfold and the chunk encoded
    anew, in the end as one chunk from the last splice on, twice as long each time, so that a text without any such
    place costs no more than a few times its length. So the count is that of the whole text's encoding."""
    data = text.encode()
    n = len(data)

    def encoded_from(a: int, b: int) -> np.ndarray:
        return a + starts(data[a:b].decode())

    def whole(at: int) -> int:  # the next character's beginning
        while at < n and data[at] & 0xC0 == 0x80:
            at += 1
        return at

    end = whole(min(n, chunk))
    begin, total, chunks = 0, 0, 1  # begin: from where the current encoding's tokens count
    current = encoded_from(0, end)
    while end < n:
        wide = overlap
        while True:
            start = whole(max(begin, end - wide))
            until = whole(min(n, end + chunk))
            chunks += 1
            if start <= begin:
                until = whole(min(n, end + max(chunk, end - begin)))
                current, end = encoded_from(begin, until), until
                break
            later = encoded_from(start, until)
            at = _common(data, current, later, start, end)
            if at >= 0:
                total += int(np.searchsorted(current, at) - np.searchsorted(current, begin))
                current, begin, end = later, at, until
                break
            wide *= 4
    return total + len(current) - 1 - int(np.searchsorted(current, begin)), chunks


def _common(data: bytes, a: np.ndarray, b: np.ndarray, start: int, end: int) -> int:
    """First byte in the overlap at which the encodings can be spliced, or -1."""
    left, right = a[np.searchsorted(a, start) :], b[: np.searchsorted(b, end)]
    for x in np.intersect1d(left, right)[:-1].tolist():
        if _stable(data, x):
            i, j = np.searchsorted(left, x), np.searchsorted(right, x)
            ours = left[i : i + AGREE + 1]
            if i + AGREE < len(left) - 1 and len(right) >= j + AGREE + 1 and (ours == right[j : j + AGREE + 1]).all():
                return x
    return -1


def count_tokens(df: DataFrame, limit: int, path: str | None = None, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """df without its text, with ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` and ``n_chunks``.

    Counts are those of the library for the whole text, without added special tokens. Texts longer than ``chunk``
    bytes are encoded in chunks (see ``resynchronised``); shorter ones piece by piece with a memory of pieces
    where that is proven equal, else at once. A null counts as an empty text: 0 bytes, 0 tokens. Every row is counted alone,
    so repeated rows and ties don't matter; an empty table gives none. Other columns are carried along, but those that have
    a result's name, or begin with ``__``, give way to the result's.
    """
    path = path or default_path()
    keep = others(df.drop(text), "n_bytes", "n_tokens", "over_limit", "n_chunks")
    named = df.select(*keep, F.col(text).alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, starts = Memory(path), bounds(path)
        for batch in batches:
            for piece in pieces(batch, "__text"):
                values = [v or "" for v in piece.column("__text").to_pylist()]
                sizes = [len(v.encode()) for v in values]
                tokens, chunks = np.zeros(len(values), np.int64), np.ones(len(values), np.int64)
                short = [i for i, v in enumerate(values) if sizes[i] <= chunk and plain(v)]
                tokens[short] = memory.count([values[i] for i in short])
                for i in set(range(len(values))).difference(short):
                    tokens[i], chunks[i] = resynchronised(values[i], starts, chunk)
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in keep], pa.array(sizes, pa.int64()), pa.array(tokens), pa.array(tokens > limit), pa.array(chunks)], [*keep, "n_bytes", "n_tokens", "over_limit", "n_chunks"])

    schema = T.StructType(list(named.select(*keep).schema.fields)).add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean").add("n_chunks", "long")
    return named.mapInArrow(count, schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by byte_bpe_50k.json."""
    return count_tokens(documents(spark, sf_dir, "doc_id", "text"), 1024)


QUERIES = {"op8_token_counts": op8}
ORACLE_SQL: dict[str, str] = {}
