"""Texts of an Arrow batch as flat NumPy arrays: bytes, words, lines and 64-bit hashes.

Everything is done for a whole piece of a batch at once. A piece holds whole texts, of about
``PIECE`` bytes together, or one text that alone is longer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 2 << 20
#: Steps of eight bytes that are hashed at a time.
STEPS = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BREAK = np.zeros(256, bool)  # ASCII characters that are neither letters nor digits
_BREAK[[c for c in range(128) if not chr(c).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit (a finaliser of the splitmix kind)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first bytes of a number of eight
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:  # doubling
            step = min(done, size - done)
            have[done : done + step] = have[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        if size <= 4 * PIECE:
            _powers[name] = have
    return have[:n]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values on end, and where each begins (one more than values). A null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def released() -> None:
    """Gives freed memory back to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """batch in slices of whole rows with about limit bytes of text each."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
    released()


def hash_of(number: np.ndarray, place: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of spans given in steps of eight bytes (see ``Texts.eights``)."""
    mixed = mix(number + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))
    if len(number) > len(begin):
        mixed = np.add.reduceat(mixed, begin)
    return mix(mixed + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Texts:
    """Flat view of some texts; what is derived is made once, on demand."""

    def __init__(self, column, lower: bool = False):
        self.data, self.offsets = flat(column)
        if lower:
            self.data = LOWER[self.data]
        self.n = len(self.offsets) - 1
        self._padded = self._points = self._prefix = None

    def eights(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of each span in steps of eight as little-endian numbers, zeros after its end: (numbers of all spans on
        end, each one's place in its span, where each span's begin). An empty span has one number, 0."""
        if self._padded is None:
            padded = np.zeros(len(self.data) + 8, np.uint8)
            padded[: len(self.data)] = self.data
            self._padded = np.ndarray(len(self.data) + 1, "<u8", padded, 0, (1,))
        size = ends - starts
        steps = np.maximum(1, (size + 7) >> 3)
        upto = np.cumsum(steps)
        begin = upto - steps
        place = np.arange(int(upto[-1]) if len(upto) else 0) - np.repeat(begin, steps)
        left = np.repeat(size, steps) - 8 * place
        number = self._padded[np.repeat(starts, steps) + 8 * place] & _KEEP[np.minimum(left, 8)]
        return number, place, begin

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each span of bytes; equal spans have equal hashes wherever they stand. Each eight bytes are mixed
        with their place before they are added up, so no pattern of bytes cancels out."""
        upto = np.cumsum((ends - starts + 7) >> 3)
        if not len(upto) or upto[-1] <= STEPS:
            return hash_of(*self.eights(starts, ends), ends - starts) if len(starts) else np.zeros(0, np.uint64)
        cuts = np.unique(np.concatenate([[0], np.searchsorted(upto, np.arange(STEPS, upto[-1], STEPS)), [len(starts)]]))
        return np.concatenate([hash_of(*self.eights(starts[a:b], ends[a:b]), ends[a:b] - starts[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())])

    def prefix(self) -> np.ndarray:
        """Running sums of the bytes' polynomial, made once."""
        if self._prefix is None:
            n = len(self.data)
            self._prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(_OF_BYTE[self.data] * _power("base", _BASE, n), out=self._prefix[1:])
        return self._prefix

    def short_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of spans of some hundred bytes at most, by the polynomial: patterns that cancel out need 1024 bytes."""
        total = self.prefix()
        spans = (total[ends] - total[starts]) * _power("inverse", _INVERSE, len(self.data) + 1)[starts]
        return mix(spans + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all texts on end, and where each text begins among them."""
        if self._points is None:
            code = np.frombuffer(self.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint64)
            before = np.zeros(len(self.data) + 1, np.int64)
            np.cumsum((self.data & 0xC0) != 0x80, out=before[1:])
            self._points = code, before[self.offsets]
        return self._points

    def per_text(self, positions: np.ndarray) -> np.ndarray:
        """Ascending positions counted by text."""
        at = np.searchsorted(positions, self.offsets)
        return np.diff(at)

    def words(self, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, words per text). Words end at ASCII white space; plain ones at any ASCII character but letters and digits."""
        space = (_BREAK if plain else _SPACE)[self.data]
        n = len(space)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(self.n, np.int64)
        before = np.empty(n, bool)
        before[0] = True
        before[1:] = space[:-1]
        after = np.empty(n, bool)
        after[-1] = True
        after[:-1] = space[1:]
        first = self.offsets[:-1]
        before[first[first < n]] = True
        last = self.offsets[1:] - 1
        after[last[last >= 0]] = True
        starts = np.flatnonzero(~space & before)
        ends = np.flatnonzero(~space & after) + 1
        return starts, ends, self.per_text(starts)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, lines per text) of the \\n-split lines; a text has one more than it has breaks."""
        breaks = np.flatnonzero(self.data == 10)
        counts = self.per_text(breaks) + 1
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.offsets[1:], breaks]), kind="stable")
        return starts, ends, counts

    def sums(self, of_byte: np.ndarray) -> np.ndarray:
        """For each text the sum over its bytes of a table's values."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(of_byte[self.data], out=total[1:])
        return np.diff(total[self.offsets])


def owners(counts: np.ndarray) -> np.ndarray:
    """Which text each of the things counted belongs to."""
    return np.repeat(np.arange(len(counts)), counts)


_ROLL = [int(x) for x in mix(np.arange(11, 43, dtype=np.uint64)) | np.uint64(1)]


def windows(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of size successive words inside one text, and the index of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.repeat(np.cumsum(counts), counts)[:n]  # end of the text that the word at each place belongs to
    at = np.flatnonzero(np.arange(n) + size <= ends)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += hashes[i : i + n] * np.uint64(_ROLL[i])
    return mix(total[at]), at


def group_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of successive stretches of values with the given lengths."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=values.dtype if values.dtype.kind == "f" else np.int64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def repeats(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal one in the same text, has an equal one earlier in the same text) of things in ascending order."""
    key = mix(hashes + mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    any_equal = again.copy()
    any_equal[order[:-1][same]] = True
    return any_equal, again
