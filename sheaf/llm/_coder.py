"""An adaptive context-mixing range coder for sequences of ids, many independent blocks at once.

A sequence is cut into blocks of ``BLOCK`` ids. Each block is coded on its own: its models begin anew from the state that the
segment's header gives, its coder too, and it has a checksum, so with the header any block can be decoded alone. All
blocks of a segment go forward together, one id of each at a time, so that each step is a few NumPy operations over
all of them. Everything is integer arithmetic, the same in coder and decoder.

For each id in turn the models say:

* order 2 and order 1: the id that followed this context before in the block, with a confidence that grows and falls; where
  order 1 knows nothing yet, the id that most often follows in the segment after ids of the same slot. The candidate is order 2's,
  or order 1's where order 2 knows nothing;
* how likely the candidate is: each order has log odds for its confidence and whether order 1 agrees; they are mixed by
  adding them up, and each learns from the error of the mixture;
* if it is not the candidate, order 0: the ids are parted into ``CLASSES`` classes of such as stand in the same blocks; how
  frequent each class is adapts with every id of the block; inside a class, ids are as frequent as in the segment.

The header has the ids, their counts and the followers; all are counted over every id of the segment. The interval
arithmetic has 63 bits and another for the carry; digits have 32, and carries are resolved at the end.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

BLOCK, CLASSES, HASH_BITS = 1024, 8, 7
#: Bits of the interval; below this width a digit is due.
TOP = 63
_MANY = np.uint64(1 << TOP - 32)
#: Bits of a class's frequency, and least frequency of a class; the rate at which classes adapt.
CLASS_BITS, LEAST, RATE = 14, 128, 5
#: Bits of a frequency inside a class: of an interval of 31 bits at least, the candidate leaves a 64th part and the least class a 128th
#: of that, so 18 bits are left. So a class has at most 262144 ids, all together 2097152.
MOST_BITS = 18
_PLACE_BITS = 21
_SQUASH = np.array([min(4032, max(32, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2048, 2048)], np.int32)
#: The rate at which log odds learn.
STEP = 5
_KINDS = 64  # of log odds of an order: 32 confidences, order 1 agrees or not
_MULTIPLIERS = np.array([[0x9E3779B1], [0x85EBCA6B]], np.uint32)
_SHIFT, _SECOND = np.uint32(32 - HASH_BITS), np.uint32(0xC2B2AE35)
_KEPT = np.array([[14], [0]], np.uint32)  # order 1 lets go of an id by and by, order 2 at once


def _log_odds(p: float) -> int:
    return round(256 * math.log(p / (1 - p)))


#: Log odds at a block's beginning. Confidences: 0 nothing known, 1 to 15 seen in the block, from 16 on sixteenths in the segment.
_FIRST = np.zeros((2, 32, 2), np.int32)
for _c in range(32):
    _one = 0.03 + 0.06 * _c if _c < 16 else 0.03 + 0.94 * (_c - 16) / 16
    _FIRST[0, _c] = _log_odds(min(0.95, _one)) // 2
    _FIRST[1, _c] = _log_odds(min(0.95, 0.06 + 0.043 * _c)) // 2 if 0 < _c < 16 else 0
#: What a class draws the adaptive cumulative frequencies to: LEAST for each class below, and all that is free for those beyond it.
_ROWS = np.arange(1, CLASSES, dtype=np.int16)[:, None]
_BELOW, _FREE = _ROWS * np.int16(LEAST), np.int16((1 << CLASS_BITS) - LEAST * CLASSES)


class Header:
    """State in which the models of every block of a segment begin: ids in their order, counts, classes, and for each slot of
    order 1 the follower and how sure it is (16 to 31)."""

    def __init__(self, names: np.ndarray, times: np.ndarray, heads: np.ndarray, follower: np.ndarray, sure: np.ndarray):
        self.names, self.times, self.heads, self.follower, self.sure = names, times, heads, follower, sure
        n, most = len(names), int(np.diff(heads).max())
        self.bits = np.uint64(min(MOST_BITS, max(12, (8 * most - 1).bit_length())))
        scale = 1 << int(self.bits)
        self.group = np.repeat(np.arange(CLASSES), np.diff(heads)).astype(np.int16)
        self.low, self.size = np.empty(n, np.uint32), np.empty(n, np.uint32)
        self.at = np.zeros(CLASSES * scale, np.int32)
        start, whole = np.zeros(CLASSES, np.int64), max(1, int(times.sum()))
        for c in range(CLASSES):
            a, b = int(heads[c]), int(heads[c + 1])
            start[c] = int(times[a:b].sum())
            if b > a:
                share = 1 + times[a:b] * (scale - (b - a)) // max(1, int(start[c]))
                share[int(share.argmax())] += scale - int(share.sum())
                self.size[a:b] = share
                self.low[a:b] = np.cumsum(share) - share
                self.at[c * scale : (c + 1) * scale] = np.repeat(np.arange(a, b, dtype=np.int32), share)
        free = (1 << CLASS_BITS) - LEAST * CLASSES
        share = LEAST + start * free // whole
        share[int(share.argmax())] += (1 << CLASS_BITS) - int(share.sum())
        self.start = np.concatenate([[0], np.cumsum(share)]).astype(np.int16)

    def pack(self) -> bytes:
        parts = [np.array([len(self.names)], "<u4"), self.names.astype("<u4"), self.times.astype("<u4"), self.heads.astype("<u4"), self.follower.astype("<u4"), self.sure.astype("u1")]
        return zlib.compress(b"".join(p.tobytes() for p in parts), 3)

    @staticmethod
    def unpack(raw: bytes) -> Header:
        raw = zlib.decompress(raw)
        n, slots = int(np.frombuffer(raw, "<u4", 1)[0]), 1 << HASH_BITS
        cells = np.frombuffer(raw, "<u4", 2 * n + CLASSES + 2 + slots).astype(np.int64)
        heads = cells[1 + 2 * n : 2 + 2 * n + CLASSES]
        return Header(cells[1 : 1 + n], cells[1 + n : 1 + 2 * n], heads, cells[2 + 2 * n + CLASSES :].astype(np.int32), np.frombuffer(raw, np.uint8, slots, 4 * len(cells)).astype(np.int32))


def _survey(ids: np.ndarray) -> tuple[Header, np.ndarray]:
    """(header, place of each id in the header's order). The order is that of a projection in which ids that stand in the same
    blocks are neighbours (a few steps of power iteration on the counts by block); classes hold equal shares of it."""
    if ids.max() < 1 << 20:
        count = np.bincount(ids)
        names = np.flatnonzero(count)
        times = count[names]
        place = np.zeros(len(count), np.int64)
        place[names] = np.arange(len(names))
        place = place[ids]
    else:
        names, place, times = np.unique(ids, return_inverse=True, return_counts=True)
    n, heads = len(names), np.arange(0, len(ids), BLOCK)
    lengths = np.diff(np.append(heads, len(ids)))
    weight, mass = 1.0 / np.sqrt(times), np.sqrt(times / len(ids))
    x = np.cos(np.arange(n) * 1.7)
    for _ in range(2):
        x -= mass * float(mass @ x)
        of_block = np.add.reduceat((weight * x).take(place), heads) / lengths
        x = weight * np.bincount(place, np.repeat(of_block, lengths), n)
        x /= max(1e-30, math.sqrt(float(x @ x)))
    order = np.lexsort((-times, np.round(x * weight, 9)))
    upto = np.cumsum(times[order]) - times[order] / 2
    heads = np.searchsorted(np.minimum(upto * CLASSES // len(ids), CLASSES - 1), np.arange(CLASSES + 1))
    if np.diff(heads).max() > 1 << MOST_BITS:  # many rare ids: equal numbers instead
        heads = np.arange(CLASSES + 1) * n // CLASSES
        if n > CLASSES << MOST_BITS:
            raise ValueError(f"more than {CLASSES << MOST_BITS} different ids in a segment")
    rank = np.empty(n, np.uint32)
    rank[order] = np.arange(n)
    place = rank.take(place)
    slot = np.arange(n, dtype=np.uint32) * _MULTIPLIERS[0, 0] >> _SHIFT
    pair = np.sort(slot.take(place[:-1]) << np.uint32(_PLACE_BITS) | place[1:])  # 31 bits
    follower, sure = np.zeros(1 << HASH_BITS, np.int32), np.zeros(1 << HASH_BITS, np.int32)
    if len(pair):
        begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        seen, pair = np.diff(np.append(begin, len(ids) - 1)), pair[begin].astype(np.int64)
        first = pair >> _PLACE_BITS
        edge = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        best = np.maximum.reduceat(seen << 31 | pair, edge)
        follower[first[edge]] = best & (1 << _PLACE_BITS) - 1
        sure[first[edge]] = 16 + np.minimum(15, 16 * (best >> 31) // np.add.reduceat(seen, edge))
    return Header(names[order].astype(np.int64), times[order].astype(np.int64), heads, follower, sure), place


class _Models:
    """Models of many blocks; each has a lane. Arrays with two rows hold order 1 and order 2."""

    def __init__(self, lanes: int, header: Header):
        slots = 1 << HASH_BITS
        self.at = (np.arange(lanes) + np.array([[0], [lanes]])) * slots
        self.seen = np.zeros(2 * lanes * slots, np.int32)  # place * 32 + confidence
        self.seen[: lanes * slots].reshape(lanes, slots)[:] = header.follower << 5 | header.sure
        self.kinds = (np.arange(lanes) + np.array([[0], [lanes]])) * _KINDS
        self.odds = np.repeat(_FIRST.reshape(2, 1, _KINDS), lanes, 1).ravel()
        self.p1, self.p2 = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.classes = np.repeat(header.start[:, None], lanes, 1)  # a row for each bound
        self.draw = np.empty((CLASSES - 1, lanes), np.int16)
        self.slot, self.i, self.j = np.empty((2, lanes), np.uint32), np.empty((2, lanes), np.int64), np.empty((2, lanes), np.int64)

    def predict(self) -> None:
        """The candidate ``a`` and how likely it is, ``p`` of 4096."""
        slot = self.slot
        np.multiply(self.p1, _MULTIPLIERS, out=slot)
        slot[1] += self.p2
        slot >>= _SHIFT
        np.add(slot, self.at, out=self.i)
        e = self.e = self.seen.take(self.i)
        c = self.c = e & 31
        r = self.r = e >> 5
        self.a = np.where(c[1] > 0, r[1], r[0])
        j = c + c
        j += r[0] == self.a
        np.add(j, self.kinds, out=self.j)
        odds = self.o = self.odds.take(self.j)
        mixed = odds[0] + odds[1]
        mixed += 2048
        np.maximum(mixed, 0, out=mixed)
        np.minimum(mixed, 4095, out=mixed)
        self.p = _SQUASH.take(mixed)

    def learn(self, x: np.ndarray, group: np.ndarray, hit: np.ndarray) -> None:
        """Takes in the ids at these places."""
        error = hit.astype(np.int32)
        error <<= 12
        error -= self.p
        error >>= STEP
        self.o += error
        self.odds[self.j] = self.o
        c, e, same = self.c, self.e, self.r == x
        other = ~same
        e += same & (c < 15)
        e -= other
        c -= 2
        other &= c.view(np.uint32) >= _KEPT
        self.seen[self.i] = np.where(other, x << 5 | 1, e)
        p = x.view(np.uint32)
        self.p2, self.p1 = self.p1 * _SECOND, p
        draw, inner = self.draw, self.classes[1:CLASSES]
        np.subtract(group, _ROWS, out=draw)
        draw >>= 15
        draw &= _FREE
        draw += _BELOW
        draw -= inner
        draw >>= RATE
        inner += draw


def encode(ids: np.ndarray) -> dict[str, bytes | int]:
    """Code of ids (below 2**32): header, bytes and checksum of each block, payload."""
    n = len(ids)
    if not n:
        return {"block": BLOCK, "header": b"", "block_bytes": b"", "block_crc": b"", "payload": b""}
    header, place = _survey(ids)
    lanes = -(-n // BLOCK)
    padded = np.zeros(lanes * BLOCK, np.int32)
    padded[:n] = place
    steps = np.ascontiguousarray(padded.reshape(lanes, BLOCK).T)
    m = _Models(lanes, header)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 1 << TOP, np.uint64)
    span -= np.uint64(1)
    row = np.arange(lanes)
    digits, at = np.empty((BLOCK + 2) * lanes, np.uint64), row.copy()  # an id has one digit at most
    flat = m.classes.view(np.uint16).ravel()
    u12, u14, u31, u32 = (np.uint64(k) for k in (12, CLASS_BITS, 31, 32))
    keep = np.uint64((1 << 31) - 1)
    for x in steps:
        m.predict()
        hit = x == m.a
        group = header.group.take(x)
        cell = group * np.int64(lanes)
        cell += row
        cut = span >> u12
        cut *= m.p.view(np.uint32)
        rest = span - cut
        rest >>= u14
        below = flat.take(cell)
        cell += lanes
        share = flat.take(cell)
        share -= below
        add = rest * below
        add += cut
        rest *= share
        rest >>= header.bits
        add += rest * header.low.take(x)
        rest *= header.size.take(x)
        add *= ~hit
        low += add
        span = np.where(hit, cut, rest)
        i = np.flatnonzero(span < _MANY)
        here, part = at.take(i), low.take(i)
        digits[here] = part >> u31
        at[i] = here + lanes
        part &= keep
        low[i] = part << u32
        span[i] = span.take(i) << u32
        m.learn(x, group, hit)
    for d in (low >> u31, (low & keep) << np.uint64(1)):
        digits[at] = d
        at += lanes
    filled = at // lanes
    del m, flat, steps, padded
    rows = int(filled.max())
    out, carry, whole = digits[: rows * lanes].reshape(rows, lanes), np.zeros(lanes, np.uint64), np.uint64((1 << 32) - 1)
    for k in range(rows - 1, -1, -1):
        d = np.where(filled > k, out[k], np.uint64(0)) + carry
        out[k] = d & whole
        carry = d >> u32
    used = np.arange(rows)[None, :] < filled[:, None]
    raw = memoryview(np.asarray(ids, "<u4").tobytes())
    sums = [zlib.crc32(raw[4 * i * BLOCK : 4 * (i + 1) * BLOCK]) for i in range(lanes)]
    return {"block": BLOCK, "header": header.pack(), "block_bytes": (4 * filled).astype("<u4").tobytes(), "block_crc": np.array(sums, "<u4").tobytes(), "payload": out.T[used].astype("<u4").tobytes()}


def decode(n: int, block: int, header: bytes, block_bytes: bytes, block_crc: bytes, payload: bytes, only: int | None = None) -> np.ndarray:
    """The n ids of a code, or those of the one block ``only``. Raises ValueError if a block's checksum differs."""
    if not n:
        return np.zeros(0, np.int64)
    state = Header.unpack(header)
    filled, said = np.frombuffer(block_bytes, "<u4").astype(np.int64) // 4, np.frombuffer(block_crc, "<u4")
    at = np.cumsum(filled) - filled
    lengths = np.full(len(filled), block)
    lengths[-1] = n - block * (len(filled) - 1)
    if only is not None:
        payload = payload[4 * at[only] : 4 * (at[only] + filled[only])]
        filled, said, lengths, at = filled[only : only + 1], said[only : only + 1], lengths[only : only + 1], at[:1]
    lanes = len(filled)
    u1, u12, u14, u31, u32 = (np.uint64(k) for k in (1, 12, CLASS_BITS, 31, 32))
    digits = np.concatenate([np.frombuffer(payload, "<u4").astype(np.uint64), np.zeros(3, np.uint64)])
    code = digits[at] << u31 | digits[at + 1] >> u1
    digits = (digits[:-1] & u1) << u31 | digits[1:] >> u1  # the interval has 63 bits, so digits are read one bit later
    at = at + 1
    span = np.full(lanes, 1 << TOP, np.uint64)
    span -= u1
    m = _Models(lanes, state)
    flat, row = m.classes.view(np.uint16).ravel(), np.arange(lanes)
    steps = np.empty((block, lanes), np.int32)
    inner, top, most = m.classes[1:CLASSES], np.uint64((1 << int(state.bits)) - 1), np.uint64((1 << CLASS_BITS) - 1)
    shift = np.int64(state.bits)
    for t in range(int(lengths.max())):
        m.predict()
        cut = span >> u12
        cut *= m.p.view(np.uint32)
        hit = code < cut
        rest = span - cut
        rest >>= u14
        left = code - cut
        left *= ~hit
        v = left // rest
        np.minimum(v, most, out=v)
        c = np.add.reduce((inner <= v.astype(np.int16)).view(np.int8), 0, np.int8).astype(np.int64)
        cell = c * lanes
        cell += row
        below = flat.take(cell)
        cell += lanes
        share = flat.take(cell)
        share -= below
        left -= rest * below
        rest *= share
        rest >>= state.bits
        v = left // rest
        np.minimum(v, top, out=v)
        c <<= shift
        c += v.view(np.int64)
        x = np.where(hit, m.a, state.at.take(c))
        left -= rest * state.low.take(x)
        rest *= state.size.take(x)
        code = np.where(hit, code, left)
        span = np.where(hit, cut, rest)
        i = np.flatnonzero(span < _MANY)
        here = at.take(i)
        code[i] = code.take(i) << u32 | digits.take(here, mode="clip")
        at[i] = here + 1
        span[i] = span.take(i) << u32
        steps[t] = x
        m.learn(x, state.group.take(x), hit)
    ids = state.names.astype("<u4").take(np.ascontiguousarray(steps.T).ravel()[: int(lengths.sum())])  # only the last block is shorter
    raw = memoryview(ids).cast("B")
    for i, sum_ in enumerate(said.tolist()):
        if zlib.crc32(raw[4 * i * block : 4 * (i + 1) * block]) != sum_:
            raise ValueError(f"block {i if only is None else only} is damaged")
    return ids
