"""Public tokenizers in workers: loaded once in each process, with a memory of pieces already encoded."""

from __future__ import annotations

import os

import numpy as np

from ._text import hash_of

#: Pieces that a process remembers; when so many are held, it begins anew.
MEMORY = 900_000
#: The same where they are held in arrays, some 60 bytes each.
KEPT = 1_500_000

_loaded: dict[str, object] = {}


def load(path: str):
    """The tokenizers library's tokenizer of a .json file, one for each process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: White space that a byte-level pre-tokenizer may join with a space that follows or precedes it.
_JOINS = ("  ", "\n ", "\t ", "\r ", " \n", " \t", " \r")


def plain(text: str) -> bool:
    """Whether the pieces between the text's single spaces can be encoded one by one.

    A byte-level pre-tokenizer breaks before a space that stands alone, after a character that is not white
    space; so it treats " word" alike wherever it stands. This is used only for texts of ASCII and Latin letters
    without other white space beside a space, and without the opening of a special token's string."""
    return not any(j in text for j in _JOINS) and "<|" not in text and text.isprintable() if "\n" not in text else not any(j in text for j in _JOINS) and "<|" not in text and text.replace("\n", "").isprintable()


def byte_lengths(path: str) -> np.ndarray:
    """Bytes that each id of a byte-level tokenizer stands for."""
    name = f"{path}#bytes"
    if name not in _loaded:
        tokenizer = load(path)
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
        lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a byte-level token has a character for each byte
            lengths[i] = len(token.encode()) if token in special else len(token)
        _loaded[name] = lengths
    return _loaded[name]


def encode(path: str, text: str) -> np.ndarray:
    """Ids of a text, without added special tokens."""
    return np.array(load(path).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)


class Memory:
    """Ids of pieces by text. Equal pieces are encoded once for each process, all new ones of a call in one go."""

    def __init__(self, path: str):
        self.path = path
        self.held: dict[str, int] = _loaded.setdefault(f"{path}#pieces", {})

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces on end, ids per piece). Each piece but one that opens a text begins with its space, so they can
        be put after one another: the pre-tokenizer breaks before each."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = [p if p[:1] == " " else " " + p for p in pieces if p]
        ids = encode(self.path, "".join(joined))
        ends = np.cumsum([len(p.encode()) for p in joined])
        at = np.searchsorted(np.cumsum(byte_lengths(self.path)[ids]), ends, "left") + 1
        return ids, np.diff(at, prepend=0)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each of some plain texts."""
        held, split = self.held, []
        for text in texts:
            parts = text.split(" ")
            parts[1:] = [" " + p for p in parts[1:]]
            split.append(parts)
        unknown = {p for parts in split for p in parts if p not in held}
        if len(held) + len(unknown) > MEMORY:
            held.clear()
            unknown = {p for parts in split for p in parts}
        later = [p for p in unknown if p[:1] == " "]
        held.update(zip(later, self.ids(later)[1].tolist()))
        for p in unknown:  # at a text's beginning
            if p[:1] != " ":
                held[p] = len(encode(self.path, p))
        return [sum(map(held.__getitem__, parts)) for parts in split]


_SOLID = np.zeros(256, bool)  # bytes that are, or belong to, characters that are not white space in a text that is even
_SOLID[33:127] = _SOLID[128:] = True
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
for _c in range(33, 127):
    (_LETTER if chr(_c).isalpha() else _MARK)[_c] = not chr(_c).isdigit()
_WIDE = np.zeros(256, bool)  # first bytes of characters among which some are white space
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_KINDS = _SOLID * np.uint8(1) + _LETTER * np.uint8(2) + _MARK * np.uint8(4) + _WIDE * np.uint8(8)
#: Bits of a hash by which a piece is looked for first; pieces encoded in one string.
FRONT_BITS, TOGETHER = 20, 64


class Pieces:
    """Ids of many texts at once: cut into pieces where a byte-level pre-tokenizer breaks whatever surrounds them, each
    distinct piece encoded once and kept for the process, all new ones of a call in one go. Pieces are found by hash and
    compared byte by byte; should two differ that have one hash, the texts are encoded as wholes.

    Such breaks are: before a space or line break that follows a character that is not white space, after a line break
    alone between two such characters, and before an ASCII mark that follows an ASCII letter. A text with characters of
    blocks that hold other white space, or with the opening of a special token's string, is encoded as a whole."""

    def __init__(self, path: str):
        self.path = path
        self.kept: dict = _loaded.setdefault(f"{path}#kept", {})
        if not self.kept:
            self._clear()

    def _clear(self) -> None:
        self.kept |= {"key": np.zeros(0, np.uint64), "slot": np.zeros(0, np.int32), "ids": np.zeros(1 << 16, np.int32), "begin": np.zeros(1 << 16, np.int32), "used": 0, "n": 0, "size": np.zeros(1 << 16, np.int32), "eight": np.zeros(1 << 16, np.uint64), "eight_at": np.zeros(1 << 16, np.int32), "eights": 0, "front": np.zeros(1 << FRONT_BITS, np.int32)}

    def _room(self, name: str, n: int) -> None:
        while n > len(self.kept[name]):
            self.kept[name] = np.concatenate([self.kept[name], np.zeros(len(self.kept[name]) // 2, self.kept[name].dtype)])

    def _add(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray, number: np.ndarray, begin: np.ndarray, alone: np.ndarray) -> None:
        """Encodes new pieces and keeps them and their bytes; whole texts alone, as their white space might join a break."""
        kept, many = self.kept, len(keys)
        n, held = kept["n"], kept["eights"]
        for name in ("size", "eight_at"):
            self._room(name, n + many)
        self._room("eight", held + len(number))
        kept["size"][n : n + many], kept["eight_at"][n : n + many] = size, held + begin
        kept["eight"][held : held + len(number)] = number
        kept["eights"] = held + len(number)
        blank = data[starts] == 32
        good = _SOLID[data[starts + size - 1]] & (_SOLID[data[starts]] | blank & (size > 1) & _SOLID[data[np.minimum(starts + 1, len(data) - 1)]])
        good &= ~alone
        spaced, bare = np.flatnonzero(good & blank), np.flatnonzero(good & ~blank)
        others = {i: encode(self.path, data[starts[i] : starts[i] + size[i]].tobytes().decode()) for i in np.flatnonzero(~good).tolist()}
        good = np.concatenate([spaced, bare])
        gap = np.repeat([0, 1], [len(spaced), len(bare)])  # breaks stand before the former's spaces, and around a line break after each of the latter
        own = size[good]
        ends, lead = np.cumsum(own + gap), np.cumsum(own) - own
        begins, to = ends - own - gap, np.arange(int(own.sum()))
        joined = np.full(int(ends[-1]) if len(ends) else 0, 10, np.uint8)
        joined[to + np.repeat(begins - lead, own)] = data[to + np.repeat(starts[good] - lead, own)]
        joined = joined.tobytes()
        cuts = np.unique(np.concatenate([begins[::TOGETHER], begins[len(spaced) : len(spaced) + 1], ends[-1:]])).tolist()
        found = load(self.path).encode_batch_fast([joined[a:b].decode() for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.int64), *(np.array(f.ids, np.int64) for f in found)])
        bytes_ = byte_lengths(self.path)[ids]
        at = np.cumsum(bytes_) - bytes_
        first, last = np.searchsorted(at, begins), np.searchsorted(at, ends - gap)
        counts = np.zeros(many, np.int64)
        counts[good] = last - first
        for i, x in others.items():
            counts[i] = len(x)
        upto = np.cumsum(counts)
        flat = np.zeros(int(upto[-1]), np.int64)
        own = counts[good]
        to = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        flat[to + np.repeat((upto - counts)[good], own)] = ids[to + np.repeat(first, own)]
        for i, x in others.items():
            flat[upto[i] - len(x) : upto[i]] = x
        used = kept["used"]
        self._room("ids", used + len(flat))
        self._room("begin", n + many + 1)
        kept["ids"][used : used + len(flat)] = flat
        kept["begin"][n + 1 : n + 1 + many] = used + upto
        place = np.searchsorted(kept["key"], keys)
        kept["key"], kept["slot"] = np.insert(kept["key"], place, keys), np.insert(kept["slot"], place, np.arange(n, n + many, dtype=np.int32))
        kept["n"], kept["used"] = n + many, used + len(flat)

    def _slots(self, keys: np.ndarray, size: np.ndarray, at8: np.ndarray, steps: np.ndarray, number: np.ndarray, data: np.ndarray, starts: np.ndarray, alone: np.ndarray) -> np.ndarray | None:
        """Where pieces are kept, new ones from now on. None if two that differ have one hash; nothing if the memory had to be emptied."""
        kept = self.kept

        def eights(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(numbers of some pieces on end, each one's place in its piece, where each piece's begin)"""
            upto = np.cumsum(steps[of]) - steps[of]
            inner = np.arange(int(steps[of].sum())) - np.repeat(upto, steps[of])
            return number[np.repeat(at8[of], steps[of]) + inner], inner, upto

        unique, first, which = np.unique(keys, return_index=True, return_inverse=True)
        like = first[which]
        if (size != size[like]).any():
            return None
        own, inner, _ = eights(np.arange(len(keys)))
        if (own != number[np.repeat(at8[like], steps) + inner]).any():
            return None
        at = np.minimum(np.searchsorted(kept["key"], unique), max(0, len(kept["key"]) - 1))
        known = kept["key"][at] == unique if len(kept["key"]) else np.zeros(len(unique), bool)
        slot, ours = kept["slot"][at[known]], first[known]
        if (kept["size"][slot] != size[ours]).any():
            return None
        own, inner, _ = eights(ours)
        if (own != kept["eight"][np.repeat(kept["eight_at"][slot], steps[ours]) + inner]).any():
            return None
        new = np.flatnonzero(~known)
        if len(new):
            if kept["n"] and (kept["n"] + len(new) > KEPT or kept["eights"] > 4 * KEPT or kept["used"] > 8 * KEPT):
                self._clear()
                return new[:0]
            f = first[new]
            own, _, upto = eights(f)
            self._add(unique[new], data, starts[f], size[f], own, upto, alone[f])
        return kept["slot"][np.searchsorted(kept["key"], unique)][which]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, ids per text) of a flat view."""
        data, offsets = texts.data, texts.offsets
        n, kept = len(data), self.kept
        if not n:
            return np.zeros(0, np.int64), np.zeros(texts.n, np.int64)
        kinds = _KINDS[data]
        odd = np.flatnonzero(kinds > 7)
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        whole = np.zeros(texts.n, bool)
        whole[np.searchsorted(offsets, np.concatenate([odd, special]), "right") - 1] = True
        solid = (kinds & 1).view(bool)
        begin = np.zeros(n, bool)
        before = solid[:-1]
        begin[1:] = before & ((data[1:] == 32) | (data[1:] == 10)) | (kinds[:-1] << 1 & kinds[1:] & 4).astype(bool)
        begin[2:] |= solid[2:] & (data[1:-1] == 10) & solid[:-2]
        filled = np.flatnonzero(np.diff(offsets))
        heads = offsets[filled]
        after = heads + 1  # a text's line break at its beginning follows nothing
        begin[after[after < n]] &= data[heads[after < n]] != 10
        begin[heads] = True
        for t in np.flatnonzero(whole).tolist():
            begin[offsets[t] + 1 : offsets[t + 1]] = False
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n)
        size = ends - starts
        alone = np.zeros(len(starts), bool)
        alone[np.searchsorted(starts, offsets[:-1][whole])] = True
        number, place, at8 = texts.eights(starts, ends)
        keys = hash_of(number, place, at8, size)
        steps = np.diff(at8, append=len(number))
        here = (keys >> np.uint64(64 - FRONT_BITS)).astype(np.int64)
        slot = kept["front"].take(here)
        known = np.zeros(len(keys), bool)
        if kept["n"]:
            known = kept["size"].take(slot) == size
            differ = kept["eight"].take(np.repeat(kept["eight_at"].take(slot), steps) + place, mode="clip") != number
            known[np.searchsorted(at8, np.flatnonzero(differ), "right") - 1] = False
        rest = np.flatnonzero(~known)
        if len(rest):
            found = self._slots(keys[rest], size[rest], at8[rest], steps[rest], number, data, starts[rest], alone[rest])
            if found is None:  # two pieces that differ have one hash
                wholes = [encode(self.path, data[a:b].tobytes().decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                return np.concatenate(wholes), np.array([len(f) for f in wholes], np.int64)
            if not len(found):  # the memory was full and is empty now
                return self.encode(texts)
            slot[rest] = found
            kept["front"][here[rest]] = found
        from_ = kept["begin"].take(slot)
        counts = kept["begin"].take(slot + 1) - from_
        upto = np.cumsum(counts)
        shift = np.repeat(from_ - (upto - counts), counts)
        shift += np.arange(len(shift))
        ids = kept["ids"].take(shift)
        total = np.concatenate([[0], upto])
        cuts = np.searchsorted(starts, offsets)
        return ids, np.diff(total[cuts])
