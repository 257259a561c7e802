"""Normal forms of texts with maps of offsets, and cuts at sentences: what needs one character after another."""

from __future__ import annotations

import re
import unicodedata

SOFT_HYPHEN = "­"
_WRAP = re.compile(r"-\s*\n\s*(?=[a-z])")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z_])")
_STYLE = re.compile(r"__STYLE_(\d{4,})_(OPEN|CLOSE)__")


def normal_form(raw: str) -> tuple[str, list[int], list[int]]:
    """(normal form, where each of its characters begins in raw, where it ends): compatibility forms in lower case, soft hyphens
    and hyphens at line breaks out, a run of white space as one space."""
    wraps = {m.start(): m.end() for m in _WRAP.finditer(raw)}
    out, starts, ends, i = [], [], [], 0
    while i < len(raw):
        if i in wraps:
            i = wraps[i]
            continue
        char = raw[i]
        form = "" if char == SOFT_HYPHEN else unicodedata.normalize("NFKC", char).lower()
        for c in form:
            if c.isspace():
                if out and out[-1] == " ":
                    ends[-1] = i + 1
                    continue
                c = " "
            out.append(c)
            starts.append(i)
            ends.append(i + 1)
        i += 1
    return "".join(out), starts, ends


def matches(raw: str, needle: str) -> list[tuple[int, int]]:
    """(start, end) in raw of each place of the needle in normal form, from left to right, none overlapping."""
    want = normal_form(needle)[0].strip()
    if not want:
        return []
    text, starts, ends = normal_form(raw)
    out, at = [], text.find(want)
    while at >= 0:
        out.append((starts[at], ends[at + len(want) - 1]))
        at = text.find(want, at + len(want))
    return out


def in_segments(span: tuple[int, int], segments: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(segment, from, to) of the parts of a span in each segment it meets, from the segment's beginning."""
    cut = [(i, max(a, span[0]) - a, min(b, span[1]) - a) for i, (a, b) in enumerate(segments)]
    return [(i, a, b) for i, a, b in cut if a < b]


def nested(text: str) -> bool:
    open_: list[str] = []
    for number, way in _STYLE.findall(text):
        if way == "OPEN":
            open_.append(number)
        elif not open_ or open_.pop() != number:
            return False
    return not open_


def sentence_pieces(text: str, least: int = 180) -> list[str]:
    """A text in pieces of least characters or more that end with a sentence and whose style markers are closed; the last is the rest."""
    out, start = [], 0
    for m in _SENTENCE.finditer(text):
        if m.start() - start >= least and nested(text[start : m.start()]):
            out.append(text[start : m.start()])
            start = m.end()
    return [*out, text[start:]]


def compact(text: str) -> tuple[str, list[int]]:
    """(text without white space, offset of each character)."""
    at = [i for i, c in enumerate(text) if not c.isspace()]
    return "".join(text[i] for i in at), at
