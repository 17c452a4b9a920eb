"""Texts reduced to the passages where terms may stand, before the patterns that decide.

A pattern of many terms with conditions on their neighbours costs a regex engine hundreds of nanoseconds a character.
Here numpy marks the places that begin like one of the terms, whatever its case, and only what lies around them is kept,
with a neighbour at either end. A pattern that matches terms alone, and looks at one character beside them, finds the same
in the passages as in the text; it still decides.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

TILE_CHARS = 1 << 18  # of text looked at a time, but for a longer text
FIRST = 3  # characters of a term that are looked for
CODES = 0x110000
WORD_CHARACTERS = "A-Za-z0-9_"  # of those that are part of a word, the ASCII ones


def _folded(c: str) -> str:
    """A character as Java compares it without case: the upper-case form of one character, then the lower-case one."""
    upper = c.upper() if len(c.upper()) == 1 else c
    return "i" if upper == "İ" else upper.lower() if len(upper.lower()) == 1 else upper


@lru_cache
def _alike() -> dict[str, list[int]]:
    """Code points by their form without case, where there are several."""
    groups: dict[str, list[int]] = {}
    for code in range(0x20000):
        if not 0xD800 <= code < 0xE000:
            groups.setdefault(_folded(chr(code)), []).append(code)
    return {form: codes for form, codes in groups.items() if len(codes) > 1}


@dataclass(frozen=True)
class Marks:
    """What is looked for: numbers of code points (1 to 63), beginnings as numbers of three, characters inside of words."""

    numbers: dict[int, int]
    beginnings: tuple[tuple[int, ...], ...]
    longest: int
    inside: tuple[int, ...]
    dividers: tuple[int, int]  # stand for what was left out, without and with characters inside of words; in no term

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        numbers, inside, begins = np.zeros(CODES, np.uint8), np.zeros(CODES, bool), np.zeros((64,) * FIRST, bool)
        numbers[list(self.numbers)] = list(self.numbers.values())
        inside[list(self.inside)] = True
        for beginning in self.beginnings:
            begins[beginning] = True
        return numbers, inside, begins.ravel()


@lru_cache(maxsize=64)
def marks_of(terms: tuple[str, ...], letters: str = WORD_CHARACTERS) -> Marks | None:
    """None where texts cannot be reduced: an empty term, a class that Python does not know, or no characters left to divide passages."""
    forms = sorted({_folded(c) for term in terms for c in term})
    number = {form: 1 + i % 63 for i, form in enumerate(forms)}
    codes = {code: number[form] for form in forms for code in [ord(form), *_alike().get(form, [])]}
    codes |= {ord(c): number[_folded(c)] for term in terms for c in term}
    try:
        inside = tuple(ord(found[0]) for found in re.finditer(f"[{letters}]", "".join(map(chr, range(CODES)))))
    except re.error:
        return None
    dividers = tuple(next((c for c in those if c not in codes), None) for those in ([c for c in b"\n\t .;" if c not in inside], inside))
    if None in dividers or "" in terms:
        return None
    beginnings = tuple(sorted({tuple(number[_folded(c)] for c in term[:FIRST]) for term in terms}))
    return Marks(codes, beginnings, max(map(len, terms), default=0), inside, dividers)


def _reduced(texts: list[str], marks: Marks, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[str]:
    numbers, inside, begins = tables
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.concatenate([numbers[codes], np.zeros(FIRST - 1, np.uint8)]).astype(np.uint32)
    key = (n[:-2] << np.uint32(12)) | (n[1:-1] << np.uint32(6)) | n[2:]
    found = np.flatnonzero(begins[key])
    owner = np.searchsorted(ends, found, "right")
    first = ends[owner] - sizes[owner]
    # A term after a character inside of a word is none.
    free = (found == first) | ~inside[codes[found - 1]]
    found, owner, first = found[free], owner[free], first[free]
    if not len(found):
        return [""] * len(texts)
    low, high = np.maximum(found - 1, first), np.minimum(found + marks.longest + 1, ends[owner])
    # Passages that touch are one; ends ascend with beginnings inside a text.
    new = np.r_[True, (low[1:] > high[:-1]) | (owner[1:] != owner[:-1])]
    last = np.r_[new[1:], True]
    low, high, owner = low[new], high[last], owner[new]
    of_text = np.r_[True, owner[1:] != owner[:-1]]
    begin = ends[owner] - sizes[owner]
    before = np.where(of_text, begin, np.r_[0, high[:-1]])  # the end of what was kept before
    counted = np.concatenate([[0], np.cumsum(inside[codes])])
    letters_left_out = counted[low] > counted[before]
    lengths = high - low
    # Every passage with a divider before it, which is cut off again at the start of a text.
    starts = np.cumsum(lengths + 1) - lengths - 1
    out = np.empty(int((lengths + 1).sum()), np.uint32)
    out[starts] = np.where(letters_left_out, *marks.dividers[::-1])
    places = np.arange(len(out))
    body = np.ones(len(out), bool)
    body[starts] = False
    out[body] = codes[places[body] + np.repeat(low - starts - 1, lengths)]
    joined = out.tobytes().decode("utf-32-le", "surrogatepass")
    result, at = [""] * len(texts), np.flatnonzero(of_text)
    stops = np.append(starts[at[1:]], len(out))
    finals = high[np.append(at[1:], len(owner)) - 1]
    for text, start, stop, whole, end in zip(
            owner[at].tolist(), starts[at].tolist(), stops.tolist(), (low[at] == begin[at]).tolist(), (finals == ends[owner[at]]).tolist()):
        result[text] = joined[start + whole:stop] + ("" if end else chr(marks.dividers[1]))
    return result


def passages(text: Column, terms: Sequence[str], letters: str = WORD_CHARACTERS) -> Column:
    """The passages of ``text`` in which whole ``terms`` may stand, in order.

    ``letters`` is the inside of a regex class of characters that no term may follow. Between passages stands one of them
    if any was left out, else another character, so that the word after a term is still the one after it. Null stays null.
    """
    marks = marks_of(tuple(dict.fromkeys(terms)), letters)
    if marks is None:
        return text

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the tables, made once in a worker

    # Not over an iterator of batches: Spark sends the text once for several of these functions.
    @F.arrow_udf("string")
    def reduced(batch: pa.Array) -> pa.Array:
        if not held:
            held.append(marks.tables())
        out: list[str] = []
        tile: list[str] = []
        size = 0
        for raw in batch.cast(pa.binary()).to_pylist():
            tile.append((raw or b"").decode("utf-8", "replace"))
            size += len(tile[-1])
            if size >= TILE_CHARS:
                out += _reduced(tile, marks, held[0])
                tile, size = [], 0
        out += _reduced(tile, marks, held[0]) if tile else []
        return pa.array(out, pa.string(), mask=np.asarray(batch.is_null()))

    return reduced(text)
