"""Whole blocks of texts as numpy arrays of code points: splitting into runs and hashing them without a loop over words."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import regex
from tokenizers import Regex, pre_tokenizers

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_ODD = np.uint64(0x9E3779B97F4A7C15)
# Contractions that the two byte-pair vocabularies split off; part of their published pattern (fixed values).
_LETTER_OR_NUMBER = regex.compile(r"[\p{L}\p{N}]")
CONTRACTION = r"'s|'t|'re|'ve|'m|'ll|'d"


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined text, its code points, and the bounds of each text (one more than there are texts)."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return joined, points, bounds


@cache
def classes() -> np.ndarray:
    """White space, letter, number or other, for every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[m.start():m.end()] = kind
    for c, kind in _newer_letters().items():
        table[c] = kind
    return table


@cache
def _newer_letters() -> dict[int, int]:
    """Letters and numbers that are younger than Python's own Unicode tables: there the tokenizers library is asked, since the regex
    modules and the library may follow different versions of the standard."""
    young = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn" and _LETTER_OR_NUMBER.match(chr(c))]
    split = pre_tokenizers.Split(Regex(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"), "removed", invert=True)
    def joined(frame: str) -> set[int]:
        """Numbers of those that hang together with the sign on both sides."""
        pieces = split.pre_tokenize_str("".join(f"{frame}{chr(c)}{frame} " for c in young))
        return {start // 4 for _, (start, end) in pieces if end - start == 3}
    letters, others = joined("a"), joined(".")
    return {c: LETTER if i in letters else OTHER if i in others else NUMBER for i, c in enumerate(young)}


@cache
def newer_signs() -> frozenset[str]:
    """A text with one of these is normalised by the library itself."""
    return frozenset(chr(c) for c in _newer_letters())


def first_marks(n: int, bounds: np.ndarray) -> np.ndarray:
    """True where a text begins."""
    marks = np.zeros(n, bool)
    starts = bounds[:-1]
    marks[starts[starts < bounds[1:]]] = True
    return marks


def owner_of(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The text that each position lies in."""
    return np.searchsorted(bounds, starts, side="right") - 1


def run_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run [start, end): the sum of scrambled (code point, place) pairs.  Runs ascend, don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    if int(lengths.sum()) == len(points):
        places, values = np.arange(len(points)), points
    else:
        offset = np.cumsum(lengths) - lengths
        places = np.arange(int(lengths.sum())) + np.repeat(starts - offset, lengths)
        values = points[places]
    offset = np.cumsum(lengths) - lengths
    inside = (places - np.repeat(starts, lengths)).astype(np.uint64)
    mixed = mix64((inside + np.uint64(1)) * _ODD + values)
    return mix64(np.add.reduceat(mixed, offset) + lengths.astype(np.uint64))


def blank_words(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between blanks (0x20, 0x09-0x0D): starts, ends and the text each lies in."""
    word = (points != 32) & ((points < 9) | (points > 13))
    first = first_marks(len(points), bounds)
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (first | ~before))
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:] & ~first[1:]
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, owner_of(starts, bounds)


def with_contractions(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts in which an apostrophe stands before a letter that may begin a contraction."""
    quotes = np.flatnonzero(points[:-1] == 39) if len(points) else np.zeros(0, np.int64)
    if not len(quotes):
        return quotes
    return np.unique(owner_of(quotes[np.isin(points[quotes + 1], [ord(c) for c in "strvmld"])], bounds))


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated slices values[start : start + length]."""
    total = int(lengths.sum())
    offset = np.cumsum(lengths) - lengths
    return values[np.arange(total) + np.repeat(starts - offset, lengths)]
