"""Sets of word shingles as arrays: tokens, keys that tell equal sets, parity bitmaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textgrid import blank_words, code_points, mix64, run_hashes

BITMAP_WORDS = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of all texts in a row, and how many each text has."""
    lowered = [t.translate(_LOWER) for t in texts]
    _, points, bounds = code_points(lowered)
    starts, ends, owner = blank_words(points, bounds)
    hashes = run_hashes(points, starts, ends)
    counts = np.bincount(owner, minlength=len(texts)).astype(np.int64) if len(owner) else np.zeros(len(texts), np.int64)
    begin = np.cumsum(counts) - counts
    span = np.minimum(counts, words)  # a shorter text is one shingle of all its words
    number = np.where(counts > 0, counts - span + 1, 0)
    total = int(number.sum())
    owner_of_shingle = np.repeat(np.arange(len(texts)), number)
    at = np.arange(total) + np.repeat(begin - (np.cumsum(number) - number), number)
    width = span[owner_of_shingle]
    value = mix64(width.astype(np.uint64) * _ODD)
    for i in range(words):
        more = width > i
        value[more] = mix64(value[more] * np.uint64(3) + hashes[at[more] + i])
    offset = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(number, out=offset[1:])
    for a, b in zip(offset[:-1].tolist(), offset[1:].tolist(), strict=True):
        if b - a > 1:
            value[a:b].sort()
    fresh = np.ones(total, bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner_of_shingle[1:] != owner_of_shingle[:-1])
    sizes = np.bincount(owner_of_shingle[fresh], minlength=len(texts)) if total else np.zeros(len(texts), np.int64)
    return value[fresh], sizes.astype(np.int64)


_LOWER = {c: c + 32 for c in range(65, 91)}


def lists(values: np.ndarray, sizes: np.ndarray, kind=pa.int64()) -> pa.ListArray:  # noqa: B008
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, kind))


def set_keys(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums of scrambled tokens for each set: together they tell equal sets from others."""
    out = np.zeros((2, len(sizes)), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        begin = (np.cumsum(sizes) - sizes)[full]
        out[0, full] = np.add.reduceat(mix64(values + _ODD), begin)
        out[1, full] = np.add.reduceat(mix64(values ^ (_ODD << np.uint64(1))), begin)
    return out[0].view(np.int64), out[1].view(np.int64)


def parity(values: np.ndarray, owner: np.ndarray, rows: int, words: int) -> np.ndarray:
    """A bitmap of ``words`` 64-bit words for each set; every token flips one bit."""
    width = 64 * words
    bit = ((values >> np.uint64(17)) % np.uint64(width)).astype(np.int64)
    flips = np.bincount(owner * width + bit, minlength=rows * width).reshape(rows, width) & 1
    return np.packbits(flips.astype(np.uint8), axis=1).view(np.int64)


def full_bags(chosen: DataFrame, words: int) -> DataFrame:
    """(node, n, tokens, bits) from (node, text, key_a, key_b): the whole sets of those rows whose keys are the node's, and parity bitmaps.

    Each token flips one bit, so tokens that two sets have in common cancel out, and the bits in which two bitmaps differ are at most as many as tokens in only one
    of the sets."""
    def run(batches):
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            wanted = [batch.column(c).to_numpy() for c in (2, 3)]
            begin = 0
            while begin < len(texts):
                end, total = begin, 0
                while end < len(texts) and (end == begin or (total + len(texts[end]) <= 1 << 20 and end - begin < 2048)):
                    total += len(texts[end])
                    end += 1
                values, sizes = shingle_sets(texts[begin:end], words)
                key_a, key_b = set_keys(values, sizes)
                packed = parity(values, np.repeat(np.arange(len(sizes)), sizes), len(sizes), BITMAP_WORDS).ravel()
                out = pa.RecordBatch.from_arrays(
                    [names.slice(begin, end - begin), pa.array(sizes), lists(values.view(np.int64), sizes),
                     lists(packed, np.full(len(sizes), BITMAP_WORDS))], ["node", "n", "tokens", "bits"])
                yield out.filter(pa.array((key_a == wanted[0][begin:end]) & (key_b == wanted[1][begin:end])))
                begin = end
    return chosen.select("node", "text", "key_a", "key_b").mapInArrow(run, "node long, n long, tokens array<long>, bits array<long>")
