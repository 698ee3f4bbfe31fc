"""Best-two-fit packing of token sequences, planned on the histogram of piece lengths."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe_arrays import encoder
from .shared import by_blocks, hold, spread_out, table, texts_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def _best_pair(counts: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two lengths with the largest sum up to ``room`` (a length may be taken twice if there are two)."""
    lengths = np.flatnonzero(counts[:room + 1])
    if not len(lengths):
        return None
    fit = np.searchsorted(lengths, room - lengths, side="right") - 1
    at = np.arange(len(lengths))
    fit = np.where((fit == at) & (counts[lengths] < 2), fit - 1, fit)  # itself, but there is only one
    good = fit >= 0
    if not good.any():
        return None
    total = np.where(good, lengths + lengths[np.maximum(fit, 0)], -1)
    best = int(np.argmax(total))
    a, b = int(lengths[best]), int(lengths[fit[best]])
    return (a, b) if a >= b else (b, a)


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Plan bins for ``counts[length]`` pieces: (how many bins, lengths in each).

    A bin is filled greedily with the longest pieces that fit; then its smallest piece gives way to two unpacked ones as long as
    they fill the gap more tightly.  The same bin is repeated while all its lengths last, so the work depends on the
    number of different lengths, not on the number of pieces.
    """
    counts = counts.astype(np.int64).copy()
    plan = []
    top = capacity
    while True:
        while top and not counts[top]:
            top -= 1
        if not top:
            return plan
        inside, gap = [], capacity
        while gap:
            fits = np.flatnonzero(counts[1:gap + 1])
            if not len(fits):
                break
            length = int(fits[-1]) + 1
            inside.append(length)
            counts[length] -= 1
            gap -= length
        while gap and len(inside):
            smallest = min(inside)
            pair = _best_pair(counts, gap + smallest)
            if pair is None or sum(pair) <= smallest:
                break
            inside.remove(smallest)
            inside += pair
            counts[smallest] += 1
            counts[pair[0]] -= 1
            counts[pair[1]] -= 1
            gap += smallest - sum(pair)
        lengths, need = np.unique(inside, return_counts=True)
        more = int((counts[lengths] // need).min())
        counts[lengths] -= more * need
        plan.append((1 + more, sorted(inside, reverse=True)))


def slots_of(plan: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first bin, offset): the pieces of a length, by rank, go to consecutive bins from there on."""
    used: dict[int, int] = {}
    rows, first_bin = [], 0
    for bins, lengths in plan:
        offset = 0
        for length in lengths:
            rows.append((length, used.get(length, 0), first_bin, offset))
            used[length] = used.get(length, 0) + bins
            offset += length
        first_bin += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pieces_of(documents: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str = "byte_bpe_50k.json", text: str = "text",
              key: str = "doc_id") -> DataFrame:
    """Tokenise whole texts, end each with ``end_id``, and cut what is longer than a sequence; a cut document's first piece takes
    the odd length, so all its others are full."""
    def make():
        coder = encoder(vocabulary)

        def block(ids, texts):
            flat, sizes = coder.ids(texts)
            flat = np.insert(flat, np.cumsum(sizes), end_id).astype("<u4")
            sizes = sizes + 1
            number = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(ids)), number)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
            first = sizes - (number - 1) * capacity
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            at = (np.cumsum(sizes) - sizes)[doc] + start
            raw = memoryview(flat.tobytes())
            sums = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            keys = [ids[d] for d in doc.tolist()]
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
        return block
    return spread_out(texts_of(documents, text, key)).mapInArrow(by_blocks(make), PIECES)


def pack(documents: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str = "byte_bpe_50k.json", text: str = "text",
         key: str = "doc_id") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens: a row per piece with its sequence and offset.

    Pieces of one length are interchangeable, so best-two-fit runs over the whole table's histogram of lengths (at most
    ``capacity`` rows on the driver).  Every piece then finds its sequence from its rank among the pieces of its length. Ranks come from
    counts per (length, salt) and a row number inside; salts grow with the most frequent length, so no group is unbounded.  Null text
    is empty (one piece with the end id); rows with null or equal ids are packed row by row; extra columns are ignored; an
    empty table gives no pieces.
    """
    pieces = hold(pieces_of(documents, capacity, end_id, vocabulary, text, key), "pieces")
    found = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most one row per length
    counts = np.zeros(capacity + 1, np.int64)
    for row in found:
        counts[row.length] = row.n
    slots = slots_of(best_two_fit(counts, capacity))
    salts = max(256, int(counts.max()) // 50_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = groups.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("row", F.row_number().over(order) - 1).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("row")).alias("rank"))

    def place(batches):
        stride = 1 << 40
        steps = slots[:, 0] * stride + slots[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            slot = slots[np.searchsorted(steps, length * stride + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(slot[:, 2] + rank - slot[:, 1]), pa.array(slot[:, 3])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return ranked.mapInArrow(place, PLACED)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
