"""BPE encoding and decoding through a table of distinct words: each is encoded once, its ids are joined back by position."""

from __future__ import annotations

import unicodedata
import zlib
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe_arrays import byte_letters
from .shared import blocks, spread_out, table, texts_of
from .textgrid import CONTRACTION, NUMBER, SPACE, classes, code_points, first_marks, gather, newer_signs, owner_of, run_hashes, with_contractions

VOCABULARY = "word_bpe_49k.json"
BLOCK_TEXT = 16 << 20  # code points of a block, which shares one word list
BLOCK_WORDS = 500_000  # distinct words of a block
_WORD = regex.compile(CONTRACTION + r"|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_SLICE = 1024  # documents that are put together at once
_CODES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
_PARTS = "block int, doc_id long, places binary, place int, word string"


class Model:
    """The vocabulary file: its library model for single words, its special strings, and the piece of every id."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.pieces = [""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.pieces[i] = piece
        self.piece_column = pa.array(self.pieces, pa.string())
        self.letters = {b: c for b, c in enumerate(byte_letters())}

    def encode_word(self, word: str) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        seen = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(seen)]


@cache
def model(name: str = VOCABULARY) -> Model:
    return Model(public_tokenizers.path(name))


def normal_form(text: str, coder: Model) -> str:
    """As the vocabulary's own normaliser: composed form, then lower case character by character."""
    if text.isascii():
        return text.lower()
    if not newer_signs().isdisjoint(text):
        return coder.tokenizer.normalizer.normalize_str(text)
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def split_words(texts: list[str], coder: Model) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts: joined normal text, code points, starts, ends, text of each; special strings are words of their own."""
    parts, owner, special = [], [], []
    for i, text in enumerate(texts):
        end = 0
        if any(s in text for s in coder.special):
            for m in coder.cut.finditer(text):
                parts += [normal_form(text[end:m.start()], coder), m[0]]
                owner += [i, i]
                special += [False, True]
                end = m.end()
        parts.append(normal_form(text[end:], coder))
        owner.append(i)
        special.append(False)
    joined, points, bounds = code_points(parts)
    if not len(points):
        none = np.zeros(0, np.int64)
        return joined, points, none, none, none
    kind = classes()[points]
    begins = first_marks(len(points), bounds) | (kind == NUMBER)
    begins[1:] |= kind[1:] != kind[:-1]
    whole = np.flatnonzero(special)
    # Texts with contractions are split by the published pattern, whose classes are those of the table below for all but the newest letters.
    for d in np.union1d(with_contractions(points, bounds), whole).tolist():
        a, b = int(bounds[d]), int(bounds[d + 1])
        inside = [a] if special[d] else [a + m.start() for m in _WORD.finditer(joined[a:b])]
        begins[a:b] = kind[a:b] == SPACE  # blanks begin a run of their own, so words end before them
        begins[inside] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(points))
    word = kind[starts] != SPACE
    starts, ends = starts[word], ends[word]
    return joined, points, starts, ends, np.array(owner, np.int64)[owner_of(starts, bounds)]


class _Block:
    """The word list of one block, in order of first use."""

    def __init__(self, number: int):
        self.number, self.words, self.size = number, [], 0
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def place(self, joined: str, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        new = np.flatnonzero(~known)
        new = new[np.argsort(first[new], kind="stable")]
        added = np.zeros(len(keys), np.int64)
        added[new] = len(self.words) + np.arange(len(new))
        self.words += [joined[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
        fresh = np.flatnonzero(~known)
        self.keys, self.places = np.insert(self.keys, at[fresh], keys[fresh]), np.insert(self.places, at[fresh], added[fresh])
        return self.places[np.searchsorted(self.keys, keys)][back]

    def rows(self) -> list[pa.RecordBatch]:
        n = len(self.words)
        none = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
        return [pa.RecordBatch.from_arrays([pa.array(np.full(n, self.number), pa.int32()), *none, pa.array(np.arange(n), pa.int32()),
                                            pa.array(self.words, pa.string())], ["block", "doc_id", "places", "place", "word"])]


def pack(places: np.ndarray) -> bytes:
    """Places as compressed bytes, the low bytes of all first: the high ones of frequent, early words are mostly zero."""
    return zlib.compress(places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def word_blocks(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Split whole texts: a row per document (its words as places in the block's list, packed) and a row per word of a block's list.

    Places follow the order of the rows in a partition.  They are sorted by id and text first, so that two evaluations number them alike in whatever order texts
    arrive: rows of one partition that compare equal are equal."""
    def split(batches):
        coder = model(vocabulary)
        base = TaskContext.get().partitionId() << 12
        block, number = None, 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in blocks([len(t) for t in texts]):
                if block is None:
                    block = _Block(base + number)
                    number += 1
                joined, points, starts, ends, owner = split_words(texts[a:b], coder)
                places = block.place(joined, run_hashes(points, starts, ends), starts, ends)
                counts = np.bincount(owner, minlength=b - a) if len(owner) else np.zeros(b - a, np.int64)
                end = np.cumsum(counts)
                packed = [pack(places[e - c:e]) for e, c in zip(end.tolist(), counts.tolist(), strict=True)]
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block.number), pa.int32()), pa.array(ids[a:b], pa.int64()), pa.array(packed, pa.binary()),
                     pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], ["block", "doc_id", "places", "place", "word"])
                block.size += len(joined)
                if block.size >= BLOCK_TEXT or len(block.words) >= BLOCK_WORDS:
                    yield from block.rows()
                    block = None
        if block is not None:
            yield from block.rows()
    return docs.withColumn("tie", F.xxhash64("text")).sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text").mapInArrow(split, _PARTS)


def encode_and_decode(documents: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode whole texts and decode the ids again: (doc_id, n_tokens, ids, decoded); ids are little-endian unsigned 32-bit.

    Texts are split in blocks with a word list each; the words of all lists meet sorted, so that every distinct word is encoded once, by
    the vocabulary's own model; its ids go back to the lists that have it, and are joined to the documents by block and place.  Decoding joins a block's ids
    with the table of pieces (bounded by the vocabulary, so each task holds it) and the pieces of a text with a blank, as this
    vocabulary's library does.  A word is met at most once per block, so no word and no block is a hot key.  The table is split twice, once for its words and
    once for its documents, with the same numbers; so it has to be a written table (or one whose partitions hold the same rows whenever they are made).
    Null text counts as empty (no ids, empty text); null or repeated ids stay row by row; other columns are ignored.
    """
    parts = word_blocks(spread_out(texts_of(documents, text, key)), vocabulary)
    words = parts.where("word is not null").select("block", "place", "word")
    words = words.repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word").sortWithinPartitions("word")

    def encode(batches):
        """Equal words stand together, so each is encoded when it comes up first; its ids go back to all lists that have it."""
        coder, last, ids = model(vocabulary), None, b""
        for batch in batches:
            coded = []
            for word in batch.column(2).to_pylist():
                if word != last:
                    last, ids = word, np.array(coder.encode_word(word), "<u4").tobytes()
                coded.append(ids)
            lists, places = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            order = np.argsort(lists, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(lists[order])) + 1, len(order)).tolist()
            rows, start = [], 0
            for end in ends if len(order) else []:
                some = order[start:end]
                own = [coded[i] for i in some.tolist()]
                raw = places[some].astype("<i4").tobytes() + np.array([len(x) // 4 for x in own], "<u4").tobytes() + b"".join(own)
                rows.append((int(lists[some[0]]), len(own), zlib.compress(raw, 1)))
                start = end
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["list", "n", "packed"])
    coded = words.mapInArrow(encode, "list int, n int, packed binary")

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces = model(vocabulary).piece_column
        places, sizes, ids = [np.zeros(0, "<i4")], [np.zeros(0, "<u4")], [np.zeros(0, "<u4")]
        for n, packed in zip(left.column("n").to_pylist(), left.column("packed").to_pylist(), strict=True):
            raw = zlib.decompress(packed)
            places.append(np.frombuffer(raw, "<i4", n))
            sizes.append(np.frombuffer(raw, "<u4", n, 4 * n))
            ids.append(np.frombuffer(raw, "<u4", offset=8 * n))
        place, size, flat = np.concatenate(places), np.concatenate(sizes).astype(np.int64), np.concatenate(ids)
        begin_of, size_of = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        begin_of[place], size_of[place] = np.cumsum(size) - size, size
        out = []
        for a in range(0, right.num_rows, _SLICE):
            part = right.slice(a, _SLICE)
            words = [unpack(raw) for raw in part.column("places").to_pylist()]
            at = np.concatenate(words)
            own = gather(flat, begin_of[at], size_of[at]).astype("<u4")
            end = np.cumsum([len(w) for w in words])
            bounds = np.append(0, np.append(0, np.cumsum(size_of[at]))[end])  # of each document's ids
            codes = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(own)])
            decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pieces.take(pa.array(own))), " ")
            out.append(pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(np.diff(bounds)), codes, decoded], schema=_CODES))
        return pa.Table.from_batches(out, _CODES)
    docs = parts.where("word is null").select("block", "doc_id", "places")
    return coded.groupBy("list").cogroup(docs.groupBy("block")).applyInArrow(
        assemble, "doc_id long, n_tokens long, ids binary, decoded string")


def decode_table(tokens: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """Decode a table of tokens (key, pos, id) by a join with the table of pieces: (key, decoded).  The pieces are bounded by the
    vocabulary file, so their broadcast is too; a document's tokens meet in one row, as its text must."""
    spark = tokens.sparkSession
    pieces = spark.createDataFrame(pd.DataFrame({"id": range(len(model(vocabulary).pieces)), "piece": model(vocabulary).pieces}))
    joined = tokens.select(F.col(key).alias("key"), "pos", F.col("id").cast("long").alias("id")).join(F.broadcast(pieces), "id")
    rows = joined.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    return rows.select(F.col("key").alias(key), F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("decoded"))


def op6_bpe_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_and_decode(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
