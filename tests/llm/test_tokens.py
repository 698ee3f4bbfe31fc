import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from postweave.llm.bpe_arrays import encoder
from postweave.llm.packing import best_two_fit, pack, slots_of
from postweave.llm.token_counts import count_tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def odd_texts():
    rng = random.Random(5)
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    signs = "ab's tré \n\t12!?'<|endoftext|> 漢ZYX\x1f​"
    texts = ["", " ", "  ", "a  b", "a \n b  ", "it's don't we'll they've I'm 'sup ''s x'd", "<|endoftext|>a<|endoftext|> <|endoftext|>", "'", " 's",
             "\n's", "a's's", "a" * 900, "ab" * 700, "漢字 ünï 👍🏽 ١٢٣ ½", "x\r\n\r\ny\x1c\x1dz\x85w", "\x00", "😀" * 200]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["a" + c + "b 1" + c + "2 ." + c + ". " + c + " x" for c in every[::97]]
    return texts + [" " + "".join(rng.choices(every, k=20)) for _ in range(300)]


def test_ids_equal_the_library(library):
    texts = odd_texts()
    flat, sizes = encoder().ids(texts)
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] == encoder().counts(texts).tolist()
    assert flat.tolist() == [i for w in want for i in w]


def test_words_are_forgotten_beyond_the_limit(library):
    from postweave.llm.bpe_arrays import Encoder
    small = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    small.words.most = 50
    for i in range(30):
        text = " ".join(f"word{i * j}x{j}" for j in range(40))
        assert small.counts([text]).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]


def test_counts_as_a_table(docs, library):
    rows = [(1, "Hello world"), (2, None), (3, ""), (3, "twice"), (None, "é" * 5000)]
    out = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs(rows)).collect()}
    n = len(library.encode("é" * 5000, add_special_tokens=False).ids)
    assert out == {(1, 11, 2, False), (2, 0, 0, False), (3, 0, 0, False), (3, 5, len(library.encode("twice").ids), False), (None, 10000, n, n > 512)}
    assert count_tokens(docs([])).collect() == []


def check_packing(placed, texts, library, capacity=1024):
    bins, by_doc = {}, {}
    for r in placed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    for d, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for i, r in enumerate(sorted(by_doc[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            assert r.length == capacity or i == 0
            at += r.length
        assert at == len(ids) and (len(ids) > capacity or len(by_doc[d]) == 1)
    return len(bins)


def test_packing_is_valid_and_tight(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    placed = pack(df).collect()
    bins = check_packing(placed, texts, library)
    assert bins <= 1.03 * sum(r.length for r in placed) / 1024 + 1  # 200 documents leave few pieces to choose from


def test_packing_odd_rows(docs, library):
    rows = [(1, None), (2, ""), (3, "word " * 3000), (4, "<|endoftext|>"), (5, "x")]
    check_packing(pack(docs(rows)).collect(), rows, library)
    assert pack(docs([])).collect() == []
    twice = pack(docs([(1, "same"), (1, "same"), (None, "same")])).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == 3


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once_and_few_bins(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(101, np.int64)
    np.add.at(counts, rng.integers(1, 101 if seed % 2 else 45, 3000), 1)
    plan = best_two_fit(counts, 100)
    used = np.zeros(101, np.int64)
    for bins, lengths in plan:
        assert sum(lengths) <= 100
        for length in lengths:
            used[length] += bins
    assert (used == counts).all()
    least = -(-int((counts * np.arange(101)).sum()) // 100)
    assert sum(b for b, _ in plan) <= max(least, int(counts[51:].sum())) * 1.02 + 1
    assert len(slots_of(plan)) == sum(len(x) for _, x in plan)


def test_smallest_gives_way_to_a_tighter_pair():
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = [1, 1, 2]  # greedy: 6+3, 2+2; better: 6+2+2, 3
    assert best_two_fit(counts, 10)[0] == (1, [6, 2, 2])
