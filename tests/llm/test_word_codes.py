import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from postweave.llm.word_codes import decode_table, encode_and_decode


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(df, rows, library):
    out = {r.doc_id: r for r in df.collect()}
    assert len(out) == len(rows)
    for d, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        got = np.frombuffer(out[d].ids, "<u4").tolist()
        assert got == ids and out[d].n_tokens == len(ids), (text or "")[:200]
        assert out[d].decoded == library.decode(ids, skip_special_tokens=False)


def test_odd_texts_equal_the_library(docs, library):
    rng = random.Random(6)
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    signs = "ab's TRÉ \n\t12!?'<|endoftext|>İΣß 漢ZYX\x1f​e\u0301"
    texts = [None, "", " ", "Hello, World's 12 apples", "<|startoftext|>A<|endoftext|>b", "it's DON'T we'LL 'S ''s x'd", "ΑΣ Σ ΣΑΣ", "İstanbul", "e\u0301 A\u030a", "a" * 3000, "😀👍🏽", "ﬁ ½ ٣"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["a" + c + "b 1" + c + "2 ." + c + ". " + c + " x" for c in every[::211]]
    texts += [" " + "".join(rng.choices(every, k=20)) for _ in range(200)]
    rows = list(enumerate(texts))
    check(encode_and_decode(docs(rows)), rows, library)


def test_whole_table(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(encode_and_decode(df), [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], library)


def test_repeated_rows_and_empty_table(docs):
    assert encode_and_decode(docs([])).collect() == []
    out = encode_and_decode(docs([(1, "same"), (1, "same"), (None, "same"), (None, None)])).collect()
    assert sorted(r.n_tokens for r in out) == [0, 1, 1, 1]


def test_small_blocks(docs, library, monkeypatch):
    from postweave.llm import word_codes
    rows = [(i, f"word{i} of number {i * i} and more") for i in range(300)]
    check(encode_and_decode(docs(rows)), rows, library)
    block = word_codes._Block(0)
    assert block.place("", *(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64))).tolist() == []


def test_decode_by_a_join(spark, library):
    ids = library.encode("Decode this text, please 42", add_special_tokens=False).ids
    tokens = spark.createDataFrame([(7, i, t) for i, t in enumerate(ids)][::-1], "doc_id long, pos int, id int")
    assert decode_table(tokens).collect()[0].decoded == library.decode(ids, skip_special_tokens=False)


def test_order_of_arrival_may_change_between_evaluations(spark, library):
    """After a shuffle the texts of a partition come in another order each time the table is computed."""
    rows = [(i, f"word{i} of number {i * i} and more like {i % 7}x") for i in range(400)]

    def shuffled(batches):
        mixed = pa.Table.from_batches(batches)
        yield from mixed.take(pa.array(np.random.default_rng().permutation(mixed.num_rows))).combine_chunks().to_batches()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8).mapInArrow(shuffled, "doc_id long, text string")
    check(encode_and_decode(df), rows, library)
