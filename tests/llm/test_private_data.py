import hashlib
import random
import re

import numpy as np
import pytest

from postweave.llm.private_data import (KINDS, LABELS, Field, Tagger, all_spans, base_spans, find_private, labelled_table, mask_text, masked, op8_private_data, tokens, train,
                                        viterbi, _allowed, _luhn, _unmark)

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def contract(text):
    """The patterns as they are given."""
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in (("card", CARD, 13, 19), ("phone", PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind == "phone" or _luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_on_random_signs():
    rng = random.Random(8)
    for signs in ("a.@-1 +", "0123456789.", "12 -4", "+1 ()-.9", "ab@c.d@e.f_%", "é1@x.yé", "0.1٣2"):
        for _ in range(4000):
            text = "".join(rng.choice(signs) for _ in range(rng.randrange(40)))
            assert sorted(base_spans(text)) == sorted(contract(text)), text


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a.b" * 100_000 + "@", "@" * 100_000, "1." * 100_000, "+1" + " " * 200_000):
        assert isinstance(base_spans(text), list)


def test_viterbi_equals_trying_all():
    rng = np.random.default_rng(3)
    k, n = 3, 5
    for _ in range(30):
        e, moves, first = rng.normal(size=(4, n, k)), rng.normal(size=(k, k)), rng.normal(size=k)
        lengths = rng.integers(1, n + 1, 4)
        labels = viterbi(e, lengths, moves, first)
        for s, length in enumerate(lengths):
            paths = np.stack(np.meshgrid(*[range(k)] * length, indexing="ij"), -1).reshape(-1, length)
            score = [first[p[0]] + sum(e[s, i, p[i]] for i in range(length)) + sum(moves[p[i - 1], p[i]] for i in range(1, length)) for p in paths]
            assert labels[s, :length].tolist() == paths[int(np.argmax(score))].tolist()


def test_field_learns_its_table_and_leaves_plain_sentences():
    tagger = Tagger(train())
    right = 0
    rows = [_unmark(r) for r in labelled_table()]
    for text, spans in rows:
        right += sorted(tagger.spans([text])[0]) == sorted(spans)
    assert right / len(rows) > 0.97


def test_held_out_sentences():
    tagger = Tagger(train())
    found = [tagger.spans([t])[0] for t in ("My name is Hugo Brandt.", "Phone: 555-0161", "Write to kim (at) depot (dot) example today.", "Contact: Vera Lindqvist")]
    assert [[s[0] for s in f] for f in found] == [["name"], ["phone"], ["email"], ["name"]]


def test_skipping_plain_sentences_changes_nothing(spark):
    field = train()
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()] + [_unmark(r)[0] for r in labelled_table()]
    fast, whole = Tagger(field), Tagger(field)
    quick = fast.spans(texts)
    whole.stretches = lambda e, sentence: (np.unique(sentence, return_index=True)[1], np.bincount(sentence))  # every sentence is decoded
    assert whole.spans(texts) == quick


@pytest.mark.parametrize("seed", range(12))
def test_stretches_hold_the_best_labelling_of_any_field(seed):
    """Random scores, with transitions that favour spans side by side in some of them: what lies outside the stretches is O in the best labelling, too."""
    rng = np.random.default_rng(seed)
    closed, closed_first = _allowed()
    k = len(LABELS)
    moves, first = rng.normal(size=(k, k)) * 1.5 + closed, rng.normal(size=k) + closed_first
    tagger = Tagger(Field(frozenset(), {}, moves, first))
    counts = rng.integers(1, 40, 60)
    sentence = np.repeat(np.arange(60), counts)
    e = rng.normal(size=(len(sentence), k)).astype(np.float32) * 1.2
    e[:, 0] += 1.5 + seed % 4
    begins = np.cumsum(counts) - counts
    at, length = tagger.stretches(e, sentence)
    assert seed % 4 < 2 or length.sum() < len(sentence)
    marked = np.zeros(len(sentence), np.int64)
    for b, n in zip(at, length, strict=True):
        before = first if b in begins else moves[0]
        marked[b:b + n] = viterbi(e[None, b:b + n], np.array([n]), moves, before)[0]
    for b, n in zip(begins, counts, strict=True):
        assert (viterbi(e[None, b:b + n], np.array([n]), moves, first)[0] == marked[b:b + n]).all()


def test_few_additions_on_clean_documents(spark):
    tagger = Tagger(train())
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    added = [(t[s[1]:s[2]], s[0]) for t, spans in zip(texts, all_spans(texts, tagger), strict=True) for s in spans if not s[3]]
    print(added[:20])
    assert len(added) <= 10


def test_query_digests(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in op8_private_data(spark, sf).collect():
        base = sorted(contract(texts[r.doc_id]), key=lambda s: (KINDS.index(s[0]), s[1]))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in KINDS[:4]]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


def test_odd_rows_and_masks(docs):
    rows = [(1, None), (2, ""), (None, "x@y.z 😀 x@y.zz"), (3, "+1 (555) 123-4567 or 4111 1111 1111 1111 or 10.0.0.1"), (3, "word " * 50_000)]
    out = find_private(docs(rows)).collect()
    assert len(out) == 5 and [len(r.spans) for r in out if r.doc_id in (1, 2)] == [0, 0]
    spans = next(r.spans for r in out if r.doc_id == 3 and r.spans)
    assert {s.kind for s in spans if s.base} >= {"ip", "phone"}
    assert find_private(docs([])).collect() == []
    texts = {(r.doc_id, r.text[:60] if r.text is not None else None, r.label) for r in masked(docs(rows)).collect()}
    assert (None, "[EMAIL] 😀 [EMAIL]", "x") in texts and (1, None, "x") in texts
    assert mask_text("abcdef", [("ip", 1, 3, True), ("card", 2, 4, True)]) == "a[IP]ef"
    assert LABELS[0] == "O" and tokens([""])[3].tolist() == []
