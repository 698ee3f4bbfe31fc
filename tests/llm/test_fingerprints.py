import hashlib
import random

import regex

from postweave.llm.fingerprints import ANCHORS, fingerprints_with_edits, signatures, similar_pairs


def plain_signatures(text):
    """The rule once more, word by word."""
    words = regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).strip().split(" ")
    words = [w for w in words if w]
    stop, out, i = set(ANCHORS), set(), 0
    while i < len(words):
        if words[i] in stop:
            chain = []
            while len(chain) < 3 and i + 1 + len(chain) < len(words) and words[i + 1 + len(chain)] not in stop:
                chain.append(words[i + 1 + len(chain)])
            if len(chain) >= 2:
                out.add(" ".join([words[i], *chain]))
                i += 1 + len(chain)
                continue
        i += 1
    if not out and len(words) >= 3:
        out = {" ".join(words[i:i + 3]) for i in range(len(words) - 2)}
    return out or ({" ".join(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, out):
    order = sorted(rows, key=lambda r: -r[0])
    following = {order[i][0]: order[(i + 1) % len(order)][1] or "" for i in range(len(order))}
    prints = {}
    assert len(out) == len(rows)
    for r in out:
        text = dict(rows)[r.doc_id] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + following[r.doc_id][:third]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = plain_signatures(text), plain_signatures(edited), plain_signatures(following[r.doc_id])
        assert abs(r.near_edited - jaccard(a, b)) < 1e-12 and abs(r.near_next - jaccard(a, c)) < 1e-12
        assert int(r.fingerprint.split(":")[0]) == len(a) and int(r.edited_fingerprint.split(":")[0]) == len(b)
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint


def test_whole_table_against_plain_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], fingerprints_with_edits(df).collect())


def test_odd_rows(docs):
    rng = random.Random(2)
    rows = [(10, None), (-5, ""), (7, "of"), (8, "  ?!"), (9, "漢字 ünï 😀😀😀 the big red"), (2**62, "the quick brown fox of old"), (-2**62, "the quick brown fox of old"), (11, "a b"), (12, "x y z w")]
    rows += [(100 + 3 * i, " ".join(rng.choice(ANCHORS + [f"w{rng.randrange(50)}"] * 60) for _ in range(rng.randrange(80)))) for i in range(60)]
    rows.append((5000, "the " + "longword" * 40_000 + " and so on " + "many words here " * 5_000))
    check(rows, fingerprints_with_edits(docs(rows)).collect())
    assert fingerprints_with_edits(docs([])).collect() == []
    only = fingerprints_with_edits(docs([(1, "the only one here")])).collect()[0]
    assert only.near_next == 1.0
    same = fingerprints_with_edits(docs([(None, "a b c"), (None, "d e f"), (1, "g h i"), (1, "g h i")])).collect()
    assert len(same) == 4


def test_similar_pairs_against_brute_force(docs):
    rng = random.Random(4)
    rows = []
    for f in range(8):
        base = [rng.choice(ANCHORS[:20]) if i % 3 == 0 else f"c{f}x{rng.randrange(10**6)}" for i in range(rng.choice([30, 120, 300]))]
        for _ in range(6):
            words = base[:]
            for _ in range(rng.randrange(12)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, None), (None, rows[0][1])]
    pairs, members = similar_pairs(docs(rows), 0.8)
    named = [(i, plain_signatures(t or "")) for i, t in rows if i is not None]
    first = {}
    for i, s in named:
        first.setdefault(frozenset(s), i)
    want = {(a, b) for (sa, a) in first.items() for (sb, b) in first.items() if a < b and sa and sb and jaccard(sa, sb) >= 0.8}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
    assert {r.doc_id: r["class"] for r in members.collect()} == {i: first[frozenset(s)] for i, s in named if s}


def test_signatures_as_a_column(docs):
    from pyspark.sql import functions as F
    n = docs([(1, "Is the river  bank, wide open of IT")]).select(F.size(signatures(F.col("text")))).first()[0]
    assert n == len(plain_signatures("Is the river  bank, wide open of IT")) == 1


def plain_stretches(text):
    """Spots, and the runs of three words outside them, word by word."""
    words, stop = regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).split(), set(ANCHORS)
    out, i, free = set(), 0, []
    while i < len(words):
        n = 0
        while words[i] in stop and n < 3 and i + 1 + n < len(words) and words[i + 1 + n] not in stop:
            n += 1
        if n >= 2:
            out.add(" ".join(words[i:i + 1 + n]))
            free, i = [], i + 1 + n
            continue
        free, i = [*free[-2:], words[i]], i + 1
        if len(free) == 3:
            out.add(" ".join(free))
    return out or ({" ".join(words)} if words else set())


def test_every_stretch_counts(spark, tmp_path):
    """List-like texts: one spot, or an edit that brings the first, must not silence the rest."""
    from postweave.llm.fingerprints import op7_fingerprints
    rng = random.Random(9)
    listed = " ".join(f"item{i:02}" for i in range(42))
    rows = [(1, "it is the one spot here and of to it"), (2, "the big red house stands by the old oak tree"), (3, listed), (4, listed + " of two words"), (5, None), (6, "?"), (7, "a b")]
    rows += [(100 + i, " ".join(rng.choice(ANCHORS + [f"w{rng.randrange(50)}"] * rng.choice([1, 20, 400])) for _ in range(rng.randrange(80)))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in op7_fingerprints(spark, str(tmp_path)).collect()}
    texts = {i: t or "" for i, t in rows}
    order = sorted(texts, reverse=True)
    for d, following in zip(order, order[1:] + order[:1], strict=True):
        third = len(texts[d]) // 3
        a, b = plain_stretches(texts[d]), plain_stretches(texts[d][:len(texts[d]) - third] + texts[following][:third])
        assert int(out[d].fingerprint.split(":")[0]) == len(a) and int(out[d].edited_fingerprint.split(":")[0]) == len(b), texts[d]
        assert abs(out[d].near_edited - jaccard(a, b)) < 1e-12 and abs(out[d].near_next - jaccard(a, plain_stretches(texts[following]))) < 1e-12
    assert out[3].near_edited > 0.3 and out[4].near_next > 0.9
