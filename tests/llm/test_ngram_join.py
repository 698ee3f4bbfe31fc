import random

import numpy as np
import pytest

from postweave.llm.ngram_join import bags, combinations, jaccard_components, least_common, op11_ngram_join, size_groups, subclasses
from postweave.llm.textgrid import mix64

from .test_near_dedup import brute, family


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("rare", [0, 2, 16])
def test_matches_brute_force_on_families_chains_and_shared_passages(docs, rare):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for size in (2, 6, 70):
        texts += family(rng, [word() for _ in range(90)], 4, size)
    texts += family(rng, [word() for _ in range(300)], 9, 25) + family(rng, [word() for _ in range(14)], 1, 15)
    passage = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(rng.randint(20, 90))] + passage) for _ in range(60)]
    chain = [word() for _ in range(90)]
    for i in range(25):  # each like the one before, the ends unlike each other
        texts.append(" ".join(chain))
        chain = chain[:4 * i % 90] + [word() for _ in range(2)] + chain[4 * i % 90 + 2:]
    texts += ["", None, "  \t", "one", "ONE", "one two", "one  two", "Ä", "ä"] + ["same text of some words here"] * 20
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert got(jaccard_components(docs(rows), words=4, similarity=0.85, rare=rare)) == brute(rows, 4, 85)


@pytest.mark.parametrize("words,percent", [(5, 80), (3, 50), (2, 95)])
def test_other_thresholds(docs, words, percent):
    rng = random.Random(percent)
    texts = []
    for length in (3, 5, 8, 17, 40, 120):
        for _ in range(4):
            texts += family(rng, [f"w{rng.randrange(40 if length < 10 else 3000)}" for _ in range(length)], max(1, length // 10), 6)
    rows = list(enumerate(texts))
    assert got(jaccard_components(docs(rows), words=words, similarity=percent / 100, rare=3)) == brute(rows, words, percent)


def test_whole_table_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op11_ngram_join(spark, folder)) == brute(rows, 4, 85)


def test_null_ids_repeated_ids_and_empty_table(spark, docs):
    assert jaccard_components(docs([])).collect() == []
    long = " ".join(f"w{i}" for i in range(60))
    near = long + " end"
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None), (9, long), (9, "x y"), (8, near), (9, long), (None, "q r s")]
    out = jaccard_components(docs(rows)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in out) == [
        (-1, 0, -1), (-1, 1, -1), (-1, 2, 7), (7, 2, 7), (7, 2, 7), (8, 57, 8), (9, 1, 9), (9, 56, 8), (9, 56, 8)]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e", 1, 2, 3), (2, "a b c d e", 4, 5, 6)], "doc_id long, text string, node int, key_a int, label int")
    assert got(jaccard_components(df)) == {1: (1, 1), 2: (1, 1)}


def test_very_long_text(docs):
    long = " ".join(f"w{i}" for i in range(200_000))
    assert got(jaccard_components(docs([(1, long), (2, long + " end"), (3, "x")]))) == {1: (199996, 1), 2: (199997, 1), 3: (1, 3)}


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_linked_sets_always_share_a_combination(percent):
    rng = np.random.default_rng(percent)
    universe = mix64(np.arange(1, 4000, dtype=np.uint64)).view(np.int64)
    for _ in range(300):
        n = int(rng.integers(2, 400))
        x = rng.choice(len(universe), n, replace=False)
        y = x[int(rng.integers(0, max(1, n - least_common(n, percent) + 1))):]
        fresh = int(rng.integers(0, 1 + max(0, len(y) * (100 - percent) // 200)))
        y = np.union1d(y, rng.choice(len(universe), fresh, replace=False))
        common = len(np.intersect1d(x, y))
        if 100 * common < percent * (len(x) + len(y) - common):
            continue
        often = rng.integers(2, 60, len(universe))  # the same for both sets, as it is counted over all
        alone = np.setxor1d(x, y)[rng.random(len(np.setxor1d(x, y))) < 0.5]  # held by no other set
        keys = []
        for z in (x, y):
            shared = np.setdiff1d(z, alone)
            keys.append(set(combinations(universe[shared], often[shared], len(z), percent)[0].tolist()))
        assert keys[0] & keys[1] or (set(x.tolist()) == set(y.tolist()))


def test_whole_sets_have_enough_classes():
    for percent in range(50, 101):
        for n in range(1, 3000):
            for group in size_groups(n, percent):
                assert group < 2 or subclasses(group, percent) < least_common(n, percent)


def test_combinations_grow_with_the_text_only():
    for n in (100, 1000, 20_000):
        tokens = mix64(np.arange(n, dtype=np.uint64)).view(np.int64)
        keys, _ = combinations(tokens, np.full(n, 1000), n, 85)
        assert len(keys) < 4 * n


def test_low_prefix_sizes(spark):
    row = bags(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(103)))], "doc_id long, text string"), 4, 85).first()
    assert row.n_shingles == 100 and len(row.low) == 100 - 85 + 10
