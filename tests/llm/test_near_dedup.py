import random
import re

import pytest

from postweave.llm.components import components
from postweave.llm.near_dedup import match_threshold, near_duplicates

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, words, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    index = {}
    for i, s in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in index[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min(least.get(r, d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def family(rng, base, changes, n):
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_matches_brute_force_on_families_chains_and_shared_passages(spark, docs):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for size in (2, 5, 60):
        texts += family(rng, [word() for _ in range(80)], 5, size)
    passage = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(90)] + passage) for _ in range(60)]
    chain = [word() for _ in range(90)]
    for i in range(25):  # each like the one before, the ends unlike each other
        texts.append(" ".join(chain))
        chain = chain[:4 * i % 90] + [word() for _ in range(3)] + chain[4 * i % 90 + 3:]
    texts += ["", None, "  \t", "one", "ONE", "one two", "one  two", "Ä", "ä"] + ["same text of some words here"] * 20
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    result = near_duplicates(docs(rows), words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in result} == brute(rows, 4, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in result)


def test_default_is_five_words(docs):
    rows = [(1, "a b c d e f"), (2, "a b c d"), (3, "A b c d")]
    assert got(near_duplicates(docs(rows))) == {1: (2, 1), 2: (1, 2), 3: (1, 2)}


def test_whole_table_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(near_duplicates(df, words=4)) == brute(rows, 4, 80)


def test_null_ids_repeated_ids_and_empty_table(spark, docs):
    assert near_duplicates(docs([])).collect() == []
    out = near_duplicates(docs([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None)])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in out) == [(-1, -1, False), (-1, 7, False), (7, 7, True), (7, 7, True)]


def test_very_long_text(docs):
    long = " ".join(f"w{i}" for i in range(200_000))
    assert got(near_duplicates(docs([(1, long), (2, long + " end"), (3, "x")]))) == {1: (199996, 1), 2: (199997, 1), 3: (1, 3)}


def test_components_of_long_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(100, 400)] + [(1000, x) for x in range(1001, 1500)] + [(1499, 5), (7, 7)]
    found = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {i: 100 for i in range(101, 401)} | {i: 5 for i in range(1000, 1500)}
    assert found == want


@pytest.mark.parametrize("similarity,most", [(0.8, 36), (0.9, 46)])
def test_match_threshold(similarity, most):
    assert 1 <= match_threshold(similarity) <= most
