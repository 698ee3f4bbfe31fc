import tracemalloc

import numpy as np

from postweave.llm.quality import BUCKETS, LABELLERS, SAMPLE, Model, _in_blocks, estimate, fit, judged, kept, pattern_of, votes_of


def test_patterns_go_back_to_votes():
    votes = np.random.default_rng(0).integers(0, 3, (50, len(LABELLERS)))
    assert (votes_of(pattern_of(votes)) == votes).all()


def test_estimate_finds_accuracies_of_made_labellers():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    right = [0.95, 0.9, 0.7, 0.85, 0.6, 0.9, 0.8, 0.75]
    kinds = rng.integers(0, 8, len(truth))  # a bad text is of a kind that some labellers know well
    finds = [np.where((kinds == j) | (kinds == (j + 1) % 8), r, 0.05) for j, r in enumerate(right)]
    bad = [np.where(truth, rng.random(len(truth)) < 0.003, rng.random(len(truth)) < f) for f in finds]
    votes = np.stack([np.where(rng.random(len(truth)) < 0.1, 2, np.where(b, 0, 1)) for b in bad], axis=1)
    patterns, counts = np.unique(pattern_of(votes), return_counts=True)
    good, table, share = estimate(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.08  # one false alarm weighs much, so the share of bad texts comes out somewhat high
    for j in range(len(LABELLERS)):
        true = (votes[~truth, j] == 0).mean()
        assert abs(table[0, j, 0] - true) < 0.1 and table[1, j, 0] <= 0.0151
    by = dict(zip(patterns.tolist(), good.tolist(), strict=True))
    guess = np.array([by[p] for p in pattern_of(votes).tolist()]) > 0.5
    assert (guess == truth).mean() > 0.96 and guess[~truth].mean() < 0.1


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = judged(docs).select("doc_id", "quality_result.keep").join(labels, "doc_id").collect()
    good = [r.keep for r in rows if r.quality == 1]
    bad = [not r.keep for r in rows if r.quality == 0]
    print(sum(good) / len(good), sum(bad) / len(bad))
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) > 0.9


def test_spark_result_equals_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = fit(docs)
    rows = docs.select("doc_id", "text").collect()
    patterns, posterior, score = model.apply([r.text for r in rows])
    want = {r.doc_id: (p, q, s > 0) for r, p, q, s in zip(rows, patterns.tolist(), posterior.tolist(), score.tolist(), strict=True)}
    got = {r.doc_id: (r.quality_result.pattern, r.quality_result.posterior, r.quality_result.keep) for r in judged(docs, model).collect()}
    assert got == want and SAMPLE >= len(rows)


def test_odd_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, "  \n"), (None, "It was the best of times, and it was the worst of times."), (4, "x" * 300_000), (5, "€"), (5, "€")]
    df = docs(rows).withColumnRenamed("label", "quality_result")
    out = judged(df, fit(df), result="other").collect()
    assert [r.other.keep for r in out if r.doc_id in (1, 2, 3)] == [False] * 3 and len(out) == 7
    assert kept(df).columns == df.columns
    assert judged(docs([])).collect() == [] and kept(docs([])).count() == 0


def test_arrays_of_a_batch_stay_small():
    """A worker's arrays come on top of its batch, its vocabulary and the other worker of the executor (61 MB with blocks of 1 M code points)."""
    texts = ["Some plain words of a text. " * 400] * 120
    model = Model({}, {}, np.zeros(BUCKETS + 1), 0.5)
    model.apply(texts[:1])  # fills the tables of characters
    tracemalloc.start()
    for part in _in_blocks(texts):
        model.apply(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
