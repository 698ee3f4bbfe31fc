import re

import corpus_pipeline
from postweave.llm.private_data import Tagger, all_spans, mask_text, train
from postweave.llm.quality import fit

from .test_near_dedup import brute
from .test_tokens import check_packing


def by_hand(spark, docs):
    """The first three stages in plain Python."""
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    score = fit(docs).apply([t or "" for _, t in rows])[2]
    rows = [r for r, s in zip(rows, score, strict=True) if s > 0]
    classes = brute(rows, 5, 80)
    rows = [r for r in rows if classes[r[0]][1] == r[0]]
    texts = [t for _, t in rows]
    return [(d, mask_text(t, s)) for (d, t), s in zip(rows, all_spans(texts, Tagger(train())), strict=True)]


def test_stages_against_plain_python(spark):
    from tokenizers import Tokenizer
    import public_tokenizers
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = by_hand(spark, docs)
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, state = state, stage(spark, state, sf)
        assert state.columns == docs.columns and 0 < state.count() <= before.count(), name
    assert sorted((r.doc_id, r.text) for r in state.collect()) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in state.collect())
    placed = corpus_pipeline.run(spark, sf).collect()
    check_packing(placed, want, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert {r.doc_id for r in placed} == {d for d, _ in want}


def test_odd_documents(spark):
    text = "It was the best of times, and it was the worst of times for all of us."
    rows = [(1, text, "x", 5), (1, text, "x", 5), (2, text + " Really.", None, None), (None, text, "x", 1), (None, text, "x", 1), (3, None, "x", 0), (4, "", "x", 0)]
    state = spark.createDataFrame(rows, "doc_id long, text string, keep string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, "")
    assert sorted((r.doc_id or 0) for r in state.collect()) in ([0, 1], [0, 1, 2])
    empty = state.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0
    assert corpus_pipeline.ORACLE_SQL is None and re.match("quality", corpus_pipeline.STAGES[0][0])


def test_kept_texts_are_joined_alike_at_every_size(spark):
    """A broadcast on small tables only made the shuffle grow faster than the input."""
    rows = [(i, f"text {i} of some words that no other one has {i * i}", "x", 1) for i in range(20)] + [(None, "a b c", "x", 1), (30, "text 3 of some words that no other one has 9", "x", 1)]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, keep string, n_chars long"), "")
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in out.collect()) == [-1, *range(20)]
    joins = re.findall(r"(\w+Join) .*LeftSemi", out._jdf.queryExecution().executedPlan().toString())
    assert joins and set(joins) == {"SortMergeJoin"}
