import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postweave.llm.neighbours import Forest, nearest, op9_nearest_neighbours, visits_for


def brute(rows, wanted, k):
    fine = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in wanted:
        if q in fine:
            near = sorted(((float(fine[q] @ v), i) for i, v in fine.items() if i != q), key=lambda s: (-s[0], s[1]))
            out[q] = near[:k]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def test_small_table_is_exact_with_ties_copies_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)]
    rows += [(400 + i, [1.0, 2.0, 0.0, 1.0]) for i in range(120)]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 4), (1003, [1.0, None, 0.0, 0.0]), (1004, [float("nan")] * 4), (1005, [float("inf"), 0.0, 0.0, 1.0]), (1006, [1.0, 2.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, "s") for i, v in rows], "vec_id long, embedding array<double>, score string")
    want = brute([r for r in rows if r[0] != 1006], [i for i, _ in rows if i is not None and i % 5 == 0], 20)
    assert got(nearest(df, lambda i: F.pmod(i, F.lit(5)) == 0, visits=10**9)) == want


def test_fewer_candidates_than_asked_and_empty_table(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert got(nearest(df, lambda i: F.pmod(i, F.lit(20)) == 0)) == {0: [(0.5, 20), (0.0, 3)], 20: [(0.5, 0), (0.5, 3)]}
    assert nearest(df.limit(0), lambda i: i == 0).collect() == []
    assert nearest(df, lambda i: i == 77).collect() == []


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_recall_against_brute_force(spark, name):
    sf = f"/root/testdata/{name}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    found = got(op9_nearest_neighbours(spark, sf))
    hits = sum(len({v for _, v in found[q]} & {v for _, v in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, near in found.items():
        assert len(near) == min(20, len(rows) - 1) and all(v != q for _, v in near)
        exact = {v: s for s, v in near}
        vectors = dict(rows)
        for v, s in exact.items():
            assert abs(s - float(np.dot(np.array(vectors[q], float), np.array(vectors[v], float)))) < 1e-12


def test_forest_puts_points_into_their_leaves():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(2000, 8)).astype(np.float32)
    forest = Forest(points, 2000, 3, 50, float(np.linalg.norm(points, axis=1).max()))
    leaves = forest.leaves(points)
    for leaf, inside in enumerate(forest.leaf_points):
        assert (leaves[inside, forest.leaf_tree[leaf]] == leaf).all()
    found = next(forest.search(points[:1], [len(p) for p in forest.leaf_points], 10**9))
    assert sorted(found) == list(range(len(forest.leaf_tree)))
    assert visits_for(10_000) < 10_000 and visits_for(10**9) < 10**8


def test_many_buckets_of_several_parts(spark, monkeypatch):
    """Hundreds of buckets that are split: a plan that grows with them would not run."""
    from postweave.llm import neighbours as module
    monkeypatch.setattr(module, "BUCKET_LEAVES", 1)
    monkeypatch.setattr(module, "PART_ROWS", 2)
    monkeypatch.setattr(module, "_MARGINS", 64)
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-50, 50, 6).astype(float).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(nearest(df, lambda i: F.pmod(i, F.lit(50)) == 0, trees=8, leaf_rows=10, visits=10**9)) == brute(rows, [i for i, _ in rows if i % 50 == 0], 20)
