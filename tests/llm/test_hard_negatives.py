import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from postweave.llm import hard_negatives as module
from postweave.llm.cover_tree import CoverTree
from postweave.llm.hard_negatives import hard_negatives, op12_hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every, width):
    """Every anchor against every row, in Python's whole numbers."""
    fine = {(i, label, tuple(math.floor(256 * c) for c in v)) for i, v, label in rows if i is not None and label is not None and v is not None
            and len(v) == width and all(c is not None and math.isfinite(c) for c in v)}
    out = set()
    for anchor, own, x in fine:
        if anchor % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i, label) for i, label, y in fine if i != anchor)
        for s, positive, _ in [t for t in scored if t[2] == own][:5]:
            hard = [t for t in scored if t[2] != own and 80 * -s <= 100 * -t[0] <= 100 * -s][:5]
            out |= {(anchor, positive, rank, i, -s, -t) for rank, (t, i, _) in enumerate(hard, 1)}
    return out


def got(df):
    rows = [tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def anchors(every):
    return lambda i: F.pmod(i, F.lit(every)) == 0


@pytest.fixture
def tiny_blocks(monkeypatch):
    monkeypatch.setattr(module, "PART_ENTRIES", 6 * 40)


def clusters(rng, width, number=700):
    centres = rng.normal(size=(12, width)) * 1.5
    return [(i, (centres[rng.integers(12)] + rng.normal(size=width) * 0.2).tolist(), int(rng.integers(4))) for i in range(number)]


def test_clusters_in_many_small_blocks(spark, tiny_blocks):
    rows = clusters(np.random.default_rng(1), 6)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(hard_negatives(df, anchors(10), sample_rows=90, leaf_rows=4)) == brute(rows, 10, 6)


def test_ties_copies_bad_rows_and_clashing_columns(spark, tiny_blocks):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-1, 2, 3) / 4).tolist(), int(rng.integers(3))) for i in range(400)]
    rows += [(1000 + i, [0.25, 0.25, 0.0], 1) for i in range(150)] + [(2000 + i, [0.25, 0.25, 0.0], 2) for i in range(90)] + rows[:40]
    rows += [(10, [0.5, 0.25, 0.25], 2), (4000, [0.0, 0.0, 0.0], 1), (-20, [0.3, 0.1, 0.2], 0)]
    rows += [(5000, None, 1), (5010, [], 1), (5020, [0.1, None, 0.2], 1), (5030, [float("nan"), 0.0, 0.0], 1), (5040, [0.1, 0.2, float("inf")], 2),
             (5050, [0.1, 0.2, 0.3], None), (None, [0.1, 0.2, 0.3], 1), (5060, [0.5] * 4, 1)]
    df = spark.createDataFrame([(*r, 1, "s", 7) for r in rows], SCHEMA + ", query int, score string, leaf int")
    assert got(hard_negatives(df, anchors(10), leaf_rows=3)) == brute(rows, 10, 3)


def test_fewer_rows_than_asked_and_none(spark):
    assert got(hard_negatives(spark.createDataFrame([], SCHEMA), anchors(10))) == set()
    assert got(hard_negatives(spark.createDataFrame([(10, None, 1)], SCHEMA), anchors(10))) == set()
    rows = [(10, [1.0, 0.0], 1), (1, [0.9, 0.0], 1), (2, [0.85, 0.1], 2), (3, [-1.0, 0.0], 1), (4, [0.0, 1.0], 2)]
    assert got(hard_negatives(spark.createDataFrame(rows[:1], SCHEMA), anchors(10))) == set()
    assert got(hard_negatives(spark.createDataFrame(rows, SCHEMA), anchors(10))) == brute(rows, 10, 2) != set()


def test_numbers_beyond_doubles_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(1, 10**6, 3) + rng.random(3)).tolist(), int(rng.integers(2))) for i in range(60)]
    assert got(hard_negatives(spark.createDataFrame(rows, SCHEMA), anchors(10), leaf_rows=2)) == brute(rows, 10, 3)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_whole_table_against_brute_force(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [(r.vec_id, [float(c) for c in r.embedding], (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert got(op12_hard_negatives(spark, folder)) == brute(rows, 100, 64)


def test_bounds_hold_and_clusters_are_passed_by():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 8)) * 3
    points = np.floor(256 * (centres[rng.integers(30, size=6000)] + rng.normal(size=(6000, 8)) * 0.05))
    tree = CoverTree(points[:400], float(np.linalg.norm(points, axis=1).max()))
    leaves = tree.route(points)
    radii, held = tree.distances(points, leaves)
    tree.measure(radii)
    assert sum(held.values()) == 6000
    queries = points[:50]
    scores, low, high = tree.bounds(queries)
    exact = queries @ points.T
    visited = 0
    for node, leaf in enumerate(tree.leaf_number):
        if tree.is_leaf[node] and (leaves == leaf).any():
            inside = exact[:, leaves == leaf]
            assert (inside >= low[:, node, None]).all() and (inside <= high[:, node, None]).all()
    for i in range(50):
        found, _ = tree.descend(scores[i].tolist(), low[i].tolist(), high[i].tolist(), [(-np.inf, np.inf)], [True] * 400, 6)
        best = set(leaves[np.argsort(-exact[i], kind="stable")[:6]])
        assert best <= set(found)
        visited += sum(held.get(leaf, 0) for leaf in found)
    assert visited < 50 * 6000 * 0.2  # most rows are never scored


def test_nets_cover_and_keep_their_distance():
    rng = np.random.default_rng(6)
    tree = CoverTree(rng.normal(size=(300, 4)), 10.0)
    assert sorted(np.concatenate([m for m in tree.members if m is not None]).tolist()) == list(range(300))
    for node, below in enumerate(tree.children):
        if below:
            centres = tree.lifted_sample[tree.centres[below]]
            gaps = np.linalg.norm(centres[:, None] - centres[None], axis=2)[np.triu_indices(len(below), 1)]
            own = tree.lifted_sample[tree.centre[node]]
            assert gaps.min() > 0 and np.linalg.norm(centres - own, axis=1).min() == 0
