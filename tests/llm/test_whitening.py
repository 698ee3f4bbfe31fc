import numpy as np
import pytest

from postweave.llm.eigen import counts_below, leading_vectors, tridiagonal
from postweave.llm.whitening import op13_embedding_whitening, whiten


def brute(rows, k):
    """Whole-number sums in Python, eigenvectors by numpy's own solver."""
    fine = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    xs = [[int(np.floor(256 * float(c))) for c in v] for _, v in fine]
    fit = sorted({tuple(x) for x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums, strict=True)] for x in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = []
    for (i, _), x in zip(fine, xs, strict=True):
        moved = [n * c - s for c, s in zip(x, sums, strict=True)]
        out.append((i, n, sum(m * m for m in moved), np.array([m / n for m in moved]) @ axes[:, :k] / np.sqrt(values[:k])))
    return out, values / values.sum()


def compare(got, rows, k=4):
    want, shares = brute(rows, k)
    assert len(got) == len(want) * k
    by_key = {}
    for r in got:
        by_key.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    largest = [max(want, key=lambda row, c=c: abs(row[3][c])) for c in range(k)]
    signs = {c + 1: np.sign(row[3][c] * by_key[(row[0], row[2])][c + 1].whitened) for c, row in enumerate(largest)}
    for i, n, deviation, whitened in want:
        mine = by_key[(i, deviation)]
        assert sorted(mine) == list(range(1, k + 1))
        for c, w in enumerate(whitened, 1):
            r = mine[c]
            assert r.n == n and r.identity_error <= 1e-9 and abs(r.explained - shares[c - 1]) <= 1e-9 * shares[c - 1]
            assert abs(signs[c] * r.whitened - w) < 1e-9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table_equals_a_direct_solution(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    compare(op13_embedding_whitening(spark, folder).collect(), rows)


def test_copies_bad_rows_null_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(6) * [5, 4, 3, 2, 1, 1]).tolist()) for i in range(200)]
    rows += [(300 + i, rows[0][1]) for i in range(90)] + [rows[3], (None, rows[4][1]), (-7, [-0.0] * 6)]
    bad = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (904, [float("-inf")] * 6), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "s", 1) for i, v in rows + bad], "vec_id long, embedding array<double>, x string, n int")
    got = whiten(df).collect()
    unnamed = [r for r in got if r.vec_id is None]
    assert len(unnamed) == 4 and len([r for r in got if r.vec_id == 3]) == 8
    once = [r for r in rows if r[0] is not None and r is not rows[3]] + [rows[3]]
    seen = set()
    kept = [r for r in got if r.vec_id is not None and not ((r.vec_id, r.component) in seen or seen.add((r.vec_id, r.component)))]
    compare(kept, list({r[0]: r for r in once}.values()))


def test_too_little_variance_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).collect() == []
    assert whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []
    two = whiten(spark.createDataFrame([(1, [0.0, 1.0, 0.0]), (2, [1.0, 0.0, 0.0])], schema)).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9), round(r.explained, 9)) for r in two} == {
        (1, 1, 2, 131072, 1.0, 1.0), (2, 1, 2, 131072, 1.0, 1.0)}


def test_huge_entries_have_no_deviation(spark):
    got = whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.deviation is None) for r in got} == {(1, True), (2, True), (3, False)} and all(np.isfinite(r.whitened) for r in got)


@pytest.mark.parametrize("values", [[5, 3, 2, 1, 1, 1], [4, 4, 4, 4, 4], [7, 7 - 1e-12, 3, 3, 3, 0, 0], [2], [3, 1], [1, 0, 0, 0]])
def test_eigenvectors_of_clusters(values):
    rng = np.random.default_rng(len(values))
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    for matrix in (q * np.array(values, float) @ q.T, np.diag(np.array(values, float))):
        matrix = (matrix + matrix.T) / 2
        k = min(4, len(values))
        found, vectors = leading_vectors(matrix, k)
        assert np.allclose(found, sorted(values, reverse=True)[:k], atol=1e-12)
        assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
        assert np.allclose(matrix @ vectors, vectors * found, atol=1e-11)


def test_sturm_counts():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 30))
    a += a.T
    d, e, _ = tridiagonal(a)
    values = np.linalg.eigvalsh(a)
    shifts = np.array([-100.0, *(values[:-1] + values[1:]) / 2, 100.0])
    assert counts_below(d, e, shifts).tolist() == list(range(31))
