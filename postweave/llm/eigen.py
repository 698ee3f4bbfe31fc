"""Leading eigenvectors of a symmetric matrix: Householder tridiagonalisation, Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(float).eps)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors): ``matrix`` turned into a tridiagonal one by mirrors I - 2 v v'."""
    a = np.array(matrix, float)
    size = len(a)
    mirrors = []
    for k in range(size - 2):
        v = a[k + 1:, k].copy()
        length = np.linalg.norm(v)
        if not np.any(v[1:]):
            mirrors.append(np.zeros(size - k - 1))
            continue
        alpha = -length if v[0] >= 0 else length
        v[0] -= alpha
        v /= np.linalg.norm(v)
        inner = a[k + 1:, k + 1:]
        p = inner @ v
        w = p - (v @ p) * v
        inner -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = a[k, k + 1] = alpha
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def counts_below(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each shift: negative pivots of the Sturm sequence."""
    square = off * off
    tiny = np.finfo(float).tiny / _EPS * max(1.0, float(square.max(initial=0.0)))
    pivot = diagonal[0] - shifts
    below = (pivot < 0).astype(np.int64)
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[i] - shifts - square[i - 1] / pivot
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, number: int) -> np.ndarray:
    """The largest eigenvalues, falling, by bisection of all intervals at once."""
    size = len(diagonal)
    around = np.concatenate([np.abs(off), [0.0]]) + np.concatenate([[0.0], np.abs(off)])
    low = np.full(number, float((diagonal - around).min()) - _EPS)
    high = np.full(number, float((diagonal + around).max()) + _EPS)
    wanted = size - 1 - np.arange(number)  # so many eigenvalues lie below the j-th largest
    for _ in range(200):
        middle = (low + high) / 2
        above = counts_below(diagonal, off, middle) <= wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)
        if np.all(high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high))):
            break
    return (low + high) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """(T - shift) z = right by elimination with row exchange; a vanishing pivot becomes ``least``."""
    size = len(diagonal)
    d, first, second = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * size
    low, z = off.tolist(), right.tolist()
    for i in range(size - 1):
        if abs(low[i]) > abs(d[i]):
            factor = d[i] / low[i]
            d[i], first[i], second[i], d[i + 1], first[i + 1] = low[i], d[i + 1], first[i + 1], first[i] - factor * d[i + 1], -factor * first[i + 1]
            z[i], z[i + 1] = z[i + 1], z[i] - factor * z[i + 1]
        else:
            d[i] = d[i] or least
            factor = low[i] / d[i]
            d[i + 1] -= factor * first[i]
            z[i + 1] -= factor * z[i]
    for i in range(size - 1, -1, -1):
        rest = z[i] - (first[i] * z[i + 1] if i + 1 < size else 0.0) - (second[i] * z[i + 2] if i + 2 < size else 0.0)
        pivot = d[i] if abs(d[i]) > least else (least if d[i] >= 0 else -least)
        z[i] = rest / pivot
    return np.array(z)


def leading_vectors(matrix: np.ndarray, number: int, cluster: float = 1e-3, steps: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the ``number`` largest eigenvalues, falling.

    Vectors whose eigenvalues lie closer than ``cluster`` times the matrix's norm to their neighbour are kept at right angles to the whole
    cluster in each step of the inverse iteration, so repeated eigenvalues have orthogonal vectors, too.
    """
    size = len(matrix)
    number = min(number, size)
    scale = float(np.abs(matrix).max(initial=0.0))
    if not size or not scale:
        return np.zeros(number), np.eye(size)[:, :number]
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, number)
    norm = float(max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0)))
    rng = np.random.default_rng(1)
    found: list[np.ndarray] = []
    start = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > cluster * norm:
            start = j
        z = rng.standard_normal(size)
        for _ in range(steps):
            z = _solve(diagonal, off, float(value), z / np.linalg.norm(z), _EPS * norm)
            z /= np.abs(z).max()
            for _twice in range(2):
                for other in found[start:j]:
                    z -= (other @ z) * other
        found.append(z / np.linalg.norm(z))
    vectors = np.array(found).T.reshape(size, number)
    for k in range(len(mirrors) - 1, -1, -1):
        v = mirrors[k]
        vectors[k + 1:] -= 2 * np.outer(v, v @ vectors[k + 1:])
    return values * scale, vectors
