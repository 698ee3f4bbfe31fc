"""Whitening of embeddings: distributed centred covariance, a handful of leading components, a broadcast projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .eigen import leading_vectors
from .shared import hold, spread_out, table

_WIDE = 1 << 62  # whole numbers up to here are added up in 64 bits, larger ones as Python numbers
_LARGEST = (1 << 63) - 1
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integer_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, x): whole-numbered vectors floor(scale * c) of the rows whose vector has finite entries only."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where((F.size("vector") > 0) & F.coalesce(finite, F.lit(False))).select(
        "vec_id", F.transform("vector", lambda c: F.floor(c * F.lit(scale)).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _slices(batches: Iterator[pa.RecordBatch], entries: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of the batches with at most so many entries, and their vectors (the last column) as a matrix."""
    for batch in batches:
        if batch.num_rows:
            width = max(1, len(batch.column(batch.num_columns - 1)[0]))
            step = max(1, entries // width)
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                yield part, _matrix(part.column(part.num_columns - 1))


def _moments(fit: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each dimension."""
    def sums(batches):
        count, total = 0, None
        for _, x in _slices(batches):
            small = int(max(abs(int(x.max())), abs(int(x.min())))) * len(x) < _WIDE
            part = x.sum(axis=0).tolist() if small else x.astype(object).sum(axis=0).tolist()
            total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
            count += len(x)
        if count:
            values = [count, *total]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["i", "s"])
    rows = fit.select("x").mapInArrow(sums, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("i").collect()
    values = [int(r.s) for r in rows]  # one number for each dimension
    return (values[0], values[1:]) if values else (0, [])


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: 64-bit numbers where they fit, Python numbers otherwise."""
    bound = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(s) for s in sums)
    return x * n - np.array(sums, np.int64) if bound < _WIDE else x.astype(object) * n - np.array(sums, object)


def _means_apart(moved: np.ndarray, n: int) -> np.ndarray:
    return moved.astype(np.float64) / n if moved.dtype != object else (moved / n).astype(np.float64)


def _summed(fit: DataFrame, of) -> np.ndarray:
    """The sum over all rows of the square matrices ``of(x).T @ of(x)``, added up in each task first; collected with one row for each entry."""
    def products(batches):
        total = None
        for _, x in _slices(batches):
            rows = of(x)
            total = rows.T @ rows + (0 if total is None else total)
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])
    entries = fit.select("x").mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (entries.column(c).to_numpy() for c in ("i", "j", "v"))
    out = np.zeros((int(i.max()) + 1,) * 2)
    out[i, j] = out[j, i] = v
    return out


def whiten(vectors: DataFrame, components: int = 4, key: str = "vec_id", column: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Whitened leading components of every row: (vec_id, component, n, deviation, whitened, explained, identity_error).

    Vectors become whole numbers x = floor(scale * c).  The fit list holds each distinct x once, so copies don't weigh more; its size n and its
    sums S are exact.  The covariance of the centred list is added up in the tasks and collected (one number for each pair of dimensions, whatever
    the number of rows); its leading eigenvectors come from ``eigen.leading_vectors``, and every row is projected with them, ``components`` numbers a
    dimension.  ``deviation`` is the exact sum of (n * x - S)^2, or null beyond 64 bits; ``explained`` a component's share of the trace;
    ``identity_error`` how far the fit list's whitened covariance, measured on the list itself, is from the identity.

    Rows whose vector is null, empty, or holds null or non-finite entries, or has another dimension than most rows, take no part; a null id
    stays null and repeated rows all appear; entries too large for 64 bits stop at the largest number.  A component without any variance (one
    distinct vector, fewer vectors than components) can't be whitened and is left out; extra columns are ignored; no rows give no rows.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(spread_out(vectors), key, column, scale)
    shapes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not shapes:
        return spark.createDataFrame([], SCHEMA)
    rows = rows.where(F.size("x") == shapes[0].d)
    fit = hold(rows.select("x").distinct(), "fit")
    n, sums = _moments(fit)
    covariance = _summed(fit, lambda x: _means_apart(_centred(x, n, sums), n)) / n
    values, axes = leading_vectors(covariance, components)
    real = values > 64 * len(covariance) * np.finfo(float).eps * max(float(np.abs(covariance).max()), np.finfo(float).tiny)
    values, axes = values[real], axes[:, real]
    if not len(values):
        return spark.createDataFrame([], SCHEMA)
    project = spark.sparkContext.broadcast(axes / np.sqrt(values))  # dimensions x components

    def whitened(x):
        return _means_apart(_centred(x, n, sums), n) @ project.value
    error = float(np.abs(_summed(fit, whitened) / n - np.eye(len(values))).max())
    shares = values / float(np.trace(covariance))

    def projected(batches):
        for part, x in _slices(batches):
            moved = _centred(x, n, sums)
            wide = moved.dtype == object or int(max(abs(int(moved.max())), abs(int(moved.min())))) ** 2 * moved.shape[1] >= _WIDE
            far = ((moved.astype(object) if wide else moved) ** 2).sum(axis=1).tolist()
            far = [d if d <= _LARGEST else None for d in far]
            k = len(shares)
            out = _means_apart(moved, n) @ project.value
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n, np.int64)),
                pa.array(far, pa.int64()).take(at), pa.array(out.ravel()), pa.array(np.tile(shares, len(x))), pa.array(np.full(len(x) * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(projected, SCHEMA)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
