"""Connected components by alternating large and small stars; a node's neighbours are never gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hold


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node reachable; nodes that are their own label, or in no pair, are left out.

    Each round hangs larger neighbours on a node's smallest neighbour; the minima are combined before the shuffle, and the joins back
    are on equal keys, so Spark may split the rows of a node with very many neighbours.  Rounds grow with the logarithm of the longest chain.
    """
    edges = hold(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = hold(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
