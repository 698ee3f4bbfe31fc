"""Streams that act on batches: publication through a callable, and one row per slot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators.stored import BucketStore

PUBLISHED_SCHEMA = "key string, grp string, published_at timestamp"


def publish_batch(store: BucketStore, deliver: Callable[[DataFrame, int], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A (key, grp) pair is published at most once.  ``deliver`` returns the rows that arrived; only those are marked, the others are tried again
    when they come back.  Only the buckets of the batch's pairs are read, only those of delivered pairs are written."""
    def run(batch: DataFrame, n: int) -> None:
        wanted = batch.groupBy("key", "grp").agg(F.min("ts").alias("published_at"))
        buckets = [r[0] for r in wanted.select(store.bucket()).distinct().collect()]
        fresh = wanted.join(store.read(batch.sparkSession, n, buckets), ["key", "grp"], "left_anti").persist()
        arrived = deliver(fresh, n).select("key", "grp", "published_at").persist()
        store.upsert(arrived, n, lambda old, new: old.unionByName(new))
        arrived.unpersist()
        fresh.unpersist()
    return run


def first_within_grace(events: DataFrame, hours: int = V.GRACE_HOURS) -> DataFrame:
    """One row per (key, slot), dropping what comes later than the grace; state expires with the watermark."""
    return events.withWatermark("ts", f"{hours} hours").dropDuplicatesWithinWatermark(["key", "slot"])
