"""Helpers shared by the operators: table input, intermediate tables in the shared folder, Arrow batches in bounded blocks."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

BLOCK_CHARS = 1 << 18  # code points handled at once by the array code, whose arrays take some 60 bytes for each; one longer text is a block of its own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_out(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than the cluster has cores (small files) is dealt out evenly; otherwise nothing happens."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def texts_of(documents: DataFrame, text: str = "text", key: str = "doc_id", extra: list[str] | None = None) -> DataFrame:
    """Key and text only, null text as empty; other columns, whatever their names, go no further."""
    columns = [F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    return documents.select(*columns, *[F.col(c) for c in extra or []])


def hold(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors, is read by column."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    free_shuffles(spark)
    held = spark.read.schema(df.schema).parquet(folder)
    held.held_folder = folder
    return held


def discard(*tables: DataFrame) -> None:
    """Delete tables written by ``hold`` that no later result reads."""
    for df in tables:
        if folder := getattr(df, "held_folder", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished jobs when the driver's garbage is collected; long jobs do it between steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def blocks(sizes: list[int], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows whose sizes add up to at most ``limit`` (or a single larger row)."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


def by_blocks(make: Callable[[], Callable[[list[int], list[str]], pa.RecordBatch | None]]):
    """A ``mapInArrow`` function over (doc_id, text): ``make()`` runs once per task and gives the function for a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or make()
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in blocks([len(t) for t in texts]):
                out = work(ids[a:b], texts[a:b])
                if out is not None and out.num_rows:
                    yield out
    return run
