"""Landed payload files: batch scan, incremental scan with a quarantine, resuming by stream identity.

A capture folder holds one sub-folder per source (``source_key=...``) with files of one payload a line.  A payload or a file that can't be read becomes an
error row; the other ones go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _with_source(rows: DataFrame) -> DataFrame:
    """Adds the file, its source and the payload as text; a payload that is no UTF-8 stays null."""
    file = F.col("_metadata.file_path")
    source = F.regexp_extract(file, r"source_key=([^/]+)/", 1)
    for _ in range(2):  # the address of the file is escaped, and in it the name of the folder
        source = F.url_decode(F.replace(source, F.lit("+"), F.lit("%2B")))
    text = F.expr("CASE WHEN is_valid_utf8(CAST(value AS STRING)) THEN CAST(value AS STRING) END")
    return rows.select(F.when(source != "", source).alias("source_key"), file.alias("file"), text.alias("body"))


def _judged(rows: DataFrame) -> DataFrame:
    ok = F.try_parse_json("body").isNotNull()
    return rows.withColumn("ok", ok).withColumn("error", F.when(F.col("body").isNull(), F.lit("body is not UTF-8")).when(~F.col("ok"), F.lit("body is not JSON")))


def scan_captures(spark: SparkSession, path: str) -> DataFrame:
    """All payloads below ``path``: (source_key, file, body, ok, error)."""
    reader = spark.read.option("recursiveFileLookup", True)
    return _judged(_with_source(reader.text(path).select(F.col("value").cast("binary").alias("value"), "_metadata")))


def capture_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The same rows as a stream: a file is read once, a restarted query goes on with the files it has not seen."""
    reader = spark.readStream.option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _judged(_with_source(reader.text(path).select(F.col("value").cast("binary").alias("value"), "_metadata")))


def drain(stream: DataFrame, table: str, quarantine: str, checkpoint: str) -> int:
    """Read what is new, payloads to ``table``, error rows to ``quarantine``; returns how many batches there were.

    Each micro-batch writes one folder of its own and overwrites it if it is repeated, so a lost job leaves nothing twice.
    """
    batches = []

    def write(rows: DataFrame, n: int) -> None:
        rows.persist()
        rows.filter("ok").select("source_key", "file", "body").write.mode("overwrite").parquet(f"{table}/batch={n}")
        rows.filter("NOT ok").select("source_key", "file", "body", "error").write.mode("overwrite").parquet(f"{quarantine}/batch={n}")
        rows.unpersist()
        batches.append(n)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(batches)


def resume(rows: DataFrame, offsets: DataFrame, stream: str, identity: str, number: Column | str) -> DataFrame:
    """Rows after the last processed number of their stream; a stream that is unknown, or whose identity changed, starts again.

    ``offsets``: (stream, identity, done), one row per stream."""
    number = F.col(number) if isinstance(number, str) else number
    known = offsets.select(stream, F.col(identity).alias("_identity"), F.col("done").alias("_done"))
    same = F.coalesce(F.col(identity) == F.col("_identity"), F.lit(False))
    return rows.join(known, stream, "left").filter(~same | F.col("_done").isNull() | (number > F.col("_done"))).drop("_identity", "_done")


def offsets_after(rows: DataFrame, stream: str, identity: str, number: Column | str, before: DataFrame | None = None) -> DataFrame:
    """(stream, identity, done) after ``rows`` were processed; streams without new rows keep what they had."""
    number = F.col(number) if isinstance(number, str) else number
    last = rows.groupBy(stream).agg(F.max_by(identity, number).alias(identity), F.max(number).alias("done"))
    return last if before is None else last.unionByName(before.join(last, stream, "left_anti").select(last.columns))
