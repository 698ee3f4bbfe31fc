"""Health of sources from their fetch log: rows (source_key, seq, ts, ok, jobs, error)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from .segments import with_latest, with_previous, with_total_before


def fail_streak(log: DataFrame, order: list[str]) -> DataFrame:
    """(source_key, streak, last_error): failures since the last success.

    Two map-side combined aggregates and a join with one row per source; no window over a source's whole log.
    """
    last_ok = log.filter("ok").groupBy("source_key").agg(F.max(F.struct(*order)).alias("_ok"))
    since = log.filter("NOT ok").join(last_ok, "source_key", "left").filter(
        F.col("_ok").isNull() | (F.struct(*order) > F.col("_ok")))
    failing = since.groupBy("source_key").agg(F.count("*").alias("streak"), F.max_by("error", F.struct(*order)).alias("last_error"))
    return log.select("source_key").distinct().join(failing, "source_key", "left").withColumn("streak", F.coalesce("streak", F.lit(0)))


def health_changes(log: DataFrame, order: list[str], segment: Column, most: int = V.PERSISTED_STREAK) -> DataFrame:
    """(source_key, order, change, streak): the rows of a fetch log that are worth storing.

    A success after failures ('recovered'), and of a run of failures the first ``most`` ('failing'); from then on a broken source changes
    nothing stored.  The batch form of ``streaming.ordered.health_stream``; windows run per source and segment.
    """
    failed = (~F.col("ok")).cast("bigint")
    out = with_previous(log, ["source_key"], order, F.col("ok"), segment, "_ok_before")
    out = with_total_before(out, ["source_key"], order, failed, segment, "_failures")
    out = with_latest(out, ["source_key"], order, F.when(F.col("ok"), F.col("_failures")), segment, "_at_ok")
    before = F.col("_failures") - F.coalesce("_at_ok", F.lit(0))
    change = F.when(F.col("ok") & ~F.col("_ok_before"), F.lit("recovered")).when(~F.col("ok") & (before < most), F.lit("failing"))
    streak = F.when(F.col("ok"), F.lit(0)).otherwise(before + 1)
    return out.select("source_key", *order, change.alias("change"), streak.cast("bigint").alias("streak")).filter("change IS NOT NULL")


def last_n_counts(log: DataFrame, order: list[str], n: int = V.KEPT_COUNTS) -> DataFrame:
    """(source_key, counts): results of the last ``n`` successful runs, oldest first.

    ``row_number <= n`` lets Spark limit each source before the shuffle, so a group is never larger than n per task.
    """
    newest = Window.partitionBy("source_key").orderBy(*[F.desc(c) for c in order])
    last = log.filter("ok").withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("_rn")).alias("o"), "jobs")))
    return last.groupBy("source_key").agg(F.transform(ordered, lambda x: x["jobs"]).alias("counts"))


def median_of(values: Column) -> Column:
    s = F.array_sort(values)
    half = F.floor(F.size(s) / 2).cast("int")
    even = (F.get(s, half - 1) + F.get(s, half)) / 2
    return F.when(F.size(s) % 2 == 1, F.get(s, half).cast("double")).otherwise(even)


def source_health(log: DataFrame, order: list[str], fail_threshold: int = 3, error_chars: int | None = None) -> DataFrame:
    """(source_key, streak, counts, problem): a failing streak, else 'zero' for a source that suddenly finds nothing."""
    both = fail_streak(log, order).join(last_n_counts(log, order), "source_key", "left")
    counts = F.coalesce("counts", F.array().cast("array<bigint>"))
    n = F.size(counts)
    earlier = F.slice(counts, 1, F.greatest(n - 2, F.lit(0)))
    silent = ((n >= 4) & (F.get(counts, n - 1) == 0) & (F.get(counts, n - 2) == 0) & (median_of(earlier) > 0))
    error = F.coalesce("last_error", F.lit(""))
    failing = F.concat(F.lit("fail x"), F.col("streak").cast("string"), F.lit(": "), error if error_chars is None else F.substring(error, 1, error_chars))
    return both.select("source_key", "streak", counts.alias("counts"), F.when(F.col("streak") >= fail_threshold, failing)
                       .when(silent, F.lit("zero")).alias("problem"))


def health_summary(sources: DataFrame, health: DataFrame) -> DataFrame:
    """One row: total, checked, ok, failing and the number of sources with a problem."""
    j = sources.select("source_key").join(health, "source_key", "left")
    checked = F.col("streak").isNotNull()
    return j.agg(F.count("*").alias("total"), F.count_if(checked).alias("checked"),
                 F.count_if(checked & (F.col("streak") == 0)).alias("ok"),
                 F.count_if(checked & (F.col("streak") > 0)).alias("failing"),
                 F.count_if(F.col("problem").isNotNull()).alias("problems"))


def source_performance(stats: DataFrame, health: DataFrame) -> DataFrame:
    """runs, ok, jobs per run, matches, seconds per run, health; most matches first, then by name."""
    j = stats.join(health.select("source_key", "problem"), "source_key", "left")
    ran = F.col("runs") > 0
    return j.select("source_key", "runs", "ok",
                    F.when(ran, F.round(F.col("jobs") / F.col("runs"), 1)).otherwise(F.lit(0.0)).alias("avg_jobs"), "matches",
                    F.when(ran, F.round(F.col("seconds") / F.col("runs"), 1)).otherwise(F.lit(0.0)).alias("avg_seconds"),
                    F.coalesce("problem", F.lit("OK")).alias("health")).orderBy(F.desc("matches"), F.lower("source_key"))
