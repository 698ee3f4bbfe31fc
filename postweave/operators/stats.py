"""Figures of runs: funnels, per-source figures, daily roll-up, counts by label.  All aggregates combine map-side."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.dates import at

# Reasons given before a posting becomes a candidate.
BEFORE_CANDIDATE = ["already_notified", "baseline", "too_old", "location", "excluded"]


def funnel(decided: DataFrame, *groups: str) -> DataFrame:
    """fetched, candidates, matches, ai_scored, also_elsewhere per group."""
    d = F.col("decision")
    return decided.groupBy(*groups).agg(
        F.count("*").alias("fetched"),
        F.count_if(d.isNull() | ~d.isin(BEFORE_CANDIDATE)).alias("candidates"),
        F.count_if(d.isNull()).alias("matches"),
        F.count_if(F.col("ai_scored")).alias("ai_scored"),
        F.count_if(F.coalesce(d == "duplicate_other_group", F.lit(False))).alias("also_elsewhere"))


def rejections(decided: DataFrame, *groups: str) -> DataFrame:
    return decided.filter(F.col("decision").isNotNull()).groupBy(*groups, F.col("decision").alias("reason")).agg(
        F.count("*").alias("n"))


def sources_checked(log: DataFrame, *groups: str) -> DataFrame:
    """ok and total sources; a skipped source counts in neither."""
    ran = log.filter(~F.col("skipped"))
    return ran.groupBy(*groups).agg(F.count_if(F.col("ok")).alias("sources_ok"), F.count("*").alias("sources_total"))


def source_stats(log: DataFrame, matches: DataFrame) -> DataFrame:
    """Per source: runs, ok, jobs, seconds, matches.  A source fetched for two groups counts once per run: the first
    row of a (run, source) is chosen by an explicit minimum."""
    once = log.groupBy("run_id", "source_key").agg(F.min_by(F.struct("ok", "jobs", "seconds"), "seq").alias("r"))
    ran = once.groupBy("source_key").agg(
        F.count("*").alias("runs"), F.count_if(F.col("r.ok")).alias("ok"),
        F.sum(F.when(F.col("r.ok"), F.col("r.jobs")).otherwise(0)).alias("jobs"),
        F.round(F.sum("r.seconds"), 2).alias("seconds"))
    found = matches.groupBy("source_key").agg(F.count("*").alias("matches"))
    return ran.join(found, "source_key", "full_outer").select(
        "source_key", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("runs", "ok", "jobs", "seconds", "matches")])


def daily_rollup(facts: DataFrame, today: date, keep_days: int = V.STATS_DAYS, digits: int = 2) -> DataFrame:
    """Additive facts (day, grp, metric, value): stored days and the figures of this run are one union, summed.

    Retention keeps ``day > today - keep_days``; the filter is on a grouping column, so Spark moves it to the scan.
    """
    kept = facts.filter(F.col("day") > F.lit(today - timedelta(days=keep_days)))
    return kept.groupBy("day", "grp", "metric").agg(F.round(F.sum("value"), digits).alias("value"))


def sum_days(facts: DataFrame, first: date, last: date, extra: DataFrame | None = None) -> DataFrame:
    """Totals of the days first..last (inclusive) plus the current run, and the number of days present."""
    inside = facts.filter(F.col("day").between(F.lit(first), F.lit(last)))
    if extra is not None:
        inside = inside.unionByName(extra.withColumn("day", F.lit(None).cast("date")))
    return inside.groupBy("grp", "metric").agg(F.sum("value").alias("value"), F.count_distinct("day").alias("days"))


def count_by_label(seen: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """New postings of the half-open window by group, company and family, as rows (dimension, label, n).

    A posting counts in each group it was published in, and once for company and family; folded duplicates never.
    """
    inside = F.map_filter("notified", lambda _, ts: (ts >= at(start)) & (ts < at(end)))
    fresh = seen.filter("dup_of IS NULL").withColumn("_in", inside).filter(F.size("_in") > 0)
    labels = F.concat(
        F.transform(F.map_keys("_in"), lambda g: F.struct(F.lit("group").alias("dimension"), g.alias("label"))),
        F.array(F.struct(F.lit("company").alias("dimension"), F.coalesce(F.when(F.col("company") != "", F.col("company")), F.lit("?")).alias("label")),
                F.struct(F.lit("family").alias("dimension"), F.coalesce("family", F.lit("other")).alias("label"))))
    return fresh.select(F.inline(labels)).groupBy("dimension", "label").agg(F.count("*").alias("n"))


def top_n_with_rest(counts: DataFrame, label: str, n: str, top: int, rest: str = "others") -> DataFrame:
    """The ``top`` labels and one row for all others.  A take-ordered, no global window; ties by name."""
    best = counts.orderBy(F.desc(n), label).limit(top).select(label, n)
    left = counts.agg(F.sum(n).alias(n)).unionByName(best.agg((-F.sum(n)).alias(n)))
    others = left.agg(F.sum(n).alias(n)).filter(F.col(n) > 0).select(F.lit(rest).alias(label), n)
    return best.unionByName(others)


def windowed_counts(items: DataFrame, ts: str, now: datetime, **days: float) -> DataFrame:
    """How many items are at most so many days old, one column per window, in one pass."""
    age = (F.unix_micros(at(now)) - F.unix_micros(F.col(ts))) / 86_400_000_000
    return items.agg(*[F.count_if(age <= d).alias(name) for name, d in days.items()])


def zero_filled(counts: DataFrame, label: str, order: list[str]) -> DataFrame:
    """Every label of a fixed list in its order, with 0 where nothing was counted."""
    from ..session import small_table

    dim = small_table(counts.sparkSession, f"ord int, {label} string", list(enumerate(order)))
    return dim.join(counts, label, "left").select("ord", label, F.coalesce("n", F.lit(0)).alias("n"))


def acceptance(marks: DataFrame, gate: Column, *by: Column, min_marks: int = V.MIN_MARKS) -> DataFrame:
    """wanted and discarded per name of each dimension in ``by`` (source, family), in one pass over the marks.

    One gate for all: at least ``min_marks`` marks must have a name in the dimension ``gate`` (the sources), else nothing is shown.
    """
    named = marks.select("status", F.explode(F.array_compact(F.array(*by))).alias("name"))
    liked = F.col("status").isin(V.POSITIVE_STATUSES)
    per = named.groupBy("name").agg(F.count_if(liked).alias("wanted"), F.count_if(~liked).alias("discarded"))
    total = marks.agg(F.count(gate)).scalar()  # a scalar subquery: one small job, no join
    return per.filter(total >= min_marks)
