"""Filters that name their reason.  A row is never dropped: it carries its decision."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.dates import at
from ..functions.text import extract_experience


def is_fresh(posted_at: Column, first_seen: Column, now: datetime, max_age_days: float | Column) -> Column:
    """Age of the posting date, else of the first sight, within the window (inclusive; future dates pass).

    Plain comparisons with one limit, so with a literal age the test on ``posted_at`` reaches the Parquet scan.
    """
    if isinstance(max_age_days, Column):
        limit = F.timestamp_micros((F.unix_micros(at(now)) - max_age_days * 86_400_000_000).cast("bigint"))
    else:
        limit = at(now - timedelta(days=max_age_days))
    unseen = first_seen.isNull()
    return ((posted_at.isNotNull() & (posted_at >= limit))
            | (posted_at.isNull() & (unseen | (first_seen.isNotNull() & (first_seen >= limit)))))


def experience_out_of_range(description: Column, min_years: int | None, max_years: int | None) -> Column:
    """Asks for more than max + 1 years, or at most for less than min - 1.  Nothing stated: in range."""
    exp = extract_experience(description)
    out = F.lit(False)
    if max_years is not None:
        out = out | F.coalesce(exp["lo"] > max_years + 1, F.lit(False))
    if min_years is not None:
        out = out | F.coalesce(exp["hi"] < min_years - 1, F.lit(False))
    return out


def in_quiet_hours(local_ts: Column, window: str) -> Column:
    """Half-open window 'HH:MM-HH:MM' of local time; it may cross midnight."""
    start, end = (p.strip() for p in window.split("-"))
    t = F.date_format(local_ts, "HH:mm")
    return ((t >= start) & (t < end)) if start <= end else ((t >= start) | (t < end))


def location_ok(locations: Column, target: Column, coverage: Column, kind: Column, skip: Column) -> Column:
    """Source flag, a page change and a posting without any location pass; else a place or a coverage match."""
    return skip | (kind == "page_change") | (F.size(locations) == 0) | target.isNotNull() | coverage


def accept_verdict(score: Column, family: Column, allowed: Column, min_score: int) -> Column:
    """Reason of a refusal after scoring, else null.  Null or empty ``allowed`` means no limit."""
    limited = F.coalesce(F.size(allowed) > 0, F.lit(False))
    return (F.when(F.coalesce(score, F.lit(0)) < min_score, F.lit("ai_score"))
            .when(limited & family.isNotNull() & ~F.array_contains(allowed, family), F.lit("source_family")))


def requires_keyword(source_flag: Column, global_flag: bool | None, scored: Column) -> Column:
    """The source's switch, else the global one, else only where no model scores."""
    default = ~scored if global_flag is None else F.lit(global_flag)
    return F.coalesce(source_flag, default)


def first_reason(*tests: tuple[str, Column]) -> Column:
    """Name of the first test that is true."""
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests])


def decide(df: DataFrame, now: datetime, max_age_days: float, min_score: int) -> DataFrame:
    """The waterfall up to the duplicate test, as one ``decision`` column (null: still in).

    Expects kind, posted_at, first_seen, notified, baseline, location_ok, excluded, out_of_range, kw_family,
    need_keyword, scored (a model is used), verdict_score, verdict_family, allowed_families.  Adds family and score:
    the verdict's where there is one.
    """
    job = F.col("kind") == "job"
    has_verdict = F.col("scored") & F.col("verdict_score").isNotNull()
    family = F.when(has_verdict, F.coalesce("verdict_family", "kw_family")).otherwise(F.col("kw_family"))
    refusal = accept_verdict(F.col("verdict_score"), family, F.col("allowed_families"), min_score)
    decision = first_reason(
        ("already_notified", F.col("notified")),
        ("baseline", job & F.col("posted_at").isNull() & F.col("baseline")),
        ("too_old", ~is_fresh(F.col("posted_at"), F.col("first_seen"), now, max_age_days)),
        ("location", ~F.col("location_ok")),
        ("excluded", job & F.col("excluded").isNotNull()),
        ("experience", job & F.col("out_of_range")),
        ("no_keyword", job & F.col("need_keyword") & F.col("kw_family").isNull()),
        ("ai_score", job & has_verdict & (refusal == "ai_score")),
        ("source_family", job & has_verdict & (refusal == "source_family")),
        ("ai_unavailable", job & F.col("scored") & F.col("verdict_score").isNull() & F.col("kw_family").isNull()),
    )
    return (df.withColumn("decision", decision).withColumn("family", F.when(job, family))
            .withColumn("score", F.when(job & has_verdict, F.col("verdict_score"))))


def blocked_sample(df: DataFrame, n: int = V.BLOCKED_SAMPLE) -> DataFrame:
    """First well-scored postings refused by a source's family list; a top-n, never a full sort."""
    return df.filter(F.col("decision") == "source_family").orderBy(F.desc("score"), "key").limit(n)
