"""Ranked digests: order, cut, sections, numbers, lines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import at, display_when, local
from ..functions.labels import label
from ..functions.text import location_text
from ..session import cut_lineage


def newest(now: datetime) -> Column:
    return F.coalesce("posted_at", "first_seen", at(now))


def rank_results(df: DataFrame, now: datetime, *ties: str) -> DataFrame:
    """Score descending (null as 0), then newest, then the ties.  A range-partitioned sort."""
    return df.orderBy(F.desc(F.coalesce("score", F.lit(0))), newest(now).desc(), *ties)


def number_all(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 over the whole order, without a window over all of them: a range-partitioned sort, row numbers inside the
    ranges, and the number of rows in the ranges before (one row per range).  Ties must be broken by ``order``."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ordered = cut_lineage(ordered).withColumn("_p", F.shiftright("_m", 33))
    ranges = ordered.groupBy("_p").agg(F.count("*").alias("_n"))  # a row per range
    before = ranges.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    inside = F.col("_m").bitwiseAND((1 << 33) - 1)
    return ordered.join(before, "_p").withColumn(name, F.col("_before") + inside + 1).drop("_p", "_m", "_before")


def top_k_with_hidden(df: DataFrame, groups: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per group with their position, and how many rows of the group are hidden.

    Spark limits every task to k rows per group before the shuffle; the totals are a separate combined count.
    """
    w = Window.partitionBy(*groups).orderBy(*order)
    shown = df.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
    totals = df.groupBy(*groups).agg(F.greatest(F.count("*") - k, F.lit(0)).alias("hidden"))
    return shown.join(totals, groups)


def _place_number(order: list[str], value: Column) -> Column:
    at_pos = F.array_position(F.array(*[F.lit(x) for x in order]), value) if order else F.lit(0)
    unknown = F.when(value == "", F.lit(len(order) + 2)).otherwise(F.lit(len(order) + 1))
    return F.when(at_pos > 0, at_pos).otherwise(unknown)


def digest_sections(shown: DataFrame, groups: list[str], families: dict[str, str], places: list[str],
                    lang: str = "en") -> DataFrame:
    """Sections by family and place in configuration order; unknown places after them, no place last.

    Works on the rows already cut to the size of a message, so the windows per group are small by construction.
    """
    fam = F.when(F.col("family").isin(list(families)), F.col("family")).otherwise(F.lit(""))
    place = F.coalesce(F.when(F.col("target") != "", F.col("target")),
                       F.when(F.col("coverage_match"), F.lit(label("coverage_place", lang))), F.lit(""))
    names = list(families)
    fam_at = F.array_position(F.array(*[F.lit(x) for x in names]), fam)
    fam_no = F.when(fam_at > 0, fam_at).otherwise(F.lit(len(names) + 1))
    labels = F.create_map(*[F.lit(x) for p in families.items() for x in p])
    out = shown.withColumn("_f", fam_no).withColumn("_p", _place_number(places, place)).withColumn("_place", place)
    section = Window.partitionBy(*groups, "_f", "_p", "_place")
    ordered = Window.partitionBy(*groups).orderBy("_f", "_p", "_place")
    heading = F.concat_ws(" · ", F.coalesce(F.try_element_at(labels, fam), F.lit(label("other", lang))),
                          F.when(F.col("_place") != "", F.col("_place")))
    out = out.withColumn("section_ord", F.dense_rank().over(ordered))
    out = out.withColumn("heading", F.concat(heading, F.lit(" ("), F.count("*").over(section).cast("string"), F.lit(")")))
    return out.drop("_f", "_p", "_place")


def number_rows(sections: DataFrame, groups: list[str]) -> DataFrame:
    """Running number of postings in digest order; page changes get none."""
    w = Window.partitionBy(*groups).orderBy("section_ord", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    job = F.col("kind") == "job"
    return sections.withColumn("number", F.when(job, F.sum(F.when(job, 1).otherwise(0)).over(w)))


def meta_lines(now: datetime, tz: str, lang: str = "en") -> Column:
    """Secondary lines of a posting as an array of texts."""
    def t(name: str) -> Column:
        return F.lit(label(name, lang))

    loc = location_text(F.col("locations"))
    place = F.when(F.col("coverage_match"), F.when(loc != "", F.concat(loc, F.lit(" ("), t("coverage"), F.lit(")")))
                   .otherwise(t("coverage"))).otherwise(loc)
    fit = F.when(F.col("score").isNotNull(), F.concat(F.lit("⭐ "), t("fit"), F.lit(" "), F.col("score").cast("string"), F.lit("/100")))
    exp = F.when(F.col("experience") != "", F.concat(F.lit("🎓 "), t("exp"), F.lit(" "), F.col("experience"), F.lit(" "), t("years")))
    extra = F.concat_ws(" · ", fit, exp)
    flags = F.concat_ws(" · ", F.when(F.col("already_alerted"), F.concat(F.lit("⚡ "), t("already"))),
                        F.when(F.size("also_on") > 0, F.concat(t("also_on"), F.lit(": "), F.array_join("also_on", ", "))))
    when = display_when(F.col("posted_at"), F.col("posted_precision"), F.col("first_seen"), now, tz, lang)
    return F.array_compact(F.array(
        F.when(place != "", F.concat(F.lit("📍 "), place)), F.concat(F.lit("🕒 "), when), F.when(extra != "", extra),
        F.when(F.col("reason") != "", F.concat(F.lit("💬 "), F.col("reason"))), F.when(flags != "", flags)))


def compact_meta(now: datetime, tz: str, lang: str = "en") -> Column:
    """One line: company, place, score, day, flags."""
    loc = location_text(F.col("locations"))
    day = F.date_format(local(newest(now), tz), "dd/MM")
    about = F.when(F.coalesce(F.col("posted_precision") == "relative", F.lit(False)), F.lit("~")).otherwise(F.lit(""))
    return F.concat_ws(
        " · ", F.when(F.col("company") != "", F.col("company")), F.when(loc != "", F.concat(F.lit("📍 "), F.substring(loc, 1, 60))),
        F.concat(F.lit("⭐ "), F.col("score").cast("string")), F.concat(F.lit("🕒 "), about, day),
        F.when(F.col("already_alerted"), F.lit("⚡ " + label("already", lang))),
        F.when(F.size("also_on") > 0, F.concat(F.lit(label("also_on", lang) + ": "), F.array_join("also_on", ", "))))


def heading(lang: str = "en") -> Column:
    return F.concat(F.col("company"), F.lit(" — "), F.when(F.col("kind") == "page_change", F.lit(label("page_changed", lang)))
                    .otherwise(F.col("title")))
