"""Tracker words: statuses and the history text of a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .text import normalize_text


def parse_status(text: Column) -> Column:
    """Canonical status of a word in any language; null when unknown."""
    aliases = F.create_map(*[F.lit(x) for status, words in V.STATUS_ALIASES.items() for w in words for x in (w, status)])
    return F.try_element_at(aliases, normalize_text(text))


def same_status(a: Column, b: Column) -> Column:
    """Both known: equal statuses.  Both unknown: equal after normalising."""
    ca, cb = parse_status(a), parse_status(b)
    return F.when(ca.isNotNull() | cb.isNotNull(), F.coalesce(ca == cb, F.lit(False))).otherwise(
        normalize_text(a) == normalize_text(b))


def valid_day(text: Column) -> Column:
    """The date of a 'YYYY-MM-DD' text; null for anything else, 2026-09-31 included."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def split_history(history: Column) -> Column:
    """'2026-09-28 applied; 2026-10-02 offer (manual)' to an ordered array of (day, status)."""
    entries = F.filter(F.transform(F.split(F.coalesce(history, F.lit("")), ";"), lambda e: F.trim(e)), lambda e: e != "")

    def entry(e: Column) -> Column:
        day = valid_day(F.substring_index(e, " ", 1))
        rest = F.when(day.isNotNull(), F.when(F.instr(e, " ") > 0, F.substring(e, F.instr(e, " ") + 1, F.length(e)))
                      .otherwise(F.lit(""))).otherwise(e)
        return F.struct(day.alias("day"), F.trim(F.regexp_replace(rest, r"\(manual\)$", "")).alias("status"))

    return F.transform(entries, entry)
