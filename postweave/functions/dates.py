"""Dates as Column expressions.  ``now`` is always an argument: a run has one clock."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .binding import let
from .labels import label

_MINUTE_MICROS = 60 * 1_000_000
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?\s*(Z|[+-]\d{2}(:?\d{2})?)?)?$"
NUMERIC = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})$"
# Free-text dates: what the text looks like and how to read it.  Week days are removed beforehand.
FREE_TEXT = [
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$", "d MMM yyyy HH:mm:ss Z", "datetime"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}$", "d MMM yyyy HH:mm:ss", "datetime"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}$", "d MMM yyyy HH:mm", "datetime"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy", "date"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy", "date"),
]


# Month names of written-out dates ("3 mars 2026", "24 de julio de 2026", "5. Oktober 2026"), by language.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
}
WRITTEN = r"(?iu)^(\d{1,2})(?:\.|er|st|nd|rd|th)?\s+(?:de\s+)?(\p{L}{3,})\.?,?\s+(?:de\s+|del\s+)?(\d{4})$"


def _written(t: Column) -> Column:
    """A date with a month name of any of the languages (or its first letters, three at least, if they fit one month only)."""
    names = {name: i + 1 for months in MONTHS.values() for i, name in enumerate(months.split())}
    short: dict[str, set[int]] = {}
    for name, number in names.items():
        for n in range(3, len(name)):
            short.setdefault(name[:n], set()).add(number)
    known = {k: min(v) for k, v in short.items() if len(v) == 1} | names
    month = F.try_element_at(F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair]), F.lower(F.regexp_extract(t, WRITTEN, 2)))
    return F.format_string("%04d-%02d-%02d", F.regexp_extract(t, WRITTEN, 3).try_cast("int"), month, F.regexp_extract(t, WRITTEN, 1).try_cast("int")).try_cast("date").cast("timestamp")


def at(now: datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def minus_minutes(ts: Column, minutes: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) - minutes.cast("bigint") * F.lit(_MINUTE_MICROS))


def parse_relative(text: Column, now: datetime | Column) -> Column:
    """'Posted 3 Days Ago', 'hace 2 días', 'il y a 5 jours', 'heute' to a timestamp; null if nothing relative."""
    now = at(now)
    flag = "(?iuU)"
    # Minutes back: one value to compute, one subtraction at the end.
    back = F.when(text.rlike(flag + V.RELATIVE_TODAY), F.lit(0).cast("bigint"))
    back = back.when(text.rlike(flag + V.RELATIVE_YESTERDAY), F.lit(1440).cast("bigint"))
    units = F.create_map(*[F.lit(x) for unit, hours in V.UNIT_HOURS.items() for x in (unit, round(60 * hours))])
    for pattern in V.RELATIVE_AGO:
        amount = F.regexp_extract(text, "(?iu)" + pattern, 1).try_cast("bigint")
        unit = F.lower(F.regexp_extract(text, "(?iu)" + pattern, 2))
        back = back.when(text.rlike("(?iu)" + pattern), amount * F.try_element_at(units, unit))
    return minus_minutes(now, back)


def _pair(ts: Column, precision: Column | str) -> Column:
    precision = F.lit(precision) if isinstance(precision, str) else precision
    return F.struct(ts.cast("timestamp").alias("ts"), precision.alias("precision"))


def from_epoch(number: Column) -> Column:
    """Seconds, or milliseconds above 1e12; zero and negative numbers are unknown."""
    n = number.cast("double")
    seconds = F.when(n > F.lit(1e12), n / 1000).otherwise(n)
    return F.when(seconds > 0, F.timestamp_micros(F.floor(seconds * 1_000_000).cast("bigint")))


def _iso(t: Column) -> Column:
    offset = F.regexp_replace(F.regexp_replace(t, r"([+-]\d{2}):?(\d{2})$", "$1:$2"), r"(T|\d) (?=[+-])", "$1")
    iso_ts = F.when(F.length(t) <= 10, t.try_cast("timestamp")).otherwise(
        F.replace(offset, F.lit(","), F.lit(".")).try_cast("timestamp"))
    return _pair(iso_ts, F.when(F.length(t) <= 10, F.lit("date")).otherwise(F.lit("datetime")))


def _calendar(t: Column) -> Column:
    """Dates that are not relative, as (ts, precision); the shape of the text picks the one parser to run."""
    a, b, y = (F.regexp_extract(t, NUMERIC, i).try_cast("int") for i in (1, 2, 3))
    year = F.when(y < 100, y + 2000).otherwise(y)
    month_first = (a <= 12) & (b > 12)
    day, month = F.when(month_first, b).otherwise(a), F.when(month_first, a).otherwise(b)
    numeric = F.format_string("%04d-%02d-%02d", year, month, day).try_cast("date").cast("timestamp")
    bare = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3,9}, (?=\d)", ""), r" (GMT|UTC|Z)$", " +0000")
    out = (F.when(t.rlike(NUMERIC), _pair(numeric, "date"))
           .when(t.rlike(r"^\d{8}$"), _pair(F.try_to_timestamp(t, F.lit("yyyyMMdd")), "date"))
           .when(t.rlike(ISO), _iso(t)))
    out = out.when(bare.rlike(WRITTEN), _pair(_written(bare), "date"))
    for shape, pattern, precision in FREE_TEXT:
        # The shape guards the parser: it never sees a text it would have to reject.
        guarded = F.when(bare.rlike(shape), bare)
        out = out.when(bare.rlike(shape), _pair(F.try_to_timestamp(guarded, F.lit(pattern)), precision))
    return out.otherwise(_pair(F.lit(None).cast("timestamp"), "unknown"))


def parse_date(text: Column, now: datetime | Column) -> Column:
    """Struct (ts, precision) of a date written in any of the supported ways.

    The text and the relative reading are bound once: a Column used many times is evaluated many times.
    """
    def read(t: Column) -> Column:
        return (F.when(t == "", _pair(F.lit(None).cast("timestamp"), "unknown"))
                .when(t.rlike(ISO), _iso(t))  # the usual shape; nothing relative looks like it
                .when(t.rlike(r"^\d{9,18}$"), _pair(from_epoch(t.try_cast("bigint")), "datetime"))
                .otherwise(let(parse_relative(t, now), lambda rel: F.when(rel.isNotNull(), _pair(rel, "relative"))
                               .otherwise(_calendar(t)))))

    read_once = let(F.trim(F.coalesce(text, F.lit(""))), read)
    return let(read_once, lambda p: F.struct(p["ts"].alias("ts"), F.when(p["ts"].isNull(), F.lit("unknown"))
                                             .otherwise(p["precision"]).alias("precision")))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def parse_iso(text: Column) -> Column:
    return text.try_cast("timestamp")


def rfc822(ts: Column) -> Column:
    """'Fri, 25 Sep 2026 08:00:00 +0000'."""
    return F.concat(F.date_format(ts, "E, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def iso_week(ts: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def age_bucket(days: Column) -> Column:
    return F.when(days <= 1, F.lit("_24_HOURS")).when(days <= 7, F.lit("_7_DAYS")).otherwise(F.lit("_15_DAYS"))


def local(ts: Column, tz: str) -> Column:
    return F.from_utc_timestamp(ts, tz)


def display_when(posted_at: Column, precision: Column, first_seen: Column, now: datetime | Column, tz: str,
                 lang: str = "en") -> Column:
    """'Posted 27/09 08:15', 'Posted ~25/09', 'Detected 27/09 09:03'."""
    now = at(now)
    posted, seen = local(posted_at, tz), local(F.coalesce(first_seen, now), tz)

    def text(name: str) -> Column:
        return F.lit(label(name, lang))

    day = F.date_format(posted, "dd/MM")
    today = F.to_date(posted) == F.to_date(local(now, tz))
    return (
        F.when(posted_at.isNull(), F.concat_ws(" ", text("detected"), F.date_format(seen, "dd/MM HH:mm")))
        .when(precision == "datetime", F.concat_ws(" ", text("posted"), F.date_format(posted, "dd/MM HH:mm")))
        .when((precision == "relative") & today,
              F.concat(text("posted"), F.lit(" "), text("today"), F.lit(" ("), text("approx"), F.lit(")")))
        .when(precision == "relative", F.concat(text("posted"), F.lit(" ~"), day))
        .otherwise(F.concat_ws(" ", text("posted"), day)))
