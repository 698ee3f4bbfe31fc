"""Captured JSON to postings: a declarative mapping compiled to Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.dates import parse_date
from ..functions.jsons import PLACEHOLDER, as_list, dig
from ..functions.text import html_to_text
from ..operators.dedupe import distinct_first_wins

Field = str | Callable[[Column], Column] | None


@dataclass(frozen=True)
class Mapping:
    """Where the fields of a posting are: a path into the item, or a function of the item (a VARIANT)."""

    items: str
    title: Field
    id: Field = None
    url: Field = None
    url_template: str | None = None
    locations: Field = None  # a path (scalar or list), or a function that gives an array of texts
    posted_at: Field = None
    posted_at_format: str | None = None
    precision: Callable[[Column, Column], Column] | None = None
    description: Field = None
    company: Field = None
    keep: Callable[[Column], Column] | None = None
    prepare: Callable[[Column], Column] | None = None  # what all fields read instead of the item, made once per item; then all of them are functions


def each(value: Column, path: str, inner: str) -> Column:
    """``inner`` of every element of the list at ``path``."""
    return F.transform(as_list(dig(value, path, "variant")), lambda o: dig(o, inner))


def join_parts(value: Column, *paths: str) -> Column:
    return F.concat_ws(", ", *[F.when(dig(value, p) != "", dig(value, p)) for p in paths])


def first_of(value: Column, *paths: str) -> Column:
    return F.coalesce(*[F.when(dig(value, p) != "", dig(value, p)) for p in paths])


def _field(item: Column, field: Field) -> Column:
    if field is None:
        return F.lit(None).cast("string")
    return field(item) if callable(field) else dig(item, field)


def clean_locations(locations: Column) -> Column:
    stripped = F.transform(locations, lambda x: F.trim(x, F.lit(" ,")))
    return F.filter(stripped, lambda x: x.isNotNull() & (x != ""))


def _fill(template: str, item: Column, known: dict[str, Column]) -> Column:
    parts, at = [], 0
    for m in PLACEHOLDER.finditer(template):
        value = known.get(m.group(1), dig(item, m.group(1)))
        parts += [F.lit(template[at:m.start()]), F.coalesce(value, F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def explode_items(captures: DataFrame, items: str, read: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per item, or what ``read`` makes of it; a body that is no JSON gives no row (see ``scan_errors``)."""
    body = F.try_parse_json("body")
    listed = as_list(dig(body, items, "variant") if items else body)
    parsed = captures.withColumn("_items", listed if read is None else F.transform(listed, lambda v: read(v)))
    # An inner explode would first filter by the size of the list, and so parse the body and read the items more than once.
    return parsed.select(*[c for c in captures.columns if c != "body"], F.posexplode_outer("_items").alias("pos", "item")).filter("pos IS NOT NULL")


def normalize_json(captures: DataFrame, mapping: Mapping, now: datetime, source_type: str = "json_api",
                   dedupe: bool = True) -> DataFrame:
    """Postings of captured pages (source_key, page_no, body).

    Items without title are dropped, the id falls back to the URL, and the first row of a key wins over the pages.
    """
    def read(v: Column) -> Column:
        return let(v if mapping.prepare is None else mapping.prepare(v), lambda p: F.struct(p.alias("item"), _field(p, mapping.title).alias("title")))

    # The title is read inside the generator: a filter on it would otherwise repeat what makes it.
    rows = explode_items(captures, mapping.items, read).select("source_key", "page_no", "pos", "item.item", "item.title")
    item = F.col("item")
    if mapping.keep is not None:
        rows = rows.filter(mapping.keep(item))
    rows = rows.filter(F.coalesce("title", F.lit("")) != "")
    url = _field(item, mapping.url)
    if mapping.url_template:
        known = {name: _field(item, f) for name, f in (("id", mapping.id), ("title", mapping.title)) if f is not None}
        url = F.coalesce(F.when(url != "", url), _fill(mapping.url_template, item, known))
    locations = mapping.locations(item) if callable(mapping.locations) else (
        as_list(dig(item, mapping.locations, "variant"), "string") if mapping.locations else F.array().cast("array<string>"))
    raw_date = _field(item, mapping.posted_at)
    rows = rows.select("source_key", "page_no", "pos", "item", "title", url.alias("url"), clean_locations(locations).alias("locations"),
                       raw_date.alias("_raw"), parse_date(raw_date, now).alias("_date"), _field(item, mapping.description).alias("_desc"),
                       _field(item, mapping.company).alias("company"), _field(item, mapping.id).alias("_id"))
    precision = F.col("_date.precision")
    posted = F.col("_date.ts")
    if mapping.posted_at_format:
        exact = F.try_to_timestamp("_raw", F.lit(mapping.posted_at_format))
        posted = F.coalesce(exact, posted)
        precision = F.when(exact.isNotNull(), F.lit("datetime" if "HH" in mapping.posted_at_format else "date")).otherwise(precision)
    if mapping.precision is not None:
        precision = mapping.precision(F.col("_raw"), precision)
    out = rows.select("source_key", F.coalesce("_id", "url").alias("native_id"), "page_no", "pos", "title", "url", "company", "locations",
                      posted.alias("posted_at"), precision.alias("posted_precision"), html_to_text(F.col("_desc")).alias("description"),
                      F.lit(source_type).alias("source_type"), F.lit("job").alias("kind"))
    return distinct_first_wins(out, ["source_key", "native_id"], "page_no", "pos") if dedupe else out


def scan_errors(captures: DataFrame) -> DataFrame:
    """Fetch-log rows of captures: a body that cannot be read is an error row, never an exception."""
    bad = F.try_parse_json("body").isNull()
    return captures.select("source_key", "page_no", (~bad).alias("ok"), F.when(bad, F.lit("body is not JSON")).alias("error"))
