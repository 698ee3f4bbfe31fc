"""Captured HTML: lists, embedded JSON-LD, watched pages."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from ..functions.dates import parse_date
from ..functions.jsons import as_list, dig
from ..functions.text import collapse_spaces, html_to_text, text_part, unescape
from ..functions.urls import absolute_url
from ..operators.dedupe import distinct_first_wins, distinct_last_wins
from .batches import frames, map_rows
from .markup import Page, Selectors, selectors


@dataclass(frozen=True)
class ListMapping:
    """Selectors of one item and its parts."""

    item: str
    title: str | None = None
    link: str = "a"
    id_attr: str | None = None
    url_template: str | None = None
    company: str | None = None
    location: str | None = None
    location_regex: str | None = None
    date: str | None = None
    date_attr: str | None = None
    date_regex: str | None = None
    id_patterns: tuple[str, ...] = ()  # tried on the id attribute, then on the link

    def selectors(self) -> dict[str, str | None]:
        return {"item": self.item, "title": self.title, "link": None if self.link == "self" else self.link, "company": self.company,
                "location": self.location, "date": self.date}

    def __post_init__(self) -> None:
        Selectors(**self.selectors())  # an unsupported selector raises here, not in a task


_RAW = "source_key string, page_no int, page_url string, pos int, id string, title string, href string, company string, place string, day string"
_RAW_ARROW = pa.schema([(name, pa.int32() if name in ("page_no", "pos") else pa.string())
                        for name in ("source_key", "page_no", "page_url", "pos", "id", "title", "href", "company", "place", "day")])


def read_items(captures: DataFrame, m: ListMapping, title_chars: int | None = None) -> DataFrame:
    """Raw texts per item node; without a title selector the item's text is the title (``title_chars`` of it).  The tree is the only Python step; everything after it is Columns."""
    wanted = m.selectors()

    def items(body: str) -> Iterator[tuple]:
        page = Page(body, selectors(**wanted))

        def text(name: str, node: int) -> str:
            hit = page.first(name, node)
            return "" if hit is None else page.text(hit)
        for pos, node in enumerate(page.all("item")):
            link, day = node if m.link == "self" else page.first("link", node), page.first("date", node)
            yield (pos, (page.attrs[node].get(m.id_attr) or "").strip() if m.id_attr else "", text("title", node) or page.text(node)[:title_chars],
                   "" if link is None else page.attrs[link].get("href", ""), text("company", node), text("location", node),
                   "" if day is None else (page.attrs[day].get(m.date_attr) or "") if m.date_attr else page.text(day))

    def of_page(key: str, number: int, url: str, body: str | None) -> Iterator[tuple]:
        return ((key, number, url, *item) for item in items(body or ""))

    return map_rows(captures.select("source_key", "page_no", "url", "body"), of_page, _RAW, _RAW_ARROW)


def normalize_html_list(captures: DataFrame, m: ListMapping, now: datetime, last_wins: bool = False) -> DataFrame:
    raw = read_items(captures, m)
    native = F.col("id")
    for i, pattern in enumerate(m.id_patterns):
        found = F.regexp_extract("id" if i == 0 else "href", pattern, 1)
        native = found if i == 0 else F.when(native != "", native).otherwise(found)
    href = F.col("href")
    if m.url_template:
        href = F.when(native != "", F.replace(F.lit(m.url_template), F.lit("{id}"), native)).otherwise(href)
    place = text_part(F.col("place"), m.location_regex)
    day = parse_date(text_part(F.col("day"), m.date_regex), now)
    rows = raw.withColumn("_native", native).withColumn("_href", href).filter((F.col("title") != "") & (F.col("_href") != ""))
    if m.id_patterns:
        rows = rows.filter(F.col("_native") != "")
    url = absolute_url(F.col("page_url"), F.col("_href"))
    rows = rows.select("source_key", "page_no", "pos", "title", F.when(F.col("company") != "", F.col("company")).alias("company"), url.alias("url"),
                       F.when(F.col("_native") != "", F.col("_native")).otherwise(url).alias("native_id"),
                       F.when(place != "", place).otherwise(F.col("place")).alias("_place"), day.alias("_d"))
    rows = rows.select("source_key", "native_id", "page_no", "pos", "title", "company", "url", F.when(F.col("_place") != "", F.array("_place"))
                       .otherwise(F.array().cast("array<string>")).alias("locations"), F.col("_d.ts").alias("posted_at"), F.col("_d.precision").alias("posted_precision"))
    pick = distinct_last_wins if last_wins else distinct_first_wins
    return pick(rows, ["source_key", "native_id"], "page_no", "pos")


SEARCH_CARDS, TABLE_ROWS = ListMapping(**V.SEARCH_CARDS), ListMapping(**V.TABLE_ROWS)


def jsonld_objects(scripts: list[str], kind: str) -> Iterator[str]:
    """JSON texts of the objects of a type in all JSON-LD scripts of a page, wherever they are nested; a script nested too deeply is left out."""
    def walk(value):
        """All objects in order, without recursion."""
        stack = [value]
        while stack:
            value = stack.pop()
            if isinstance(value, dict):
                yield value
                stack.extend(reversed(value.values()))
            elif isinstance(value, list):
                stack.extend(reversed(value))

    for text in scripts:
        try:
            data = json.loads(text, strict=False)
        except (ValueError, RecursionError):  # no JSON, or nested deeper than any reader goes
            continue
        for obj in walk(data):
            types = obj.get("@type")
            if kind in (types if isinstance(types, list) else [types]):
                try:
                    yield json.dumps(obj, ensure_ascii=False)
                except RecursionError:
                    continue


_SCRIPT = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script\s*>"
_FOUND_ARROW = pa.schema([("row", pa.int64()), ("pos", pa.int32()), ("_json", pa.string())])


def extract_jsonld(captures: DataFrame, kind: str = "JobPosting") -> DataFrame:
    """(…, pos, item): one VARIANT per object.  Only the script bodies are read in Python, not the pages; the other columns go along in Arrow."""
    kept = [F.col(c) for c in captures.columns if c != "body"]
    scripts = captures.select(*kept, F.regexp_extract_all("body", F.lit(_SCRIPT), F.lit(1)).alias("_s")).filter(F.size("_s") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rest = batch.column("_s"), batch.select([c for c in batch.schema.names if c != "_s"])
            found = ((i, pos, text) for i in range(batch.num_rows) for pos, text in enumerate(jsonld_objects(texts[i].as_py(), kind)))
            for frame in frames(found, _FOUND_ARROW):
                own = rest.take(frame.column("row"))
                yield pa.RecordBatch.from_arrays([*own.columns, *frame.columns[1:]], names=[*own.schema.names, "pos", "_json"])

    schema = T.StructType([*captures.select(*kept).schema.fields, T.StructField("pos", T.IntegerType()), T.StructField("_json", T.StringType())])
    return scripts.mapInArrow(run, schema).withColumn("item", F.try_parse_json("_json")).drop("_json")


def posting_locations(item: Column) -> Column:
    """Locality, region and country of every place; an address may be text, a country an object; remote work adds one."""
    def one(loc: Column) -> Column:
        country = F.coalesce(dig(loc, "address.addressCountry.name"), F.when(
            ~F.coalesce(F.schema_of_variant(dig(loc, "address.addressCountry", "variant")), F.lit("")).startswith("OBJECT"), dig(loc, "address.addressCountry")))
        parts = [dig(loc, "address.addressLocality"), dig(loc, "address.addressRegion"), country]
        text = F.concat_ws(", ", *[F.when(p != "", p) for p in parts])
        is_text = F.coalesce(F.schema_of_variant(dig(loc, "address", "variant")), F.lit("")) == "STRING"
        return F.when(is_text, dig(loc, "address")).otherwise(text)

    listed = F.transform(as_list(dig(item, "jobLocation", "variant")), lambda v: one(v))
    names = F.transform(as_list(dig(item, "applicantLocationRequirements", "variant")), lambda v: F.coalesce(dig(v, "name"), dig(v, "")))
    remote = F.when(F.upper(dig(item, "jobLocationType")) == "TELECOMMUTE", F.concat(F.lit("Remote, "), F.array_join(F.filter(names, lambda x: x != ""), ", ")))
    return F.filter(F.concat(listed, F.array(remote)), lambda x: x.isNotNull() & (x != ""))


def jsonld_to_postings(objects: DataFrame, now: datetime) -> DataFrame:
    """Postings of JSON-LD objects: the identifier may be an object, the address of the page stands in for a URL."""
    i = F.col("item")
    ident = F.coalesce(dig(i, "identifier.value"), F.when(~F.schema_of_variant(dig(i, "identifier", "variant")).startswith("OBJECT"), dig(i, "identifier")))
    url = F.coalesce(dig(i, "url"), F.col("url"))
    d = parse_date(dig(i, "datePosted"), now)
    out = objects.select("source_key", "page_no", "pos", F.coalesce(F.when(ident != "", ident), url).alias("native_id"), html_to_text(dig(i, "title")).alias("title"), url.alias("url"),
                         dig(i, "hiringOrganization.name").alias("company"), posting_locations(i).alias("locations"), d.alias("_d"), html_to_text(dig(i, "description")).alias("description"))
    return out.withColumn("posted_at", F.col("_d.ts")).withColumn("posted_precision", F.col("_d.precision")).drop("_d")


def merge_jsonld_detail(postings: DataFrame, found: DataFrame) -> DataFrame:
    """Fill description, missing date and missing places from the posting's own page: the object with the same URL,
    else the first one.  ``found``: jsonld_to_postings with the page address in ``page_url``."""
    order = F.struct(F.when(F.col("url") == F.col("page_url"), 0).otherwise(1), "pos")
    best = found.groupBy("page_url").agg(F.min_by(F.struct("description", "posted_at", "posted_precision", "locations"), order).alias("_b"))
    j = postings.join(best, postings["url"] == best["page_url"], "left")
    return j.withColumns({
        "description": F.coalesce(F.when(F.col("_b.description") != "", F.col("_b.description")), "description"),
        "posted_precision": F.when(F.col("posted_at").isNull() & F.col("_b.posted_at").isNotNull(), F.col("_b.posted_precision")).otherwise(F.col("posted_precision")),
        "posted_at": F.coalesce("posted_at", "_b.posted_at"),
        "locations": F.when(F.size("locations") > 0, F.col("locations")).otherwise(F.coalesce("_b.locations", "locations")),
    }).drop("_b", "page_url")


_ANCHOR = r"(?is)<a\s[^>]*?href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>"


def page_links(captures: DataFrame, page: str = "source_key") -> DataFrame:
    """(page, pos, href, text) of every link; addresses are absolute."""
    tags = F.regexp_extract_all("body", F.lit(r"(?is)(<a\s[^>]*?href=[\"'][^\"']*[\"'][^>]*>.*?</a\s*>)"), F.lit(1))
    # Decoded inside the generator: a filter on the address repeats what makes the address absolute, but not the decoding.
    parts = F.transform(tags, lambda tag: F.struct(unescape(F.regexp_extract(tag, _ANCHOR, 1)).alias("href"), F.regexp_extract(tag, _ANCHOR, 2).alias("text")))
    rows = captures.select(page, "url", F.posexplode(parts).alias("pos", "_link"))
    return rows.select(page, "pos", absolute_url(F.col("url"), F.col("_link.href")).alias("href"),
                       collapse_spaces(unescape(F.regexp_replace("_link.text", "<[^>]*>", " "))).alias("text"))


def new_links(captures: DataFrame, known: DataFrame, observed: DataFrame, pattern: str, page: str = "source_key") -> DataFrame:
    """Links that match and were not remembered; the first text of a link wins; a page observed for the first time emits nothing.

    ``known``: (page, href), the links remembered.  ``observed``: the pages seen before, even if they had no matching link then.
    """
    links = page_links(captures, page).filter(F.col("href").rlike(pattern))
    links = links.withColumn("href", F.substring_index("href", "#", 1))
    first = links.groupBy(page, "href").agg(F.min_by("text", "pos").alias("text"))
    fresh = first.join(observed.select(page).distinct(), page, "left_semi").join(known.select(page, "href"), [page, "href"], "left_anti")
    return fresh.withColumn("title", F.when(F.col("text") != "", F.col("text")).otherwise(F.substring_index("href", "/", -1)))


def content_digest(body: Column) -> Column:
    hidden = F.regexp_replace(body, r"(?is)<(noscript|svg)\b[^>]*>.*?</\1\s*>", " ")
    return F.sha1(html_to_text(hidden))


def content_change(captures: DataFrame, monitors: DataFrame, page: str = "source_key") -> DataFrame:
    """One page_change row for a page whose visible text differs from the remembered one; the first sight is silent."""
    now = captures.select(page, "url", content_digest(F.col("body")).alias("hash"))
    return now.join(monitors.select(page, F.col("hash").alias("_before")), page).filter(F.col("hash") != F.col("_before")).select(
        page, "url", F.substring("hash", 1, 12).alias("native_id"), F.lit("page_change").alias("kind"))


def remembered_links(links: DataFrame, page: str = "source_key", most: int | None = None) -> DataFrame:
    """What a page monitor keeps: its distinct addresses (with ``most``, the first so many in order, limited per task before the
    shuffle; a page with more would report the same links as new on every run)."""
    from pyspark.sql import Window

    kept = links.select(page, "href").distinct()
    if most is None:
        return kept
    w = Window.partitionBy(page).orderBy("href")
    return kept.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= most).drop("_rn")
