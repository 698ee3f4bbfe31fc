"""XML feeds and site maps, read with ``from_xml``."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.dates import at, parse_date
from ..functions.text import html_to_text

_ITEM = "struct<title:string,link:string,guid:string,description:string,pubDate:string,place:array<string>,location:{location}>"
RSS = "channel struct<item:array<" + _ITEM.format(location="array<struct<city:string,country:string>>") + ">>"
ATOM = ("entry array<struct<id:string,title:string,link:array<struct<_href:string,_rel:string>>,updated:string,published:string,"
        "summary:string,content:string>>")
PERSONIO = ("position array<struct<id:string,name:string,createdAt:string,office:string,additionalOffices:struct<office:array<string>>,"
            "jobDescriptions:struct<jobDescription:array<struct<name:string,value:string>>>>>")
SUCCESSFACTORS = ("Job array<struct<JobTitle:string,ReqId:string,`Job-Description`:string,`Posted-Date`:string,"
                  + ",".join(f"filter{i}:struct<label:string,value:string>" for i in range(1, 10)) + ">>")
SITEMAP = "url array<struct<loc:string,lastmod:string>>"
NO_TEXTS = "array<string>"


def _clean(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _rows(captures: DataFrame, schema: str, tag: str, items: str, namespaces: bool = False) -> DataFrame:
    body = F.regexp_replace("body", r"<(/?)\w+:", "<$1") if namespaces else F.col("body")
    parsed = captures.withColumn("_x", F.from_xml(body, schema, {"rowTag": tag, "mode": "PERMISSIVE"}))
    return parsed.select("source_key", "page_no", F.posexplode(f"_x.{items}").alias("pos", "item"))


def _posting(df: DataFrame, native: Column, title: Column, url: Column, locations: Column, date_text: Column, description: Column,
             now: datetime, source_type: str) -> DataFrame:
    out = df.select("source_key", "page_no", "pos", native.alias("native_id"), title.alias("title"), url.alias("url"), locations.alias("locations"),
                    parse_date(date_text, now).alias("_d"), description.alias("description"), F.lit(source_type).alias("source_type"), F.lit("job").alias("kind"))
    return out.withColumn("posted_at", F.col("_d.ts")).withColumn("posted_precision", F.col("_d.precision")).drop("_d")


def normalize_rss(captures: DataFrame, now: datetime, location_regex: str | None = None, location_tag: bool = False) -> DataFrame:
    """RSS 2.0: title and link required, the guid falls back to the link; an optional pattern finds a place in the raw
    description, then the clean one, then the title; an optional tag adds more."""
    item = _rows(captures, RSS, "rss", "channel.item")
    link, title, raw = _clean(F.col("item.link")), html_to_text(F.col("item.title")), F.coalesce("item.description", F.lit(""))
    desc = html_to_text(raw)
    found = F.lit("")
    if location_regex:
        hits = [F.regexp_extract(x, location_regex, 1) for x in (raw, desc, title)]
        found = F.trim(F.coalesce(*[F.when(h != "", h) for h in hits], F.lit("")))
    tags = F.transform(F.coalesce("item.place", F.array().cast(NO_TEXTS)), lambda p: F.trim(p)) if location_tag else F.array().cast(NO_TEXTS)
    places = F.concat(F.when(found != "", F.array(found)).otherwise(F.array().cast(NO_TEXTS)), tags)
    link = F.when(link != "", link).otherwise(_clean(F.col("item.guid")))
    native = F.when(_clean(F.col("item.guid")) != "", _clean(F.col("item.guid"))).otherwise(link)
    out = _posting(item, native, title, link, places, F.col("item.pubDate"), desc, now, "rss")
    return out.filter((F.col("title") != "") & (F.col("url") != ""))


def normalize_atom(captures: DataFrame, now: datetime) -> DataFrame:
    """Atom: the alternate link first, else the first one with an address; the id falls back to it."""
    item = _rows(captures, ATOM, "feed", "entry")
    links = F.filter(F.coalesce(F.col("item.link"), F.array().cast("array<struct<_href:string,_rel:string>>")), lambda x: _clean(x["_href"]) != "")
    best = F.coalesce(F.get(F.filter(links, lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate")), F.lit(0)), F.get(links, F.lit(0)))
    link = F.coalesce(F.trim(best["_href"]), _clean(F.col("item.id")))
    text = F.coalesce(F.when(F.col("item.summary") != "", F.col("item.summary")), F.col("item.content"))
    native = F.when(_clean(F.col("item.id")) != "", _clean(F.col("item.id"))).otherwise(link)
    dated = F.coalesce(F.when(F.col("item.published") != "", F.col("item.published")), F.col("item.updated"))
    out = _posting(item, native, html_to_text(F.col("item.title")), link, F.array().cast(NO_TEXTS), dated, html_to_text(text), now, "rss")
    return out.filter((F.col("title") != "") & (F.col("url") != ""))


def normalize_teamtailor(captures: DataFrame, now: datetime) -> DataFrame:
    """RSS with namespaced city/country lists."""
    item = _rows(captures, RSS, "rss", "channel.item", namespaces=True)
    none = F.array().cast("array<struct<city:string,country:string>>")
    places = F.transform(F.coalesce("item.location", none), lambda p: F.concat_ws(", ", F.when(_clean(p["city"]) != "", F.trim(p["city"])),
                                                                                  F.when(_clean(p["country"]) != "", F.trim(p["country"]))))
    places = F.array_distinct(F.filter(places, lambda x: x != ""))
    link = _clean(F.col("item.link"))
    native = F.when(_clean(F.col("item.guid")) != "", _clean(F.col("item.guid"))).otherwise(link)
    out = _posting(item, native, _clean(F.col("item.title")), link, places, F.col("item.pubDate"), html_to_text(F.col("item.description")), now, "teamtailor")
    return out.filter(F.col("url") != "")


def normalize_personio(captures: DataFrame, now: datetime, host: str) -> DataFrame:
    item = _rows(captures, PERSONIO, "workzag-jobs", "position")
    more = F.coalesce("item.additionalOffices.office", F.array().cast(NO_TEXTS))
    places = F.array_distinct(F.filter(F.transform(F.concat(F.array(F.col("item.office")), more), lambda x: _clean(x)), lambda x: x != ""))
    text = F.array_join(F.transform("item.jobDescriptions.jobDescription", lambda d: d["value"]), " ")
    pid = _clean(F.col("item.id"))
    return _posting(item, pid, _clean(F.col("item.name")), F.concat(F.lit(f"https://{host}/job/"), pid), places, F.col("item.createdAt"), html_to_text(text), now, "personio")


def normalize_successfactors(captures: DataFrame, now: datetime, base: str) -> DataFrame:
    """Labelled fields in any of several languages: city, state, country by the first label that has a value."""
    item = _rows(captures, SUCCESSFACTORS, "Job-Listing", "Job")
    fields = F.array_compact(F.array(*[F.col(f"item.filter{i}") for i in range(1, 10)]))

    def value_of(name: str) -> Column:
        named = F.filter(fields, lambda x: F.lower(F.trim(x["label"])) == name)
        return F.trim(F.try_element_at(named, F.lit(-1))["value"])

    def labelled(names: list[str]) -> Column:
        return F.coalesce(*[F.when(value_of(n) != "", value_of(n)) for n in names])

    place = F.concat_ws(", ", *[labelled(names) for names in V.PLACE_LABELS])
    places = F.when(place != "", F.array(place)).otherwise(F.array().cast(NO_TEXTS))
    req = _clean(F.col("item.ReqId"))
    out = _posting(item, req, html_to_text(F.col("item.JobTitle")), F.concat(F.lit(base), req), places, F.col("item.`Posted-Date`"),
                   html_to_text(F.col("item.`Job-Description`")), now, "successfactors")
    return out.filter((F.col("title") != "") & (F.col("native_id") != ""))


def sitemap_frontier(captures: DataFrame, seen: DataFrame, now: datetime, max_age_days: float, url_pattern: str = ".",
                     max_urls: int | None = None) -> DataFrame:
    """URLs to visit per source: changed within the window, or without a date and never seen; newest first.

    ``max_urls`` is the visiting budget of a run, None for all; the limit is pushed below the shuffle by Spark.
    """
    rows = _rows(captures, SITEMAP, "urlset", "url").select("source_key", _clean(F.col("item.loc")).alias("url"), F.col("item.lastmod").alias("_m"))
    rows = rows.filter((F.col("url") != "") & F.col("url").rlike(url_pattern)).withColumn("lastmod", parse_date(F.col("_m"), now)["ts"])
    dated = rows.filter(F.col("lastmod") >= at(now - timedelta(days=max_age_days + 1)))
    keys = seen.select(F.col("key").alias("_key"))
    undated = rows.filter("lastmod IS NULL").withColumn("_key", F.concat_ws(":", "source_key", "url")).join(keys, "_key", "left_anti")
    both = dated.select("source_key", "url", "lastmod").unionByName(undated.select("source_key", "url", "lastmod"))
    w = Window.partitionBy("source_key").orderBy(F.coalesce("lastmod", at(now)).desc(), "url")
    ranked = both.withColumn("rank", F.row_number().over(w))
    return ranked if max_urls is None else ranked.filter(F.col("rank") <= max_urls)
