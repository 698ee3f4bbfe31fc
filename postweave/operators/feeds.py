"""Feeds made of what was published lately."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.dates import at, iso, rfc822
from ..functions.jsons import null_if_empty, null_if_no_items, object_or_null, prune_nulls
from ..functions.labels import label, status_label
from ..functions.text import job_id, xml_escape
from .state import recent_notified


def feed_items(seen: DataFrame, statuses: DataFrame, now: datetime, families: dict[str, str], lang: str = "en",
               max_items: int = V.FEED_ITEMS) -> DataFrame:
    """The newest publications of 30 days with their tracker status.  Top-n first, then the join of the few left."""
    names = F.create_map(*[F.lit(x) for p in families.items() for x in p])
    recent = recent_notified(seen, now - timedelta(days=V.FEED_DAYS)).orderBy(F.desc("notified_at"), "key").limit(max_items)
    items = recent.withColumn("jid", job_id(F.col("key"))).join(statuses.select(F.col("id").alias("jid"), F.col("status").alias("tracker_status")), "jid", "left")
    return items.select(
        F.col("key").alias("id"), "url", F.concat(F.coalesce("company", F.lit("")), F.lit(" — "), F.coalesce("title", F.lit(""))).alias("title"),
        "company", F.col("title").alias("job_title"), F.col("loc").alias("location"), "posted_at", "first_seen", "notified_at",
        F.array_sort(F.map_keys("notified")).alias("groups"), F.try_element_at(names, F.col("family")).alias("family"), "score", "also_on", (F.col("reason") if "reason" in recent.columns else F.lit(None).cast("string")).alias("reason"),
        "tracker_status", status_label(F.col("tracker_status"), lang).alias("tracker_label"))


def description(lang: str = "en") -> Column:
    also = F.when(F.size("also_on") > 0, F.concat(F.lit(label("also_on", lang) + ": "), F.array_join("also_on", ", ")))
    return F.concat_ws(" · ", null_if_empty(F.col("location")), null_if_empty(F.col("reason")), also)


def tags() -> Column:
    return F.concat("groups", F.array_compact(F.array("family", "tracker_label")))


def _json_item(lang: str) -> Column:
    text = description(lang)
    return prune_nulls(
        id=F.col("id"), url=null_if_empty(F.col("url")), title=null_if_empty(F.col("title")),
        content_text=F.when(text != "", text).otherwise(F.col("title")), summary=null_if_empty(F.col("location")),
        date_published=iso(F.coalesce("posted_at", "first_seen")), date_modified=iso(F.col("notified_at")),
        authors=F.when(F.col("company") != "", F.array(F.struct(F.col("company").alias("name")))), tags=null_if_no_items(tags()),
        _private=object_or_null(company=null_if_empty(F.col("company")), job_title=null_if_empty(F.col("job_title")), location=null_if_empty(F.col("location")), score=F.col("score"),
                                groups=null_if_no_items(F.col("groups")), also_on=null_if_no_items(F.col("also_on")), family=F.col("family"), tracker_status=F.col("tracker_status")))


def json_feed(items: DataFrame, lang: str = "en") -> DataFrame:
    """(id, item): one JSON Feed item per row, without nulls, empty texts and empty lists."""
    return items.select("id", _json_item(lang).alias("item"))


def _joined(items: DataFrame, item: Column, sep: str) -> DataFrame:
    """(items): the texts of all items, newest first.  A feed has a bounded number of items (``feed_items``), so they may meet in one row."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.unix_micros("notified_at")).alias("o"), "id", item.alias("x"))))
    return items.agg(F.array_join(F.transform(ordered, lambda x: x["x"]), sep).alias("items"))


def json_feed_document(items: DataFrame, title: str, lang: str = "en") -> DataFrame:
    """(document): a whole JSON Feed 1.1 file; without items its list is empty."""
    head = {"version": "https://jsonfeed.org/version/1.1", "title": title, "description": f"{title}: {V.FEED_DAYS} days", "language": lang}
    return _joined(items, _json_item(lang), ",").select(F.concat(F.lit(json.dumps(head, ensure_ascii=False)[:-1] + ', "items": ['), "items", F.lit("]}")).alias("document"))


def _tag(name: str, value: Column, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attributes}>"), xml_escape(F.coalesce(value, F.lit(""))), F.lit(f"</{name}>"))


def _rss_item(lang: str) -> Column:
    categories = F.array_join(F.transform(tags(), lambda c: F.concat(F.lit("<category>"), xml_escape(c), F.lit("</category>"))), "")
    return F.concat(
        F.lit("<item>"), _tag("title", F.col("title")), _tag("link", F.col("url")), _tag("guid", F.col("id"), ' isPermaLink="false"'),
        _tag("pubDate", rfc822(F.col("notified_at"))), _tag("description", description(lang)), categories, F.lit("</item>"))


def rss_feed(items: DataFrame, lang: str = "en") -> DataFrame:
    """(id, item): one RSS 2.0 item per row."""
    return items.select("id", _rss_item(lang).alias("item"))


def rss_document(items: DataFrame, title: str, link: str, now: datetime, lang: str = "en") -> DataFrame:
    """(document): a whole RSS 2.0 file."""
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel>'), _tag("title", F.lit(title)), _tag("link", F.lit(link)),
                    _tag("description", F.lit(title)), _tag("language", F.lit(lang)), _tag("lastBuildDate", rfc822(at(now))))
    return _joined(items, _rss_item(lang), "").select(F.concat(head, "items", F.lit("</channel></rss>")).alias("document"))


def latest_items(items: DataFrame, n: int = 10) -> DataFrame:
    """The newest items of a summary, empty texts for what is missing."""
    shown = ["title", "company", "job_title", "url", "location", "tracker_status", "tracker_label"]
    newest = items.orderBy(F.desc("notified_at"), "id").limit(n)
    return newest.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in shown], "notified_at")


def write_document(document: DataFrame, path: str) -> None:
    """One file with the document's text, for readers outside Spark."""
    document.coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def write_json_feed(items: DataFrame, path: str, title: str, lang: str = "en") -> None:
    write_document(json_feed_document(items, title, lang), path)
