"""Published files as readers see them: written, read back and parsed."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import feeds as FD
from ..operators import tracker as TR
from ..sources import sinks
from .registry import NOW, V, Tables, query
from .reports import FEED, ROWS, feed, tracker_rows
from .runs import own_folder

TITLE = "Openings & more"


@query("a14_written_files", f"WITH {V} SELECT 'json' AS sink, posting, title, score, false AS quoted FROM v UNION ALL SELECT 'csv', posting, title, score, false FROM v")
def a14_files(t: Tables) -> DataFrame:
    """What the sinks write, read back."""
    folder = own_folder(t, "sinks")
    rows = t.v.select("posting", "title", "score")
    sinks.json_lines(rows).write.text(f"{folder}/json")
    sinks.write_tracker_csv(rows, f"{folder}/csv")
    schema = "posting string, title string, score bigint"
    back = t.spark.read.schema(schema).json(f"{folder}/json").select(F.lit("json").alias("sink"), "*")
    back = back.unionByName(t.spark.read.schema(schema).option("header", True).csv(f"{folder}/csv").select(F.lit("csv").alias("sink"), "*"))
    return back.withColumn("quoted", F.col("title").contains('"'))


@query("i2_feed_document", f"""WITH {FEED} SELECT row_number() OVER (ORDER BY pub DESC, key) - 1 AS pos, key AS id, company || ' — ' || upper(title) AS title, 'https://jsonfeed.org/version/1.1' AS version,
 'Openings & more: 30 days' AS description, fam AS family FROM items""")
def i2_document(t: Tables) -> DataFrame:
    """The whole JSON Feed file, parsed again."""
    path = own_folder(t, "feed")
    FD.write_json_feed(feed(t), path, TITLE)
    schema = "version string, title string, description string, language string, items array<struct<id:string,title:string,_private:struct<family:string>>>"
    read = t.spark.read.option("wholetext", True).text(path).select(F.from_json("value", schema).alias("f"))
    items = read.select("f.version", "f.description", F.posexplode("f.items").alias("pos", "i"))
    return items.select(F.col("pos").cast("bigint").alias("pos"), "i.id", "i.title", "version", "description", F.col("i._private.family").alias("family"))


@query("i3_rss_document", f"""WITH {FEED} SELECT row_number() OVER (ORDER BY pub DESC, key) - 1 AS pos, key AS guid, url AS link, 'Openings & more' AS channel,
 'Thu, 02 Aug 2001 00:00:00 +0000' AS built FROM items""")
def i3_document(t: Tables) -> DataFrame:
    """The whole RSS file, parsed again."""
    path = own_folder(t, "rss")
    FD.write_document(FD.rss_document(feed(t), TITLE, "https://example.test/", NOW), path)
    read = t.spark.read.option("wholetext", True).text(path)

    def all_of(name: str):
        return F.xpath("value", F.lit(f"/rss/channel/item/{name}/text()"))
    both = read.select(F.xpath_string("value", F.lit("/rss/channel/title")).alias("channel"), F.xpath_string("value", F.lit("/rss/channel/lastBuildDate")).alias("built"),
                       F.posexplode(F.arrays_zip(all_of("guid").alias("guid"), all_of("link").alias("link"))).alias("pos", "i"))
    return both.select(F.col("pos").cast("bigint").alias("pos"), F.col("i.guid").alias("guid"), F.col("i.link").alias("link"), "channel", "built")


@query("i4_latest", f"""WITH {FEED} SELECT key AS id, company || ' — ' || upper(title) AS title, company, upper(title) AS job_title, url, loc AS location, coalesce(st, '') AS tracker_status,
 coalesce(stl, '') AS tracker_label, pub AS notified_at FROM items ORDER BY pub DESC, key LIMIT 10""")
def i4_latest(t: Tables) -> DataFrame:
    """The ten newest items of the summary."""
    return FD.latest_items(feed(t))


@query("i5_tracker_totals", f"""WITH {ROWS}, c AS (SELECT CASE WHEN code = 'on hold' THEN 'other' ELSE code END AS code, changed FROM rws),
o AS (SELECT 'counts' AS section, unnest(['interested','applied','interview','offer','rejected','discarded','other']) AS label)
SELECT section, label, (SELECT count(*) FROM c WHERE c.code = o.label)::BIGINT AS n FROM o UNION ALL SELECT 'total', 'rows', count(*) FROM c
UNION ALL SELECT 'pending', 'to_apply', count(*) FILTER (WHERE code = 'interested') FROM c
UNION ALL SELECT 'pending', 'follow_up', count(*) FILTER (WHERE code = 'applied' AND changed <= DATE '2024-01-31' - 14) FROM c""")
def i5_totals(t: Tables) -> DataFrame:
    """Counts, total and pending of the tracker feed in one pass."""
    rows = tracker_rows(t)
    return TR.tracker_totals(rows, TR.last_change(F.col("history"), F.col("date")), date(2024, 1, 31), 14)


@query("i9_last_changes", f"""WITH {ROWS}, e AS (SELECT event_id, id, 1 AS seq, day, code AS status, event_id % 2 = 0 AS two FROM rws UNION ALL SELECT event_id, id, 0, day - 3, 'interested', true FROM rws WHERE event_id % 2 = 0)
SELECT id, (CASE WHEN two THEN seq ELSE 0 END)::INTEGER AS seq, day, status FROM e ORDER BY day DESC, event_id DESC, seq DESC LIMIT 10""")
def i9_last(t: Tables) -> DataFrame:
    """The ten latest changes of the status text."""
    rows = tracker_rows(t).withColumn("position", F.col("id").cast("long"))
    return TR.last_changes(rows, "position").select("id", "seq", "day", "status")
