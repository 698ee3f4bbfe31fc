"""State over runs: sightings that expire, first runs, bootstrap, stored state in buckets, captured files read once."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import health as H
from ..operators import slots as SL
from ..operators import state as S
from ..operators.segments import hour_of, with_row_number
from ..operators.stored import BucketStore, add_names
from ..session import checkpoint_dir, written
from ..sources import captures as C
from ..sources import mail as M
from ..sources import paging as PG
from .merging import KEYED, keyed, split_published
from .registry import EVENTS_NOW, NOW, NOW_SQL, Tables, query

FIRST_RUN = datetime(2000, 6, 1)


def own_folder(t: Tables, label: str) -> str:
    """A new folder in the shared place that the cluster names."""
    return f"{checkpoint_dir(t.spark)}/{label}-{uuid.uuid4().hex}"


def sightings(t: Tables) -> DataFrame:
    return t.ev.select("user_id", "ts", F.col("event_id").alias("seq"), "event_type", "value")


@query("a1_scan_files", """SELECT event_type AS source_key, event_id % 5 <> 0 AS ok, CASE WHEN event_id % 5 = 0 THEN 'body is not JSON' END AS error, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def a1_files(t: Tables) -> DataFrame:
    """Payload files that land in two steps and are drained after each; a third run finds nothing new.  Every fifth payload is cut in the middle."""
    folder = own_folder(t, "captures")
    body = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"x": '), F.substring("props", 1, 3))).otherwise(F.col("props"))
    late = F.col("ts") >= F.lit("2024-01-15").cast("timestamp")
    for landed in (~late, late, None):
        if landed is not None:
            t.ev.filter(landed).select(body.alias("value"), F.col("event_type").alias("source_key")).write.partitionBy("source_key").mode("append").text(f"{folder}/in")
        batches = C.drain(C.capture_stream(t.spark, f"{folder}/in"), f"{folder}/good", f"{folder}/bad", f"{folder}/checkpoint")
        if landed is None and batches:
            raise RuntimeError("files were read twice")
    good = t.spark.read.parquet(f"{folder}/good").select("source_key", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    bad = t.spark.read.parquet(f"{folder}/bad").select("source_key", F.lit(False).alias("ok"), "error")
    return good.unionByName(bad).groupBy("source_key", "ok", "error").agg(F.count("*").alias("n"))


@query("a8e_window", """
WITH m AS (SELECT event_type AS box, max(event_id) FILTER (WHERE ts < TIMESTAMP '2024-01-25') AS last_uid FROM events GROUP BY 1),
f AS (SELECT event_type AS box, event_id AS uid FROM events JOIN m ON box = event_type WHERE (event_id > last_uid OR event_type = 'view') AND ts >= TIMESTAMP '2024-01-27')
SELECT box, uid FROM f QUALIFY row_number() OVER (PARTITION BY box ORDER BY uid DESC) <= 300""")
def a8e_window(t: Tables) -> DataFrame:
    """Unread mails of the last three days and one more, the newest 300 of a box (the limits of a run are the feature)."""
    mails = t.ev.select(F.col("event_type").alias("box"), F.lit("v2").alias("validity"), F.col("event_id").alias("uid"), F.col("ts").alias("sent_at"))
    state = t.ev.groupBy(F.col("event_type").alias("box")).agg(F.max(F.when(F.col("ts") < F.lit("2024-01-25").cast("timestamp"), F.col("event_id"))).alias("last_uid"))
    state = state.withColumn("validity", F.when(F.col("box") == "view", F.lit("v1")).otherwise(F.lit("v2")))
    return M.unread(mails, state, 300, EVENTS_NOW, 3).select("box", "uid")


@query("a11_total_and_empty_page", """
WITH r AS (SELECT o_custkey % 20 AS s, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) AS rn FROM orders),
p AS (SELECT s, (rn - 1) // 5 + 1 AS page_no, count(*) AS n FROM r GROUP BY ALL), q AS (SELECT * FROM p UNION ALL SELECT s, max(page_no) + 1, 0 FROM p GROUP BY s),
e AS (SELECT *, n < 5 OR (s % 4 = 0 AND page_no * 5 >= 20 + s * 10) AS stop FROM q)
SELECT CAST(s AS VARCHAR) AS source_key, page_no::BIGINT AS page_no, n::BIGINT AS rows, stop AS last FROM e
QUALIFY coalesce(bool_or(stop) OVER (PARTITION BY s ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) = false""")
def a11_total(t: Tables) -> DataFrame:
    """Every fourth source states a total; the page after a source's last posting was captured empty."""
    numbered = with_row_number(t.orders.select((F.col("o_custkey") % 20).alias("s"), "o_orderkey"), ["s"], ["o_orderkey"], F.floor(F.col("o_orderkey") / 10_000), "rn")
    rows = numbered.select(F.col("s").cast("string").alias("source_key"), (F.floor((F.col("rn") - 1) / 5) + 1).cast("bigint").alias("page_no"), F.lit(NOW).alias("posted_at"))
    pages = rows.select("source_key", "page_no").unionByName(rows.groupBy("source_key").agg((F.max("page_no") + 1).alias("page_no")))
    totals = rows.select("source_key", F.col("source_key").cast("bigint").alias("k")).distinct().filter("k % 4 = 0").select("source_key", (20 + F.col("k") * 10).alias("total"))
    out = PG.pages_until_cutoff(rows, NOW, 60, 5, pages_read=pages, totals=totals)
    return out.select("source_key", "page_no", F.col("rows").cast("bigint").alias("rows"), "last")


@query("a13_routing_places", """SELECT 'unknown routing place' AS rule, 'r' || n_nationkey || ':' || n_name AS subject FROM nation WHERE n_regionkey >= 3""")
def a13_places(t: Tables) -> DataFrame:
    """Routes to all nations, of which three regions' are configured places."""
    routes = t.nation.select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("route"), F.col("n_name").alias("place"), "n_regionkey")
    sources = t.nation.limit(0).select(F.lit("").alias("id"), F.lit("").alias("grp"), F.lit(False).alias("favorite"), F.lit("").alias("url"), F.lit("").alias("type"),
                                       F.array(F.lit("")).alias("families"))
    groups = t.nation.limit(0).select(F.lit("").alias("grp"), F.array(F.lit("")).alias("times"), F.array(F.lit("")).alias("weekdays"), F.lit("").alias("quiet_hours"))
    return PG.validate_dimensions(sources, groups, t.nation.limit(0).select(F.lit("").alias("family")), routes, routes.filter("n_regionkey < 3").select("place"))


@query("h1_observe_log", """
WITH l AS (SELECT event_id AS seq, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
n AS (SELECT *, prev IS NULL OR ts - prev > INTERVAL 1 DAY AS is_new FROM l)
SELECT seq, user_id, is_new, last_value(CASE WHEN is_new THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, seq) AS first_seen,
 last_value(CASE WHEN is_new OR CAST(prev AS DATE) <> CAST(ts AS DATE) THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, seq) AS last_seen FROM n""")
def h1_log(t: Tables) -> DataFrame:
    """Every sighting: new or remembered, if keys are forgotten after a day."""
    return S.observe_log(sightings(t), "user_id", 1).select("seq", "user_id", "is_new", "first_seen", "last_seen")


@query("h3_baseline_kept", """
WITH f AS (SELECT event_type, CAST(min(ts) AS DATE) AS day FROM events GROUP BY 1),
m AS (SELECT user_id, min(row(ts, event_id)) AS marked FROM events JOIN f USING (event_type) WHERE CAST(ts AS DATE) = day AND value < 50 GROUP BY 1)
SELECT event_id AS seq, coalesce(value < 50 AND row(ts, event_id) >= marked, false) AS baseline FROM events LEFT JOIN m USING (user_id)""")
def h3_kept(t: Tables) -> DataFrame:
    """Undated rows (value < 50) of a source's first day mark their key, and later undated rows of the key stay baseline."""
    return S.with_baseline(sightings(t), "event_type", "user_id", F.col("value") < 50, F.to_date("ts")).select("seq", "baseline")


@query("h4_after_bootstrap", f"""
WITH {KEYED}, o AS (SELECT *, seen_at < TIMESTAMP '2000-06-01' AS old FROM k)
SELECT key, NOT old AS is_new, old OR (posted_at IS NULL AND kind = 'job' AND source_key NOT IN (SELECT source_key FROM o WHERE old)) AS baseline,
 CASE WHEN posted_at IS NULL AND kind = 'job' AND (old OR source_key NOT IN (SELECT source_key FROM o WHERE old)) THEN 'baseline'
  WHEN coalesce(posted_at, CASE WHEN old THEN TIMESTAMP '2000-06-01' ELSE {NOW_SQL} END) < {NOW_SQL} - INTERVAL 30 DAY THEN 'too_old' END AS decision FROM o""")
def h4_after(t: Tables) -> DataFrame:
    """A bootstrap run over what was there in June 2000, then a normal run over everything."""
    old, _ = split_published(t)
    first = S.first_look(old, no_state(t), old.select("source_key").limit(0), FIRST_RUN, "g", 30, bootstrap=True)
    state = first.select("key", "first_seen", "baseline", F.from_json(F.lit("{}"), "map<string,timestamp>").alias("notified"))
    return S.first_look(keyed(t), state, first.select("source_key"), NOW, "g", 30).select("key", "is_new", "baseline", "decision")


def no_state(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([], "key string, first_seen timestamp, baseline boolean, notified map<string,timestamp>")


@query("h12_health_changes", """
WITH l AS (SELECT user_id AS source_key, event_id AS seq, event_type <> 'error' AS ok, lag(event_type <> 'error') OVER w AS ok_before,
  count(*) FILTER (WHERE event_type <> 'error') OVER w AS island, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CASE WHEN ok THEN 0 ELSE count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY source_key, island ORDER BY ts, seq) END AS streak FROM l)
SELECT source_key, seq, CASE WHEN ok THEN 'recovered' ELSE 'failing' END AS change, streak::BIGINT AS streak FROM s WHERE (ok AND NOT ok_before) OR (NOT ok AND streak <= 5)""")
def h12_health(t: Tables) -> DataFrame:
    """Which runs of a source change its stored health: recoveries, and the first five failures of a streak."""
    log = t.ev.select(F.col("user_id").alias("source_key"), F.col("event_id").alias("seq"), "ts", (F.col("event_type") != "error").alias("ok"))
    return H.health_changes(log, ["ts", "seq"], hour_of("ts")).select("source_key", "seq", "change", "streak")


EARLIER = """
p AS (SELECT * FROM k WHERE seen_at < TIMESTAMP '2000-06-01'), q AS (SELECT * FROM k WHERE seen_at >= TIMESTAMP '2000-06-01'),
m AS (SELECT q.key AS later, p.key, p.grp = q.grp AS here FROM q JOIN p ON p.curl = q.curl AND q.curl <> '' AND p.key <> q.key
 UNION SELECT q.key, p.key, p.grp = q.grp FROM q JOIN p ON p.fp = q.fp AND p.key <> q.key AND (p.tgt = q.tgt OR p.tgt IS NULL OR q.tgt IS NULL)),
e AS (SELECT later FROM m GROUP BY 1 HAVING NOT bool_or(here)),
names AS (SELECT m.key, 'Customer ' || (q.n % 10) AS name, min(row(-q.score, q.source_key, q.native_id)) AS r FROM m JOIN e USING (later) JOIN q ON q.key = m.later GROUP BY 1, 2)"""


@query("e13_also_on_earlier", f"""
WITH {KEYED}, {EARLIER} SELECT p.key, array_to_string(list_concat(['board'], coalesce(list(name ORDER BY r) FILTER (WHERE name IS NOT NULL), [])), ',') AS also_on
FROM p LEFT JOIN names USING (key) GROUP BY 1""")
def e13_earlier(t: Tables) -> DataFrame:
    """Stored publications take the names of sources that later bring the same offer to another group; only their buckets are rewritten."""
    published, new = (written(part, "postings") for part in split_published(t))
    store = BucketStore(own_folder(t, "publications"), "key string, also_on array<string>", buckets=16)
    store.upsert(published.select("key", F.array(F.lit("board")).alias("also_on")), 1, lambda old, changes: changes)
    previous = S.published_elsewhere(new, published)
    elsewhere = previous.filter((F.size("prev_groups") > 0) & ~F.array_contains("prev_groups", F.col("grp")))
    copies = elsewhere.select("key", "fp", "curl", "tgt", "score", "source_key", "native_id", F.concat(F.lit("Customer "), (F.col("n") % 10).cast("string")).alias("source_name"))
    rank = F.struct(-F.col("score"), F.col("source_key"), F.col("native_id"))
    store.upsert(S.names_for_earlier(copies, published, rank), 2, add_names)
    return store.read(t.spark).select("key", F.array_join("also_on", ",").alias("also_on"))


@query("g3_merge_destinations", """
SELECT event_type AS channel, CAST(user_id % 50 AS VARCHAR) AS route, CAST(min(event_id * 7919 % 100003) AS VARCHAR) AS ident FROM events GROUP BY 1, 2""")
def g3_destinations(t: Tables) -> DataFrame:
    """Chats made for one route by two runs at once; the smaller number is the older one."""
    def version(of) -> DataFrame:
        ident = (F.col("event_id") * 7919 % 100003).cast("string")
        made = t.ev.filter(of).select(F.col("event_type").alias("channel"), (F.col("user_id") % 50).cast("string").alias("route"), ident.alias("ident"))
        return made.groupBy("channel", "route").agg(F.min_by("ident", F.col("ident").cast("long")).alias("ident"))
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    return S.merge_destinations(version(early), version(~early))


@query("h9_forced_runs", """
WITH e AS (SELECT event_id, user_id, ts, timezone('Europe/Berlin', timezone('UTC', ts)) AS l FROM events),
c AS (SELECT event_id, user_id, ts, l, CAST(l AS DATE) - CAST(unnest(range(0, 3)) AS INT) AS d FROM e), s AS (SELECT event_id, user_id, ts, l, d + to_hours(CAST(unnest([9, 18]) AS BIGINT)) AS slot FROM c)
SELECT event_id, user_id, timezone('UTC', timezone('Europe/Berlin', max(slot))) AS slot, ts AS run_at FROM s WHERE slot <= l GROUP BY event_id, user_id, ts""")
def h9_forced(t: Tables) -> DataFrame:
    """Forced runs take their latest slot, however late and however often."""
    wakes = t.ev.select(F.struct("event_id", "user_id").alias("wake"), "ts")
    return SL.forced_runs(wakes, "wake", "ts", "Europe/Berlin", ["09:00", "18:00"]).select("wake.event_id", "wake.user_id", "slot", "run_at")
