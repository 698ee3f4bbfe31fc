"""2.E aggregations, 2.F ranked reports, tracker and schedule rows of 2.D and 2.H, 2.I published tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, labels, text
from ..functions.status import parse_status
from ..operators import digest as G
from ..operators import feeds as FD
from ..operators import health as H
from ..operators import packing as PK
from ..operators import routing as R
from ..operators import scoring as SC
from ..operators import segments as SG
from ..operators import slots as SL
from ..operators import state as S
from ..operators import stats as ST
from ..operators import tracker as TR
from ..session import written
from ..sources import captures as C
from .merging import KEYED, keyed, seen
from .registry import EVENTS_NOW, EVENTS_NOW_SQL, NOW, NOW_SQL, V, Tables, query

WORDS = {"view": "interesa", "click": "Applied", "purchase": "oferta", "signup": "interview", "error": "on hold"}
CODES = {"view": "interested", "click": "applied", "purchase": "offer", "signup": "interview", "error": "on hold"}
WORD_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in WORDS.items()) + " END"
CODE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CODES.items()) + " END"


def word():
    return F.create_map(*[F.lit(x) for p in WORDS.items() for x in p])[F.col("event_type")]


def fetch_log(t: Tables) -> DataFrame:
    """Every event is a run of the source ``user_id``; an error is a failed run."""
    return t.ev.select(F.col("user_id").cast("string").alias("source_key"), F.col("event_id").alias("seq"), "ts",
                       F.date_format("ts", "yyyy-MM-dd").alias("run_id"), (F.col("event_type") != "error").alias("ok"),
                       (F.col("event_type") == "view").alias("skipped"), F.floor(F.col("value") / 30).cast("bigint").alias("jobs"),
                       F.round("value", 2).alias("seconds"), F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("error"))


LOG = """log AS (SELECT CAST(user_id AS VARCHAR) AS source_key, event_id AS seq, ts, strftime(ts, '%Y-%m-%d') AS run_id, event_type <> 'error' AS ok,
 event_type = 'view' AS skipped, floor(value / 30)::BIGINT AS jobs, round(value, 2) AS seconds, 'E' || event_id AS error FROM events)"""
ORDER = ["ts", "seq"]


@query("e1_sources_checked", f"WITH {LOG} SELECT run_id, count(*) FILTER (WHERE ok)::BIGINT AS sources_ok, count(*)::BIGINT AS sources_total FROM log WHERE NOT skipped GROUP BY 1")
def e1_sources(t: Tables) -> DataFrame:
    return ST.sources_checked(fetch_log(t), "run_id")


STATS = f"""{LOG}, once AS (SELECT run_id, source_key, arg_min(ok, seq) AS ok, arg_min(jobs, seq) AS jobs, arg_min(seconds, seq) AS seconds FROM log GROUP BY 1, 2),
ran AS (SELECT source_key, count(*)::BIGINT AS runs, count(*) FILTER (WHERE ok)::BIGINT AS ok, coalesce(sum(jobs) FILTER (WHERE ok), 0)::BIGINT AS jobs, round(sum(seconds), 2) AS seconds FROM once GROUP BY 1),
found AS (SELECT CAST(o_custkey % 160 AS VARCHAR) AS source_key, count(*)::BIGINT AS matches FROM orders GROUP BY 1),
stats AS (SELECT coalesce(ran.source_key, found.source_key) AS source_key, coalesce(runs, 0) AS runs, coalesce(ok, 0) AS ok, coalesce(jobs, 0) AS jobs, coalesce(seconds, 0) AS seconds,
 coalesce(matches, 0) AS matches FROM ran FULL JOIN found ON ran.source_key = found.source_key)"""


def stats_of(t: Tables) -> DataFrame:
    found = t.orders.select((F.col("o_custkey") % 160).cast("string").alias("source_key"))
    return ST.source_stats(fetch_log(t), found)


@query("e2_source_stats", f"WITH {STATS} SELECT * FROM stats")
def e2(t: Tables) -> DataFrame:
    return stats_of(t)


def day_facts(t: Tables) -> DataFrame:
    """Two metrics per event: one run, and what it fetched."""
    metrics = F.array(F.struct(F.lit("runs").alias("metric"), F.lit(1.0).alias("value")),
                      F.struct(F.concat(F.lit("type:"), F.col("event_type")).alias("metric"), F.floor("value").cast("double").alias("value")))
    grp = F.concat(F.lit("g"), (F.col("user_id") % 4).cast("string"))
    return t.ev.select(F.to_date("ts").alias("day"), grp.alias("grp"), F.inline(metrics))


FACTS = """facts AS (SELECT CAST(ts AS DATE) AS day, 'g' || (user_id % 4) AS grp, 'runs' AS metric, 1.0::DOUBLE AS value FROM events
 UNION ALL SELECT CAST(ts AS DATE), 'g' || (user_id % 4), 'type:' || event_type, floor(value) FROM events)"""


@query("e3_daily_rollup", f"WITH {FACTS} SELECT strftime(day, '%Y-%m-%d') AS day, grp, metric, round(sum(value), 2) AS value FROM facts WHERE day > DATE '2024-01-31' - 20 GROUP BY ALL")
def e3(t: Tables) -> DataFrame:
    out = ST.daily_rollup(day_facts(t), date(2024, 1, 31), 20)
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "grp", "metric", "value")


@query("e4_sum_days", f"""WITH {FACTS} SELECT grp, metric, sum(value) + sum(CASE WHEN day = DATE '2024-01-10' THEN value ELSE 0 END) AS value, count(DISTINCT day)::BIGINT AS days
FROM facts WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-16' GROUP BY ALL""")
def e4(t: Tables) -> DataFrame:
    """Seven stored days plus a current run with the figures of the 10th."""
    facts = day_facts(t)
    extra = facts.filter(F.col("day") == F.lit(date(2024, 1, 10))).drop("day")
    return ST.sum_days(facts, date(2024, 1, 10), date(2024, 1, 16), extra)


WEEK_SQL = """win AS (SELECT * FROM k WHERE n % 3 <> 0 AND n % 10 <> 0),
own AS (SELECT n, grp AS g, seen_at AS ts FROM win WHERE n % 4 IN (0, 1) UNION ALL SELECT n, 'favorites', seen_at + INTERVAL 1 DAY FROM win WHERE n % 4 = 1),
hit AS (SELECT * FROM own WHERE ts >= TIMESTAMP '2001-05-26' AND ts < TIMESTAMP '2001-08-02'),
cnt AS (SELECT 'group' AS dimension, g AS label, count(*)::BIGINT AS n FROM hit GROUP BY 2
UNION ALL SELECT 'company', company, count(*) FROM win WHERE n IN (SELECT n FROM hit) GROUP BY 2
UNION ALL SELECT 'family', family, count(*) FROM win WHERE n IN (SELECT n FROM hit) GROUP BY 2)"""


def week_counts(t: Tables) -> DataFrame:
    from datetime import datetime

    return ST.count_by_label(seen(t), datetime(2001, 5, 26), NOW)


@query("e5_count_by_label", f"WITH {KEYED}, {WEEK_SQL} SELECT * FROM cnt")
def e5(t: Tables) -> DataFrame:
    return week_counts(t)


@query("e6_top_n_with_rest", """
WITH c AS (SELECT 'c' || o_custkey AS label, count(*)::BIGINT AS n FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS rn FROM c)
SELECT CASE WHEN rn <= 10 THEN label ELSE 'others' END AS label, sum(n)::BIGINT AS n FROM r GROUP BY 1""")
def e6(t: Tables) -> DataFrame:
    counts = t.orders.groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("label")).agg(F.count("*").alias("n"))
    return ST.top_n_with_rest(counts, "label", "n", 10)


@query("e7_windowed_counts", f"""
SELECT count(*) FILTER (WHERE ts >= {EVENTS_NOW_SQL} - INTERVAL 1 DAY)::BIGINT AS last_24h, count(*) FILTER (WHERE ts >= {EVENTS_NOW_SQL} - INTERVAL 7 DAY)::BIGINT AS last_7d,
 count(*) FILTER (WHERE ts >= {EVENTS_NOW_SQL} - INTERVAL 30 DAY)::BIGINT AS last_30d FROM events""")
def e7(t: Tables) -> DataFrame:
    return ST.windowed_counts(t.ev, "ts", EVENTS_NOW, last_24h=1, last_7d=7, last_30d=30)


def tracker_rows(t: Tables) -> DataFrame:
    """A tracker row per event, with a history of two entries for every second one."""
    day = F.date_format("ts", "yyyy-MM-dd")
    history = F.concat(F.when(F.col("event_id") % 2 == 0, F.concat(F.date_format(F.date_sub("ts", 3), "yyyy-MM-dd"), F.lit(" interesa; "))).otherwise(F.lit("")),
                       day, F.lit(" "), word())
    return t.ev.select(F.col("event_id").cast("string").alias("id"), word().alias("status"), F.when(F.col("event_id") % 5 == 0, F.lit("2024-02-31"))
                       .when(F.col("event_id") % 5 == 1, F.date_format(F.date_add("ts", 1), "yyyy-MM-dd")).otherwise(day).alias("date"),
                       history.alias("history"), "ts", "user_id")


ROWS = f"""rws AS (SELECT event_id, user_id, CAST(event_id AS VARCHAR) AS id, {WORD_SQL} AS status, {CODE_SQL} AS code, CAST(ts AS DATE) AS day,
 CAST(ts AS DATE) + CASE WHEN event_id % 5 = 1 THEN 1 ELSE 0 END AS changed FROM events)"""


@query("e8_status_counts", f"""WITH {ROWS}, o AS (SELECT unnest(range(0, 7)) AS ord, unnest(['interested','applied','interview','offer','rejected','discarded','other']) AS status)
SELECT ord::BIGINT AS ord, o.status, count(id)::BIGINT AS n FROM o LEFT JOIN rws ON CASE WHEN code = 'on hold' THEN 'other' ELSE code END = o.status GROUP BY ALL""")
def e8(t: Tables) -> DataFrame:
    from .. import fixed_values as FV

    out = ST.zero_filled(TR.status_counts(tracker_rows(t)), "status", [*FV.STATUSES, "other"])
    return out.select(F.col("ord").cast("bigint").alias("ord"), "status", "n")


def marks(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Current statuses, message references and known postings: half of the postings were sent by the tool."""
    k = t.v.select(F.col("posting").alias("key"), "n", F.col("source_key").alias("src"), "family")
    current = k.filter("n % 5 < 3").select(text.job_id(F.col("key")).alias("id"), F.when(F.col("n") % 5 == 0, F.lit("aplicado"))
                                           .when(F.col("n") % 5 == 1, F.lit("descartado")).otherwise(F.lit("on hold")).alias("status"))
    messages = k.filter("n % 2 = 0").select(text.job_id(F.col("key")).alias("id"), "key")
    known = k.filter("n % 7 <> 0").select("key", "src", F.when(F.col("n") % 3 != 0, F.col("family")).alias("family"))
    return current, messages, known


MARKS = f"{V}, mk AS (SELECT posting AS key, source_key AS src, CASE WHEN n % 3 <> 0 THEN family END AS family, n % 5 = 0 AS wanted FROM v WHERE n % 5 < 2 AND n % 2 = 0 AND n % 7 <> 0)"


@query("d5_feedback", f"WITH {MARKS} SELECT key, CASE WHEN wanted THEN 'applied' ELSE 'discarded' END AS status, src, family FROM mk")
def d5(t: Tables) -> DataFrame:
    return TR.feedback(*marks(t)).select("key", "status", "src", "family")


@query("e9_acceptance", f"""WITH {MARKS} SELECT 'src:' || src AS name, count(*) FILTER (WHERE wanted)::BIGINT AS wanted, count(*) FILTER (WHERE NOT wanted)::BIGINT AS discarded FROM mk GROUP BY 1
UNION ALL SELECT 'family:' || family, count(*) FILTER (WHERE wanted), count(*) FILTER (WHERE NOT wanted) FROM mk WHERE family IS NOT NULL GROUP BY 1""", once=True)
def e9(t: Tables) -> DataFrame:
    m = written(TR.feedback(*marks(t)), "marks")
    return ST.acceptance(m, F.col("src"), F.concat(F.lit("src:"), "src"), F.concat(F.lit("family:"), "family"))


@query("d6_tracker_status", f"""WITH {V} SELECT posting, CASE n % 5 WHEN 0 THEN 'aplicado' WHEN 1 THEN 'descartado' WHEN 2 THEN 'on hold' END AS status FROM v""")
def d6(t: Tables) -> DataFrame:
    current, _, _ = marks(t)
    return t.v.select("posting", text.job_id(F.col("posting")).alias("id")).join(current, "id", "left").select("posting", "status")


HEALTH = f"""{LOG}, lastok AS (SELECT source_key, max(row(ts, seq)) AS o FROM log WHERE ok GROUP BY 1),
streaks AS (SELECT l.source_key, count(*) FILTER (WHERE NOT ok AND (o IS NULL OR row(ts, seq) > o))::BIGINT AS streak,
 arg_max(error, row(ts, seq)) FILTER (WHERE NOT ok AND (o IS NULL OR row(ts, seq) > o)) AS last_error FROM log l LEFT JOIN lastok USING (source_key) GROUP BY 1),
last10 AS (SELECT source_key, list(jobs ORDER BY ts, seq) AS counts FROM (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY ts DESC, seq DESC) AS rn FROM log WHERE ok) WHERE rn <= 10 GROUP BY 1),
health AS (SELECT s.source_key, streak, coalesce(counts, []) AS counts, CASE WHEN streak >= 3 THEN 'fail x' || streak || ': ' || last_error
 WHEN len(counts) >= 4 AND counts[-1] = 0 AND counts[-2] = 0 AND list_median(counts[1:len(counts) - 2]) > 0 THEN 'zero' END AS problem FROM streaks s LEFT JOIN last10 USING (source_key))"""


@query("f7_fail_streak", f"WITH {HEALTH} SELECT source_key, streak, CASE WHEN streak > 0 THEN last_error END AS last_error FROM streaks")
def f7(t: Tables) -> DataFrame:
    return H.fail_streak(fetch_log(t), ORDER).select("source_key", "streak", "last_error")


@query("f8_last_n_counts", f"WITH {HEALTH} SELECT source_key, array_to_string(counts, ',') AS counts FROM last10")
def f8(t: Tables) -> DataFrame:
    return H.last_n_counts(fetch_log(t), ORDER).select("source_key", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@query("e10_source_health", f"WITH {HEALTH} SELECT source_key, streak, problem FROM health")
def e10(t: Tables) -> DataFrame:
    return H.source_health(fetch_log(t), ORDER).select("source_key", "streak", "problem")


@query("e11_health_summary", f"""WITH {HEALTH}, s AS (SELECT CAST(c_custkey AS VARCHAR) AS source_key FROM customer)
SELECT count(*)::BIGINT AS total, count(streak)::BIGINT AS checked, count(*) FILTER (WHERE streak = 0)::BIGINT AS ok, count(*) FILTER (WHERE streak > 0)::BIGINT AS failing, count(problem)::BIGINT AS problems
FROM s LEFT JOIN health USING (source_key)""")
def e11(t: Tables) -> DataFrame:
    sources = t.customer.select(F.col("c_custkey").cast("string").alias("source_key"))
    return H.health_summary(sources, H.source_health(fetch_log(t), ORDER))


PERF = """SELECT s.source_key, runs, ok, CASE WHEN runs > 0 THEN round(jobs::DOUBLE / runs, 1) ELSE 0 END AS avg_jobs, matches,
 CASE WHEN runs > 0 THEN round(seconds / runs, 1) ELSE 0 END AS avg_seconds, coalesce(problem, 'OK') AS health FROM stats s LEFT JOIN health USING (source_key)"""


@query("e12_source_performance", f"WITH {HEALTH}, {STATS.replace(LOG + ', ', '')} {PERF}")
def e12(t: Tables) -> DataFrame:
    return H.source_performance(stats_of(t), H.source_health(fetch_log(t), ORDER))


@query("e14_pending", f"""WITH {ROWS} SELECT id, CASE code WHEN 'interested' THEN 'to_apply' ELSE 'follow_up' END AS pending, strftime(changed, '%Y-%m-%d') AS since FROM rws
WHERE code = 'interested' OR (code = 'applied' AND changed <= DATE '2024-01-31' - 14)""")
def e14(t: Tables) -> DataFrame:
    rows = tracker_rows(t)
    out = TR.pending(rows, TR.last_change(F.col("history"), F.col("date")), date(2024, 1, 31), 14)
    return out.select("id", "pending", F.date_format("since", "yyyy-MM-dd").alias("since"))


@query("e15_weekly_moves", f"""WITH {ROWS}, c AS (SELECT code, day FROM rws UNION ALL SELECT 'interested', day - 3 FROM rws WHERE event_id % 2 = 0)
SELECT code AS status, count(*)::BIGINT AS n FROM c WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-16' GROUP BY 1""")
def e15(t: Tables) -> DataFrame:
    return TR.weekly_moves(TR.change_log(tracker_rows(t)), date(2024, 1, 10), date(2024, 1, 16))


@query("f6_change_log", f"""WITH {ROWS} SELECT id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS seq, strftime(day, '%Y-%m-%d') AS day, status FROM rws
UNION ALL SELECT id, 0, strftime(day - 3, '%Y-%m-%d'), 'interesa' FROM rws WHERE event_id % 2 = 0""")
def f6(t: Tables) -> DataFrame:
    return TR.change_log(tracker_rows(t)).select("id", F.col("seq").cast("bigint").alias("seq"), F.date_format("day", "yyyy-MM-dd").alias("day"), "status")


@query("f6_last_change", f"WITH {ROWS} SELECT id, strftime(changed, '%Y-%m-%d') AS changed FROM rws")
def f6_last(t: Tables) -> DataFrame:
    changed = TR.last_change(F.col("history"), F.col("date"))
    return tracker_rows(t).select("id", F.date_format(changed, "yyyy-MM-dd").alias("changed"))


# --- ranked reports ---------------------------------------------------------------------------------------------
@query("f3_top_k_with_hidden", f"""
WITH {V}, r AS (SELECT posting, grp, row_number() OVER (PARTITION BY grp ORDER BY score DESC, posting) AS pos, count(*) OVER (PARTITION BY grp) - 50 AS hidden FROM v)
SELECT posting, grp, pos, hidden FROM r WHERE pos <= 50""")
def f3(t: Tables) -> DataFrame:
    top = G.top_k_with_hidden(t.v.select("posting", "grp", "score"), ["grp"], [F.desc("score"), F.col("posting")], 50)
    return top.select("posting", "grp", F.col("pos").cast("bigint").alias("pos"), F.col("hidden").cast("bigint").alias("hidden"))


FAMILY_LABELS = {"MACHINERY": "Machines", "BUILDING": "Building"}
PLACE_ORDER = ["EUROPE", "ASIA"]


def sections(t: Tables) -> DataFrame:
    v = t.v.select("posting", "grp", "score", "kind", "family", F.when(F.col("n") % 3 != 0, F.col("target")).alias("target"), (F.col("n") % 6 == 0).alias("coverage_match"))
    shown = G.top_k_with_hidden(v, ["grp"], [F.desc("score"), F.col("posting")], 50)
    return G.digest_sections(shown, ["grp"], FAMILY_LABELS, PLACE_ORDER)


SECTIONS = f"""{V}, r AS (SELECT posting, grp, kind, row_number() OVER (PARTITION BY grp ORDER BY score DESC, posting) AS pos, CASE WHEN family IN ('MACHINERY', 'BUILDING') THEN family ELSE '' END AS fam,
 CASE WHEN n % 3 <> 0 THEN target WHEN n % 6 = 0 THEN 'Coverage' ELSE '' END AS place FROM v),
o AS (SELECT *, CASE fam WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END AS f, CASE place WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN 1 WHEN '' THEN 3 ELSE 2 END AS p FROM r WHERE pos <= 50),
s AS (SELECT *, dense_rank() OVER (PARTITION BY grp ORDER BY f, p, place) AS section_ord, CASE fam WHEN 'MACHINERY' THEN 'Machines' WHEN 'BUILDING' THEN 'Building' ELSE 'Other roles' END
 || CASE WHEN place <> '' THEN ' · ' || place ELSE '' END || ' (' || count(*) OVER (PARTITION BY grp, f, p, place) || ')' AS heading FROM o)"""


@query("f4_digest_sections", f"WITH {SECTIONS} SELECT posting, section_ord, heading FROM s")
def f4(t: Tables) -> DataFrame:
    return sections(t).select("posting", F.col("section_ord").cast("bigint").alias("section_ord"), "heading")


@query("f5_number_rows", f"WITH {SECTIONS} SELECT posting, CASE WHEN kind = 'job' THEN count(*) FILTER (WHERE kind = 'job') OVER (PARTITION BY grp ORDER BY section_ord, pos) END AS number FROM s")
def f5(t: Tables) -> DataFrame:
    return G.number_rows(sections(t), ["grp"]).select("posting", F.col("number").cast("bigint").alias("number"))


@query("f12_latest_n", f"""SELECT * FROM (SELECT 'change' AS what, CAST(event_id AS VARCHAR) AS id, ts AS at FROM events ORDER BY ts DESC, event_id LIMIT 10)
UNION ALL SELECT * FROM (WITH {V} SELECT 'posting', posting, seen_at FROM v ORDER BY seen_at DESC, posting LIMIT 200)""")
def f12(t: Tables) -> DataFrame:
    changes = TR.latest(t.ev, 10, F.desc("ts"), F.col("event_id")).select(F.lit("change").alias("what"), F.col("event_id").cast("string").alias("id"), F.col("ts").alias("at"))
    items = TR.latest(t.v, 200, F.desc("seen_at"), F.col("posting")).select(F.lit("posting").alias("what"), F.col("posting").alias("id"), F.col("seen_at").cast("timestamp").alias("at"))
    return changes.unionByName(items)


# --- tracker and schedule ---------------------------------------------------------------------------------------
def status_log(t: Tables) -> DataFrame:
    return t.ev.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), "ts", F.to_date("ts").alias("day"), word().alias("status"))


CHANGES = f"""ch AS (SELECT * FROM (SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq, ts, CAST(ts AS DATE) AS day, {WORD_SQL} AS status, event_type,
 lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type)"""


@query("h6_fold_status", f"""WITH {CHANGES} SELECT id, arg_max(status, row(ts, seq)) AS status, strftime(arg_max(day, row(ts, seq)), '%Y-%m-%d') AS date, count(*)::BIGINT AS changes FROM ch GROUP BY 1""")
def h6(t: Tables) -> DataFrame:
    out = TR.fold_status(status_log(t), ORDER, SG.hour_of("ts"))
    return out.select("id", "status", F.date_format("date", "yyyy-MM-dd").alias("date"), "changes")


@query("h6_status_changes", f"WITH {CHANGES} SELECT id, seq, status FROM ch")
def h6_changes(t: Tables) -> DataFrame:
    return TR.status_changes(status_log(t), ORDER, SG.hour_of("ts")).select("id", "seq", "status")


@query("h6_fill_info", """SELECT CAST(user_id AS VARCHAR) AS id, arg_min(event_type, row(ts, event_id)) FILTER (WHERE event_id % 3 = 0) AS company FROM events GROUP BY 1""")
def h6_info(t: Tables) -> DataFrame:
    log = t.ev.select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.lit("")).alias("company"))
    return TR.fill_info(log, ORDER, ["company"])


@query("g4_merge_tracker", f"""WITH {CHANGES} SELECT id, arg_max(status, row(ts, seq)) AS status, count(*)::BIGINT AS changes FROM ch GROUP BY 1""")
def g4(t: Tables) -> DataFrame:
    """Two versions of the log that overlap in a third of the entries; the merged log folds like the whole one."""
    log = status_log(t)
    merged = TR.merge_logs(log.filter("seq % 3 <> 0"), log.filter("seq % 3 <> 1"))
    return TR.fold_status(merged, ORDER, SG.hour_of("ts")).select("id", "status", "changes")


@query("g4_merge_references", """SELECT CAST(event_id AS VARCHAR) AS id, 'c' || (user_id % 7) AS chat, event_id AS msg, CASE WHEN event_id % 3 = 1 THEN 'mine' ELSE 'theirs' END AS owner FROM events""")
def g4_refs(t: Tables) -> DataFrame:
    def version(keep: str, owner: str) -> DataFrame:
        return t.ev.filter(keep).select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("c"), (F.col("user_id") % 7).cast("string")).alias("chat"),
                                        F.col("event_id").alias("msg"), F.lit(owner).alias("owner"))
    return TR.merge_references(version("event_id % 3 <> 0", "mine"), version("event_id % 3 <> 1", "theirs"))


@query("g5_reference_retention", """WITH r AS (SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - 14) SELECT event_id AS msg FROM r WHERE event_id % 2 = 0""")
def g5_refs(t: Tables) -> DataFrame:
    """Reactions live as long as a reference to their message does."""
    refs = t.ev.filter(F.to_date("ts") >= F.lit(date(2024, 1, 17))).select(F.col("event_id").alias("msg"))
    return t.events.filter("event_id % 2 = 0").select(F.col("event_id").alias("msg")).join(refs, "msg", "left_semi")


@query("h7_detect_manual", f"""
WITH b AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, event_id % 4 AS k, 'm-' || substr(sha1('C' || user_id || '|' || event_type || '|'), 1, 8) AS base FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY event_id) AS rn FROM b WHERE k = 0)
SELECT event_id AS pos, CASE WHEN rn = 1 THEN base ELSE base || '-' || rn END AS id, 'applied' AS status, '2024-01-31' AS date, '2024-01-31 applied (manual)' AS history FROM r
UNION ALL SELECT event_id, 'x' || event_id, 'Applied', strftime(day, '%Y-%m-%d'), strftime(day, '%Y-%m-%d') || ' aplicado' FROM b WHERE k = 1
UNION ALL SELECT event_id, 'x' || event_id, 'offer', strftime(day, '%Y-%m-%d'), strftime(day - 1, '%Y-%m-%d') || ' applied; ' || strftime(day, '%Y-%m-%d') || ' offer (manual)' FROM b WHERE k = 2
UNION ALL SELECT event_id, 'x' || event_id, 'on hold', strftime(day, '%Y-%m-%d'), strftime(day + 1, '%Y-%m-%d') || ' applied; 2024-01-31 on hold (manual)' FROM b WHERE k = 3""")
def h7(t: Tables) -> DataFrame:
    """Four kinds of rows: added by hand without id and with an impossible date; unchanged; changed; changed but dated
    before the last entry."""
    k = F.col("event_id") % 4
    day, before, after = (F.date_format(c, "yyyy-MM-dd") for c in (F.col("ts"), F.date_sub("ts", 1), F.date_add("ts", 1)))
    rows = t.ev.select(
        F.col("event_id").alias("pos"), F.when(k == 0, F.lit("")).otherwise(F.concat(F.lit("x"), F.col("event_id").cast("string"))).alias("id"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("company"), F.col("event_type").alias("title"), F.lit("").alias("url"),
        F.when(k == 0, F.lit("applied")).when(k == 1, F.lit("Applied")).when(k == 2, F.lit("offer")).otherwise(F.lit("on hold")).alias("status"),
        F.when(k == 0, F.lit("2026-09-31")).otherwise(day).alias("date"),
        F.when(k == 0, F.lit("")).when(k == 1, F.concat(day, F.lit(" aplicado"))).when(k == 2, F.concat(before, F.lit(" applied")))
        .otherwise(F.concat(after, F.lit(" applied"))).alias("history"))
    return TR.detect_manual(rows, date(2024, 1, 31)).select("pos", "id", "status", "date", "history")


@query("d9_latest_slot", """
WITH e AS (SELECT event_id, ts, timezone('Europe/Berlin', timezone('UTC', ts)) AS l FROM events),
c AS (SELECT event_id, ts, l, CAST(l AS DATE) - CAST(unnest(range(0, 9)) AS INT) AS d FROM e), s AS (SELECT event_id, ts, l, d, d + to_hours(CAST(unnest([9, 18]) AS BIGINT)) AS slot FROM c),
m AS (SELECT event_id, ts, max(slot) AS every, max(slot) FILTER (WHERE isodow(d) IN (1, 3, 7)) AS chosen FROM s WHERE slot <= l GROUP BY 1, 2),
u AS (SELECT event_id, ts, timezone('UTC', timezone('Europe/Berlin', every)) AS every, timezone('UTC', timezone('Europe/Berlin', chosen)) AS chosen FROM m)
SELECT event_id, every, chosen, CASE WHEN ts - chosen <= INTERVAL 12 HOUR THEN chosen END AS in_grace FROM u""")
def d9(t: Tables) -> DataFrame:
    every = SL.latest_slot(F.col("ts"), "Europe/Berlin", ["09:00", "18:00"])
    some = SL.latest_slot(F.col("ts"), "Europe/Berlin", ["09:00", "18:00"], [0, 2, 6])
    e = t.ev.select("event_id", "ts", every.alias("every"), some.alias("chosen"))
    return e.select("event_id", "every", "chosen", SL.slot_in_grace(F.col("ts"), F.col("chosen")).alias("in_grace"))


@query("h8_throttle", """
WITH RECURSIVE a AS (SELECT user_id, ts, epoch_us(ts) AS us FROM events WHERE NOT (strftime(ts, '%H:%M') >= '23:00' OR strftime(ts, '%H:%M') < '07:00')),
w AS (SELECT user_id, min(us) AS us FROM a GROUP BY 1 UNION ALL SELECT w.user_id, min(a.us) FROM w JOIN a ON a.user_id = w.user_id AND a.us >= w.us + 718::BIGINT * 60000000 GROUP BY w.user_id, w.us)
SELECT user_id, make_timestamp(us) AS ts FROM w""")
def h8(t: Tables) -> DataFrame:
    """Polling every 12 hours, never between 23:00 and 07:00."""
    return SL.throttle(t.ev.select("user_id", "ts"), "user_id", "ts", 720, "UTC", "23:00-07:00")


@query("h9_slot_attribution", """
WITH RECURSIVE e AS (SELECT user_id, ts, CASE WHEN strftime(ts, '%H:%M') >= '08:00' THEN CAST(ts AS DATE) + INTERVAL 8 HOUR ELSE CAST(ts AS DATE) - INTERVAL 16 HOUR END AS slot FROM events),
s AS (SELECT user_id, slot, min(ts) AS run_at FROM e WHERE ts - slot <= INTERVAL 12 HOUR GROUP BY 1, 2),
w AS (SELECT user_id, min(slot) AS slot FROM s GROUP BY 1 UNION ALL SELECT w.user_id, min(s.slot) FROM w JOIN s ON s.user_id = w.user_id AND CAST(s.slot AS DATE) >= CAST(w.slot AS DATE) + 3 GROUP BY w.user_id, w.slot)
SELECT w.user_id, w.slot, s.run_at FROM w JOIN s USING (user_id, slot)""")
def h9(t: Tables) -> DataFrame:
    """A slot at 08:00, every three days, at most twelve hours late."""
    return SL.slot_runs(t.ev.select("user_id", "ts"), "user_id", "ts", "UTC", ["08:00"], None, 12, 3)


@query("h10_late_data", """SELECT count(*)::BIGINT AS kept, event_type FROM (SELECT event_type, ts, CASE WHEN strftime(ts, '%H:%M') >= '06:00' THEN CAST(ts AS DATE) + INTERVAL 6 HOUR ELSE CAST(ts AS DATE) - INTERVAL 18 HOUR END AS slot FROM events)
WHERE ts - slot <= INTERVAL 12 HOUR GROUP BY 2""")
def h10(t: Tables) -> DataFrame:
    """Wake-ups that still execute their slot; later ones are dropped."""
    slot = SL.slot_in_grace(F.col("ts"), SL.latest_slot(F.col("ts"), "UTC", ["06:00"]))
    return t.ev.withColumn("slot", slot).filter("slot IS NOT NULL").groupBy("event_type").agg(F.count("*").alias("kept"))


@query("d11_route_join", f"""WITH {V} SELECT posting, CASE target WHEN 'ASIA' THEN 'asia-room' WHEN 'MIDDLE EAST' THEN 'me' ELSE '(default)' END AS route FROM v""")
def d11(t: Tables) -> DataFrame:
    routes = R.Routes(places={"Asia": "asia-room", "Middle-East": "me"})
    return t.v.select("posting", F.coalesce(R.place_route(F.col("target"), routes), F.lit(routes.catch_all)).alias("route"))


ROUTES = R.Routes("index", "stars", "rest", {"Asia": "asia-room", "EUROPE": "stars"}, 90)


def notification(t: Tables) -> DataFrame:
    high = (F.col("score") >= ROUTES.highlight_score) | (F.col("source_key") == "s1")
    return t.v.select(F.col("posting").alias("key"), "grp", "target", F.struct((-F.col("score")).alias("s"), "posting").alias("pos"), high.alias("highlight"))


PLAN = f"""{V}, b AS (SELECT posting AS key, grp, score, target, score >= 90 OR source_key = 's1' AS high FROM v),
c AS (SELECT grp, key, score, 'stars' AS route, 'highlights' AS kind, 0 AS step FROM b WHERE high
 UNION ALL SELECT grp, key, score, CASE target WHEN 'ASIA' THEN 'asia-room' WHEN 'EUROPE' THEN 'stars' ELSE 'rest' END, CASE WHEN target IN ('ASIA', 'EUROPE') THEN 'place' ELSE 'other' END, 1 FROM b),
o AS (SELECT grp, route, key, min(step) AS step, any_value(score) AS score FROM c GROUP BY 1, 2, 3), f AS (SELECT grp, route, arg_min(kind, row(step, -score, key)) AS kind FROM c GROUP BY 1, 2),
plan AS (SELECT grp, 'index' AS route, 'summary' AS kind, key, 0 AS step, score FROM b UNION ALL SELECT grp, route, kind, key, step, score FROM o JOIN f USING (grp, route))"""


@query("i6_routing_plan", f"WITH {PLAN} SELECT grp, route, kind, key FROM plan")
def i6(t: Tables) -> DataFrame:
    return R.routing_plan(notification(t), ROUTES).select("grp", "route", "kind", "key")


@query("i6_shown_per_route", f"""WITH {PLAN}, r AS (SELECT *, row_number() OVER (PARTITION BY grp, kind, route ORDER BY step, -score, key) AS route_pos FROM plan)
SELECT grp, route, key, route_pos FROM r WHERE route_pos <= CASE WHEN kind = 'summary' THEN 200 ELSE 50 END""")
def i6_shown(t: Tables) -> DataFrame:
    shown = R.shown_per_route(R.routing_plan(notification(t), ROUTES), 50)
    return shown.select("grp", "route", "key", F.col("route_pos").cast("bigint").alias("route_pos"))


@query("d14_key_back_resolution", f"WITH {V} SELECT posting AS asked, CASE WHEN n % 2 = 0 OR n % 7 <> 0 THEN posting END AS key FROM v")
def d14(t: Tables) -> DataFrame:
    _, messages, known = marks(t)
    asked = t.v.select(F.col("posting").alias("asked"), text.job_id(F.col("posting")).alias("id"))
    return TR.resolve_keys(asked, messages, known).select("asked", "key")


@query("d14_info_from_message", f"WITH {V} SELECT posting, company, title, url FROM v")
def d14_info(t: Tables) -> DataFrame:
    message = F.concat("company", F.lit(" — "), "title", F.lit("\nmore — text"))
    return t.v.select("posting", TR.info_from_message(message, F.col("url")).alias("i")).select("posting", "i.company", "i.title", "i.url")


@query("d13_reactions", f"""
WITH b AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'd' WHEN 2 THEN 'ad' ELSE '' END AS seen, {CODE_SQL} AS code, event_id % 7 = 0 AS old FROM events),
x AS (SELECT *, CASE seen WHEN 'ad' THEN CASE WHEN code = 'applied' THEN 'discarded' ELSE 'applied' END WHEN 'a' THEN 'applied' WHEN 'd' THEN 'discarded' END AS target FROM b
 WHERE seen <> '' AND NOT old AND code NOT IN ('offer', 'interview')) SELECT event_id AS msg, target FROM x WHERE code <> target""")
def d13(t: Tables) -> DataFrame:
    base = t.ev.select(F.col("event_id").cast("string").alias("id"), F.lit("c1").alias("chat"), F.col("event_id").alias("msg"), word().alias("status"))
    k = F.col("msg") % 4
    seen_now = base.select("chat", "msg", F.when(k == 0, F.lit("a")).when(k == 1, F.lit("d")).when(k == 2, F.lit("ad")).otherwise(F.lit("")).alias("seen"))
    return TR.resolve_reactions(base.select("id", "chat", "msg"), seen_now, seen_now.filter("msg % 7 = 0"), base).select("msg", "target")


# --- published tables --------------------------------------------------------------------------------------------
def feed(t: Tables) -> DataFrame:
    current, _, _ = marks(t)
    statuses = current.withColumn("status", parse_status(F.col("status"))).filter("status IS NOT NULL")
    return FD.feed_items(seen(t), statuses, NOW, {"BUILDING": "Building", "MACHINERY": "Machines"})


FEED = f"""{KEYED}, n0 AS (SELECT *, CASE WHEN n % 4 = 1 THEN seen_at + INTERVAL 1 DAY ELSE seen_at END AS pub FROM k WHERE n % 3 <> 0 AND n % 4 IN (0, 1)),
items AS (SELECT *, CASE family WHEN 'BUILDING' THEN 'Building' WHEN 'MACHINERY' THEN 'Machines' END AS fam, CASE n % 5 WHEN 0 THEN 'applied' WHEN 1 THEN 'discarded' END AS st,
 CASE n % 5 WHEN 0 THEN '✅ Applied' WHEN 1 THEN '❌ Discarded' END AS stl FROM n0 WHERE pub >= {NOW_SQL} - INTERVAL 30 DAY ORDER BY pub DESC, key LIMIT 300)"""


@query("i2_feed_items", f"""WITH {FEED} SELECT key AS id, company || ' — ' || upper(title) AS title, loc AS location, pub AS notified_at,
 CASE WHEN n % 4 = 1 THEN grp || ',favorites' ELSE grp END AS groups, fam AS family, st AS tracker_status, stl AS tracker_label FROM items""")
def i2(t: Tables) -> DataFrame:
    return feed(t).select("id", "title", "location", "notified_at", F.array_join("groups", ",").alias("groups"), "family", "tracker_status", "tracker_label")


def q(name: str, expr: str) -> str:
    return f"""'"{name}":"' || {expr} || '"'"""


TAGS = "CASE WHEN n % 4 = 1 THEN '\"' || grp || '\",\"favorites\"' ELSE '\"' || grp || '\"' END"
ISO = "%Y-%m-%dT%H:%M:%S+00:00"


@query("i2_json_feed", f"""WITH {FEED} SELECT key AS id, '{{' || {q('id', 'key')} || ',' || {q('url', 'url')} || ',' || {q('title', "company || ' — ' || upper(title)")} || ','
 || {q('content_text', "loc || ' · Also on: board'")} || ',' || {q('summary', 'loc')} || ',' || {q('date_published', f"strftime(coalesce(posted_at, seen_at - INTERVAL 5 DAY), '{ISO}')")} || ','
 || {q('date_modified', f"strftime(pub, '{ISO}')")} || ',"authors":[{{' || {q('name', 'company')} || '}}],"tags":[' || {TAGS} || CASE WHEN fam IS NULL THEN '' ELSE ',"' || fam || '"' END
 || CASE WHEN stl IS NULL THEN '' ELSE ',"' || stl || '"' END || '],"_private":{{' || {q('company', 'company')} || ',' || {q('job_title', 'upper(title)')} || ',' || {q('location', 'loc')}
 || ',"score":' || score || ',"groups":[' || {TAGS} || '],"also_on":["board"]' || CASE WHEN fam IS NULL THEN '' ELSE ',"family":"' || fam || '"' END
 || CASE WHEN st IS NULL THEN '' ELSE ',"tracker_status":"' || st || '"' END || '}}}}' AS item FROM items""")
def i2_json(t: Tables) -> DataFrame:
    return FD.json_feed(feed(t))


@query("i3_rss_feed", f"""WITH {FEED} SELECT key AS id, '<item><title>' || company || ' — ' || upper(title) || '</title><link>' || url || '</link><guid isPermaLink="false">' || key || '</guid><pubDate>'
 || strftime(pub, '%a, %d %b %Y %H:%M:%S +0000') || '</pubDate><description>' || loc || ' · Also on: board</description><category>' || grp || '</category>'
 || CASE WHEN n % 4 = 1 THEN '<category>favorites</category>' ELSE '' END || CASE WHEN fam IS NULL THEN '' ELSE '<category>' || fam || '</category>' END
 || CASE WHEN stl IS NULL THEN '' ELSE '<category>' || stl || '</category>' END || '</item>' AS item FROM items""")
def i3(t: Tables) -> DataFrame:
    return FD.rss_feed(feed(t))


@query("i4_summary", f"""WITH {FEED}, g AS (SELECT 'group' AS what, grp AS label FROM items UNION ALL SELECT 'group', 'favorites' FROM items WHERE n % 4 = 1
 UNION ALL SELECT 'family', coalesce(fam, 'Other roles') FROM items UNION ALL SELECT 'window', '24h' FROM items WHERE pub >= {NOW_SQL} - INTERVAL 1 DAY
 UNION ALL SELECT 'window', '7d' FROM items WHERE pub >= {NOW_SQL} - INTERVAL 7 DAY UNION ALL SELECT 'window', '30d' FROM items) SELECT what, label, count(*)::BIGINT AS n FROM g GROUP BY 1, 2""")
def i4(t: Tables) -> DataFrame:
    """Counts of the feed by group, family and window."""
    age = (F.unix_micros(dates.at(NOW)) - F.unix_micros("notified_at")) / 86_400_000_000

    def pair(what: str, value) -> object:
        return F.struct(F.lit(what).alias("what"), value.alias("label"))

    rows = F.concat(F.transform("groups", lambda g: pair("group", g)), F.array_compact(F.array(
        pair("family", F.coalesce("family", F.lit(labels.label("other")))), F.when(age <= 1, pair("window", F.lit("24h"))),
        F.when(age <= 7, pair("window", F.lit("7d"))), pair("window", F.lit("30d")))))
    return feed(t).select(F.inline(rows)).groupBy("what", "label").agg(F.count("*").alias("n"))


@query("i5_tracker_feed", f"""WITH {ROWS} SELECT id, CASE WHEN code = 'on hold' THEN 'other' ELSE code END AS status, strftime(changed, '%Y-%m-%d') AS date, (DATE '2024-01-31' - changed)::BIGINT AS days
FROM rws ORDER BY changed DESC, id LIMIT 200""")
def i5(t: Tables) -> DataFrame:
    """The newest 200 tracker rows with the days since their last change (the size of the published feed)."""
    rows = tracker_rows(t).withColumn("changed", TR.last_change(F.col("history"), F.col("date")))
    newest = TR.latest(rows, 200, F.desc("changed"), F.col("id"))
    return newest.select("id", F.coalesce(parse_status(F.col("status")), F.lit("other")).alias("status"), F.date_format("changed", "yyyy-MM-dd").alias("date"),
                         F.datediff(F.lit(date(2024, 1, 31)), F.col("changed")).cast("bigint").alias("days"))


@query("i7_pack_texts", f"""
WITH RECURSIVE p AS (SELECT conv_id, turn AS i, substr(text, 1, 1500) AS part, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
w AS (SELECT conv_id, rn, 0 AS msg, part AS cur FROM p WHERE rn = 1
 UNION ALL SELECT w.conv_id, p.rn, CASE WHEN w.cur <> '' AND length(w.cur) + 2 + length(p.part) > 1500 THEN w.msg + 1 ELSE w.msg END,
 CASE WHEN w.cur = '' THEN p.part WHEN length(w.cur) + 2 + length(p.part) > 1500 THEN p.part ELSE w.cur || chr(10) || chr(10) || p.part END FROM w JOIN p ON p.conv_id = w.conv_id AND p.rn = w.rn + 1)
SELECT conv_id, msg::BIGINT AS msg, arg_max(cur, rn) AS text FROM w GROUP BY 1, 2""")
def i7(t: Tables) -> DataFrame:
    """The turns of a conversation, in order, each cut to 1,500 characters and packed into messages of as many, as the SQL twin says."""
    return PK.pack_rows(t.conversations, "conv_id", "turn", "text", F.floor(F.col("turn") / 1000), 1500, cut=True)


@query("i7_pack_whole_texts", """
WITH RECURSIVE c AS (SELECT conv_id, turn, text, unnest(range(0, greatest(length(text), 1), 1500)) AS k FROM conversations),
p AS (SELECT conv_id, substr(text, k + 1, 1500) AS part, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS rn FROM c),
w AS (SELECT conv_id, rn, 0 AS msg, part AS cur FROM p WHERE rn = 1
 UNION ALL SELECT w.conv_id, p.rn, CASE WHEN w.cur <> '' AND length(w.cur) + 2 + length(p.part) > 1500 THEN w.msg + 1 ELSE w.msg END,
 CASE WHEN w.cur = '' THEN p.part WHEN length(w.cur) + 2 + length(p.part) > 1500 THEN p.part ELSE w.cur || chr(10) || chr(10) || p.part END FROM w JOIN p ON p.conv_id = w.conv_id AND p.rn = w.rn + 1)
SELECT conv_id, msg::BIGINT AS msg, arg_max(cur, rn) AS text FROM w GROUP BY 1, 2""")
def i7_whole(t: Tables) -> DataFrame:
    """The same with whole turns: one longer than a message goes on in the next."""
    return PK.pack_rows(t.conversations, "conv_id", "turn", "text", F.floor(F.col("turn") / 1000), 1500)


@query("i7_pack_blocks", """
WITH RECURSIVE p AS (SELECT conv_id, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
w AS (SELECT conv_id, rn, 0 AS msg, 1 AS n, s AS total FROM p WHERE rn = 1
 UNION ALL SELECT w.conv_id, p.rn, CASE WHEN n >= 3 OR total + s > 900 THEN msg + 1 ELSE msg END, CASE WHEN n >= 3 OR total + s > 900 THEN 1 ELSE n + 1 END,
 CASE WHEN n >= 3 OR total + s > 900 THEN s ELSE total + s END FROM w JOIN p ON p.conv_id = w.conv_id AND p.rn = w.rn + 1)
SELECT conv_id, array_to_string(list(msg ORDER BY rn), ',') AS messages FROM w GROUP BY 1""")
def i7_blocks(t: Tables) -> DataFrame:
    turns = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("size")))).alias("ts"))
    out = PK.pack_blocks(F.transform("ts", lambda x: x["size"]), 3, 900)
    return turns.select("conv_id", F.array_join(out.cast("array<string>"), ",").alias("messages"))


@query("i7_cut_bytes", """SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 500 THEN text ELSE (SELECT substr(text, 1, max(i)) FROM range(0, 501) r(i) WHERE octet_length(encode(substr(text, 1, i::INT))) <= 500) END AS cut FROM documents""")
def i7_bytes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", PK.cut_bytes(F.col("text"), 500).alias("cut"))


@query("i8_posting_lines", f"""
WITH {V} SELECT posting, company || ' — ' || CASE WHEN kind = 'page_change' THEN 'Careers page changed' ELSE title END AS heading,
 company || ' · 📍 ' || substr(location, 1, 60) || ' · ⭐ ' || score || ' · 🕒 ' || strftime(coalesce(posted_at, seen_at), '%d/%m') || CASE WHEN n % 3 = 0 THEN ' · ⚡ already alerted' ELSE '' END
 || CASE WHEN n % 2 = 0 THEN ' · Also on: b1, b2' ELSE '' END AS compact,
 '📍 ' || location || CASE WHEN n % 5 = 0 THEN ' (coverage)' ELSE '' END || chr(10) || '🕒 ' || CASE WHEN posted_at IS NULL THEN 'Detected ' || strftime(seen_at, '%d/%m %H:%M') ELSE 'Posted ' || strftime(posted_at, '%d/%m') END
 || chr(10) || '⭐ Fit ' || score || '/100' || CASE WHEN n % 2 = 0 THEN ' · 🎓 Exp. 5+ years' ELSE '' END || CASE WHEN n % 3 = 0 OR n % 2 = 0 THEN chr(10) ELSE '' END
 || CASE WHEN n % 3 = 0 THEN '⚡ already alerted' ELSE '' END || CASE WHEN n % 6 = 0 THEN ' · ' ELSE '' END || CASE WHEN n % 2 = 0 THEN 'Also on: b1, b2' ELSE '' END AS meta FROM v""")
def i8(t: Tables) -> DataFrame:
    n = F.col("n")
    v = t.v.select("posting", "company", "title", "kind", "score", F.array("location").alias("locations"), F.col("posted_at").cast("timestamp").alias("posted_at"),
                   F.lit("date").alias("posted_precision"), F.col("seen_at").cast("timestamp").alias("first_seen"), (n % 3 == 0).alias("already_alerted"),
                   (n % 5 == 0).alias("coverage_match"), F.when(n % 2 == 0, F.array(F.lit("b1"), F.lit("b2"))).otherwise(F.array().cast("array<string>")).alias("also_on"),
                   F.when(n % 2 == 0, F.lit("5+")).alias("experience"), F.lit(None).cast("string").alias("reason"))
    return v.select("posting", G.heading().alias("heading"), G.compact_meta(NOW, "UTC").alias("compact"),
                    F.array_join(G.meta_lines(NOW, "UTC"), "\n").alias("meta"))


@query("i9_status_text", f"""WITH {ROWS} SELECT 'funnel' AS what, CASE WHEN code = 'on hold' THEN 'other' ELSE code END AS label, count(*)::BIGINT AS n FROM rws GROUP BY 2
UNION ALL SELECT CASE code WHEN 'interested' THEN 'to_apply' ELSE 'follow_up' END, NULL, count(*) FROM rws WHERE code = 'interested' OR (code = 'applied' AND changed <= DATE '2024-01-31' - 14) GROUP BY 1""")
def i9(t: Tables) -> DataFrame:
    rows = tracker_rows(t)
    funnel = TR.status_counts(rows).select(F.lit("funnel").alias("what"), F.col("status").alias("label"), "n")
    waiting = TR.pending(rows, TR.last_change(F.col("history"), F.col("date")), date(2024, 1, 31), 14)
    return funnel.unionByName(waiting.groupBy(F.col("pending").alias("what")).agg(F.count("*").alias("n")).select("what", F.lit(None).cast("string").alias("label"), "n"))


# --- state over runs, as batches -----------------------------------------------------------------------------------
@query("h1_observe_batches", """SELECT user_id, min(ts) AS first_seen, max(CAST(ts AS DATE))::TIMESTAMP AS last_day, arg_max(event_type, row(ts, event_id)) AS latest FROM events GROUP BY 1""")
def h1(t: Tables) -> DataFrame:
    """What is remembered per key after all batches: first sight, last day, latest attributes."""
    out = S.remembered(t.ev.withColumn("seq", F.col("event_id")), "user_id", F.col("event_type"), days=None)
    return out.select("user_id", "first_seen", F.to_date("last_seen").cast("timestamp").alias("last_day"), "latest")


@query("h2_publish_once", """SELECT user_id, event_type AS grp, min(ts) AS published_at FROM events WHERE event_id % 4 <> 0 GROUP BY 1, 2""")
def h2(t: Tables) -> DataFrame:
    """A (key, group) pair is published by its first delivered attempt; failed deliveries (every fourth) mark nothing."""
    attempts = t.ev.select("user_id", F.col("event_type").alias("grp"), "ts", F.col("event_id").alias("seq"), (F.col("event_id") % 4 != 0).alias("delivered"))
    return S.publish_once(attempts, ["user_id", "grp"]).select("user_id", "grp", "published_at")


@query("h3_baseline_on_first_run", """WITH f AS (SELECT user_id, min(CAST(ts AS DATE)) AS day FROM events GROUP BY 1)
SELECT event_id, CAST(ts AS DATE) = day AND value < 50 AS baseline FROM events JOIN f USING (user_id)""")
def h3(t: Tables) -> DataFrame:
    """Undated rows (value < 50) of a source's first run, its first day, are baseline."""
    rows = S.first_run(t.ev, "user_id", F.to_date("ts"), ("ts", "event_id"))
    return rows.select("event_id", (F.col("first_run") & (F.col("value") < 50)).alias("baseline"))


@query("h4_bootstrap", f"WITH {V} SELECT posting AS key, true AS baseline, 0::BIGINT AS published FROM v")
def h4(t: Tables) -> DataFrame:
    """A bootstrap run: everything observed is baseline, and nothing is a candidate to be published."""
    run = S.first_look(keyed(t), seen(t), keyed(t).select("source_key").limit(0), NOW, "g", 30, bootstrap=True)
    return run.select("key", "baseline", F.col("decision").isNull().cast("bigint").alias("published"))


@query("h5_ttl_state", """SELECT user_id FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-31' - INTERVAL 2 DAY""")
def h5(t: Tables) -> DataFrame:
    last = t.ev.groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return S.expire(last, "last_seen", EVENTS_NOW, 2).select("user_id")


@query("h11_incremental_offset", """WITH m AS (SELECT user_id, max(event_id) AS done FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT event_id FROM events LEFT JOIN m USING (user_id) WHERE done IS NULL OR event_id > done OR user_id % 9 = 0""")
def h11(t: Tables) -> DataFrame:
    """Rows after the last processed id of their stream; a stream that is unknown, or whose identity changed, starts again."""
    rows = t.ev.withColumn("identity", F.when(F.col("user_id") % 9 == 0, F.lit("v2")).otherwise(F.lit("v1")))
    processed = t.ev.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp")).withColumn("identity", F.lit("v1"))
    return C.resume(rows, C.offsets_after(processed, "user_id", "identity", "event_id"), "user_id", "identity", "event_id").select("event_id")


@query("h13_score_batches", """WITH d AS (SELECT d.doc_id, d.n_chars, CASE WHEN quality = 1 THEN 'good' END AS kw, CASE WHEN d.doc_id % 4 <> 0 THEN length(text) % 101 END AS score FROM documents d LEFT JOIN labels USING (doc_id))
SELECT CAST(doc_id AS VARCHAR) AS key, score::BIGINT AS score, CASE WHEN score IS NULL AND kw IS NULL THEN 'ai_unavailable' WHEN score < 40 THEN 'ai_score' END AS decision FROM d""")
def h13(t: Tables) -> DataFrame:
    """A deterministic scorer: the length of what it is shown; it gives no answer for every fourth document."""
    docs = t.documents.select(F.col("doc_id").cast("string").alias("key"), F.lit("").alias("title"), F.col("text").alias("description"))

    def scorer(batch: list[dict]) -> dict[int, dict]:
        return {i: {"score": len(d["description"]) % 101} for i, d in enumerate(batch) if int(d["key"]) % 4}

    answers = SC.score_batches(docs, scorer)
    known = t.labels.select(F.col("doc_id").cast("string").alias("key"), F.when(F.col("quality") == 1, F.lit("good")).alias("kw_family"))
    out = SC.apply_scores(docs.select("key").join(known, "key", "left"), answers, 40)
    return out.select("key", F.col("score").cast("bigint").alias("score"), "decision")


@query("a14_sink_lines", f"""WITH {V} SELECT posting, '{{"posting":"' || posting || '","title":"' || title || '","score":' || score || '}}' AS json, posting || ',' || title || ',' || score AS csv FROM v""")
def a14(t: Tables) -> DataFrame:
    """The lines the JSON and CSV sinks write."""
    row = F.struct("posting", "title", "score")
    return t.v.select("posting", F.to_json(row).alias("json"), F.to_csv(row).alias("csv"))


def report_lines(t: Tables) -> DataFrame:
    """Lines of the weekly report as (section, line_ord, line); every part is a small aggregate of its own."""
    from .. import fixed_values as FV

    c = written(week_counts(t), "counts")
    parts = []
    for i, (dimension, top) in enumerate((("group", None), ("company", FV.TOP_COMPANIES), ("family", None))):
        counts = c.filter(F.col("dimension") == dimension).select("label", "n")
        shown = ST.top_n_with_rest(counts, "label", "n", top) if top else counts
        parts.append(shown.select(F.lit(f"1 new by {dimension}").alias("section"), F.when(F.col("label") == "others", F.lit(2)).otherwise(F.lit(1)).alias("line_ord"),
                                  text.md_row(F.col("label"), F.col("n")).alias("line")))
    totals = ST.sum_days(day_facts(t), date(2024, 1, 25), date(2024, 1, 31))
    parts.append(totals.select(F.lit("2 checked").alias("section"), F.lit(1).alias("line_ord"), text.md_row(F.col("grp"), F.col("metric"), F.col("value").cast("bigint")).alias("line")))
    moves = TR.weekly_moves(TR.change_log(tracker_rows(t)), date(2024, 1, 25), date(2024, 1, 31))
    counts = TR.status_counts(tracker_rows(t)).join(moves.withColumnRenamed("n", "moves"), "status", "left")
    parts.append(counts.select(F.lit("3 tracker").alias("section"), F.lit(1).alias("line_ord"), text.md_row(F.col("status"), F.col("n"), F.coalesce("moves", F.lit(0))).alias("line")))
    perf = H.source_performance(stats_of(t), H.source_health(fetch_log(t), ORDER))
    parts.append(perf.select(F.lit("4 sources").alias("section"), F.lit(1).alias("line_ord"), text.md_row(
        F.col("source_key"), F.col("runs"), F.col("ok"), F.col("avg_jobs"), F.col("matches"), F.col("avg_seconds"), F.col("health")).alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("line_ord", F.col("line_ord").cast("bigint"))


@query("i1_weekly_report", f"""
WITH {KEYED}, {WEEK_SQL}, {ROWS}, {FACTS}, {HEALTH}, {STATS.replace(LOG + ', ', '')}, perf AS ({PERF}),
comp AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS rn FROM cnt WHERE dimension = 'company'),
mv AS (SELECT code, count(*) AS m FROM (SELECT code, day FROM rws UNION ALL SELECT 'interested', day - 3 FROM rws WHERE event_id % 2 = 0) WHERE day BETWEEN DATE '2024-01-25' AND DATE '2024-01-31' GROUP BY 1)
SELECT '1 new by ' || dimension AS section, 1::BIGINT AS line_ord, '| ' || label || ' | ' || n || ' |' AS line FROM cnt WHERE dimension <> 'company'
UNION ALL SELECT '1 new by company', CASE WHEN rn <= 10 THEN 1 ELSE 2 END, '| ' || CASE WHEN rn <= 10 THEN label ELSE 'others' END || ' | ' || sum(n)::BIGINT || ' |' FROM comp GROUP BY CASE WHEN rn <= 10 THEN label ELSE 'others' END, CASE WHEN rn <= 10 THEN 1 ELSE 2 END
UNION ALL SELECT '2 checked', 1, '| ' || grp || ' | ' || metric || ' | ' || sum(value)::BIGINT || ' |' FROM facts WHERE day BETWEEN DATE '2024-01-25' AND DATE '2024-01-31' GROUP BY grp, metric
UNION ALL SELECT '3 tracker', 1, '| ' || s || ' | ' || c || ' | ' || coalesce(m, 0) || ' |' FROM (SELECT CASE WHEN code = 'on hold' THEN 'other' ELSE code END AS s, count(*) AS c FROM rws GROUP BY 1) LEFT JOIN mv ON mv.code = s
UNION ALL SELECT '4 sources', 1, '| ' || source_key || ' | ' || runs || ' | ' || ok || ' | ' || avg_jobs || ' | ' || matches || ' | ' || avg_seconds || ' | ' || health || ' |' FROM perf""")
def i1(t: Tables) -> DataFrame:
    return report_lines(t)


