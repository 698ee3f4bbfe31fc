"""2.D joins on state, F2 and its companions, 2.G merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import dedupe as DD
from ..operators import digest as G
from ..operators import keywords as K
from ..operators import state as S
from ..operators import stats as ST
from ..operators import waterfall as W
from ..session import written
from . import duck
from .filters import WATERFALL_AGE, WATERFALL_SQL, waterfall_input
from .registry import NOW, NOW_SQL, V, Tables, query


def days(column: str, n: int):
    return F.timestamp_seconds(F.unix_seconds(F.col(column).cast("timestamp")) + n * 86400)


def keyed(t: Tables) -> DataFrame:
    """Postings with their derived identities."""
    return t.v.select(
        F.col("posting").alias("key"), "source_key", "native_id", "n", "grp", "title", "company", "url", "family", "score", "kind",
        F.col("location").alias("loc"), F.col("posted_at").cast("timestamp").alias("posted_at"),
        F.col("seen_at").cast("timestamp").alias("seen_at"),
        text.fingerprint(F.col("company"), F.col("title"), F.col("posting")).alias("fp"),
        urls.canonical_url(F.col("url")).alias("curl"), F.col("source_key").alias("src"),
        F.when(F.col("n") % 6 != 0, F.col("target")).alias("tgt"))


KEYED = (f"{V}, k AS (SELECT posting AS key, source_key, native_id, n, grp, title, company, url, family, score, kind, location AS loc, posted_at, "
         f"seen_at, {duck.fingerprint('company', 'title', 'posting')} AS fp, {duck.canonical_url('url')} AS curl, "
         "CASE WHEN n % 6 <> 0 THEN target END AS tgt FROM v)")


def seen(t: Tables) -> DataFrame:
    """SEEN with two thirds of the postings, half of them observed earlier today."""
    k = keyed(t).filter("n % 3 <> 0")
    notified = F.when(F.col("n") % 4 == 0, F.map_from_arrays(F.array("grp"), F.array("seen_at"))).when(
        F.col("n") % 4 == 1, F.map_from_arrays(F.array("grp", F.lit("favorites")), F.array(F.col("seen_at"), days("seen_at", 1))))
    none = F.from_json(F.lit("{}"), "map<string,timestamp>")
    return k.select(
        "key", days("seen_at", -5).alias("first_seen"),
        F.when(F.col("n") % 2 == 0, F.lit("2001-08-01 10:00:00").cast("timestamp")).otherwise(F.lit("2001-08-02 00:00:00").cast("timestamp")).alias("last_seen"),
        F.upper("title").alias("title"), "company", "url", "loc", "posted_at", "fp", "src", "tgt", (F.col("n") % 7 == 0).alias("baseline"),
        F.coalesce(notified, none).alias("notified"), F.array(F.lit("board")).alias("also_on"), "family",
        F.col("score").cast("int").alias("score"), F.when(F.col("n") % 10 == 0, F.lit("x:1")).alias("dup_of"))


@query("d2_observe", f"""
WITH {V} SELECT posting AS key, n % 3 = 0 AS is_new, CASE WHEN n % 3 = 0 THEN {NOW_SQL} ELSE seen_at - INTERVAL 5 DAY END AS first_seen,
 n % 3 <> 0 AND n % 7 = 0 AS baseline FROM v WHERE n % 5 <> 0""")
def d2(t: Tables) -> DataFrame:
    fetched = keyed(t).filter("n % 5 <> 0").select("key", "title")
    return S.observe(fetched, seen(t), NOW).select("key", "is_new", "first_seen", "baseline")


@query("d2_next_seen", f"""
WITH {V} SELECT posting AS key, CASE WHEN n % 3 = 0 THEN {NOW_SQL} ELSE seen_at - INTERVAL 5 DAY END AS first_seen,
 CASE WHEN n % 3 = 0 THEN {NOW_SQL} WHEN n % 5 = 0 AND n % 2 = 0 THEN TIMESTAMP '2001-08-01 10:00:00' ELSE {NOW_SQL} END AS last_seen,
 CASE WHEN n % 5 = 0 THEN upper(title) ELSE title END AS title FROM v WHERE n % 3 <> 0 OR n % 5 <> 0""")
def d2_next(t: Tables) -> DataFrame:
    return S.next_seen(keyed(t).filter("n % 5 <> 0"), seen(t), NOW).select("key", "first_seen", "last_seen", "title")


@query("d3_verdict_cache", f"""
WITH {V} SELECT posting AS key, CASE WHEN n % 4 = 0 THEN score END::BIGINT AS verdict, n % 4 <> 0 AS to_score FROM v""")
def d3(t: Tables) -> DataFrame:
    verdicts = t.v.filter("n % 2 = 0").select(
        F.col("posting").alias("key"), F.when(F.col("n") % 4 == 0, F.lit("now")).otherwise(F.lit("old")).alias("criteria"),
        F.col("score").alias("verdict"))
    out = S.cached_verdicts(t.v.select(F.col("posting").alias("key")), verdicts, "now")
    return out.select("key", F.col("verdict").cast("bigint").alias("verdict"), F.col("verdict").isNull().alias("to_score"))


def split_published(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = keyed(t)
    published = k.filter(F.col("seen_at") < F.lit("2000-06-01").cast("timestamp"))
    return published, k.filter(F.col("seen_at") >= F.lit("2000-06-01").cast("timestamp"))


PREVIOUS = """
p AS (SELECT * FROM k WHERE seen_at < TIMESTAMP '2000-06-01'), q AS (SELECT * FROM k WHERE seen_at >= TIMESTAMP '2000-06-01'),
g AS (SELECT q.key, p.grp FROM q JOIN p ON p.curl = q.curl AND q.curl <> '' AND p.key <> q.key
 UNION SELECT q.key, p.grp FROM q JOIN p ON p.fp = q.fp AND p.key <> q.key AND (p.tgt = q.tgt OR p.tgt IS NULL OR q.tgt IS NULL)),
prev AS (SELECT key, list_sort(list(DISTINCT grp)) AS groups FROM g GROUP BY key)"""


@query("d4_previous_duplicates", f"WITH {KEYED}, {PREVIOUS} SELECT q.key, coalesce(array_to_string(groups, ','), '') AS prev_groups FROM q LEFT JOIN prev USING (key)")
def d4(t: Tables) -> DataFrame:
    published, new = split_published(t)
    published, new = written(published, "published"), written(new, "new")
    return S.published_elsewhere(new, published).select("key", F.array_join("prev_groups", ",").alias("prev_groups"))


# The sequential walk, one row per step and group.  Kept tokens are carried as numbers.
def walk_sql(rows: str) -> str:
    """CTEs ``decided(key, decision, dup_of)`` from a CTE with (key, grp, tok1, tok2, prev_here, prev_else, rk)."""
    return f"""
tok AS (SELECT tok, row_number() OVER (ORDER BY tok)::INT AS id FROM (SELECT DISTINCT tok1 AS tok FROM {rows} UNION SELECT DISTINCT tok2 FROM {rows})),
num AS (SELECT r.*, a.id AS t1, b.id AS t2, row_number() OVER (PARTITION BY grp ORDER BY rk) AS rn FROM {rows} r JOIN tok a ON a.tok = tok1 JOIN tok b ON b.tok = tok2),
walk AS (SELECT grp, 0::BIGINT AS rn, []::INT[] AS held, NULL::VARCHAR AS key, false AS kept FROM (SELECT DISTINCT grp FROM {rows})
 UNION ALL SELECT w.grp, m.rn, CASE WHEN list_contains(w.held, m.t1) OR list_contains(w.held, m.t2) OR m.prev_here OR m.prev_else THEN w.held
  ELSE list_concat(w.held, [m.t1, m.t2]) END, m.key, NOT (list_contains(w.held, m.t1) OR list_contains(w.held, m.t2) OR m.prev_here OR m.prev_else)
 FROM walk w JOIN num m ON m.grp = w.grp AND m.rn = w.rn + 1),
kept AS (SELECT m.* FROM walk w JOIN num m USING (key) WHERE w.kept),
decided AS (SELECT m.key, m.grp, coalesce(a.key, b.key) AS dup_of, CASE WHEN k.key IS NOT NULL THEN NULL WHEN coalesce(a.key, b.key) IS NOT NULL THEN 'duplicate'
 WHEN m.prev_here THEN 'duplicate_previous' ELSE 'duplicate_other_group' END AS decision
 FROM num m LEFT JOIN kept k USING (key) LEFT JOIN kept a ON a.t1 = m.t1 AND a.rn < m.rn LEFT JOIN kept b ON b.t2 = m.t2 AND b.rn < m.rn)"""


RANKED = f"""
RECURSIVE {KEYED}, rows AS (SELECT key, grp, grp || fp || '|' || coalesce(tgt, '') AS tok1, grp || 'u' || curl AS tok2, n % 37 = 0 AS prev_here,
 n % 37 <> 0 AND n % 41 = 0 AS prev_else, row_number() OVER (ORDER BY score DESC, source_key, native_id) AS rk FROM k), {walk_sql('rows')}"""


def ranked(t: Tables) -> DataFrame:
    k = keyed(t)
    return k.select(
        "key", "grp", "score", "source_key", "native_id", "company", F.concat_ws("", F.col("grp"), F.col("fp"), F.lit("|"), F.col("tgt")).alias("tok_fp"),
        F.when(F.col("curl") != "", F.concat(F.col("grp"), F.lit("u"), F.col("curl"))).alias("tok_url"),
        (F.col("n") % 37 == 0).alias("prev_here"), (F.col("n") % 41 == 0).alias("prev_elsewhere"))


def by_rank():
    return DD.rank_order("score", "source_key", "native_id")


@query("f2_rank_greedy_dedupe", f"WITH {RANKED} SELECT key, decision, dup_of FROM decided")
def f2(t: Tables) -> DataFrame:
    return DD.decide_duplicates(written(ranked(t), "ranked"), "key", ["tok_fp", "tok_url"], by_rank()).select("key", "decision", "dup_of")


@query("f10_best_copy_first", f"WITH {RANKED} SELECT d.key, k.score::BIGINT AS score FROM decided d JOIN k USING (key) WHERE decision IS NULL")
def f10(t: Tables) -> DataFrame:
    out = DD.decide_duplicates(ranked(t), "key", ["tok_fp", "tok_url"], by_rank())
    return out.filter("decision IS NULL").select("key", F.col("score").cast("bigint").alias("score"))


@query("e13_also_on", f"""
WITH {RANKED}, d AS (SELECT x.dup_of, 'Customer ' || (k.n % 10) AS name, min(k.score * -1) AS s, min(row(k.score * -1, k.source_key, k.native_id)) AS r
 FROM decided x JOIN k USING (key) WHERE decision = 'duplicate' GROUP BY ALL)
SELECT d.dup_of AS key, string_agg(name, ',' ORDER BY r) AS also_on FROM d JOIN k ON k.key = d.dup_of
WHERE lower(name) <> trim(regexp_replace(lower(k.company), '[^a-z0-9]+', ' ', 'g')) GROUP BY 1""")
def e13(t: Tables) -> DataFrame:
    rows = written(ranked(t), "ranked")
    out = DD.decide_duplicates(rows, "key", ["tok_fp", "tok_url"], by_rank())
    dups = out.filter("decision = 'duplicate'").withColumn("source_name", F.concat(F.lit("Customer "), (F.col("native_id").cast("bigint") % 10).cast("string")))
    return DD.merge_also_on(dups, rows, "key", by_rank()).select("key", F.array_join("also_on", ",").alias("also_on"))


@query("e16_distinct_first_wins", """
SELECT l_orderkey, l_linenumber, arg_min(l_partkey, row(l_shipdate, l_partkey, l_suppkey, l_extendedprice)) AS l_partkey,
 arg_min(l_extendedprice, row(l_shipdate, l_partkey, l_suppkey, l_extendedprice)) AS price FROM lineitem GROUP BY 1, 2""")
def e16(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.col("l_extendedprice").alias("price"))
    return DD.distinct_first_wins(li, ["l_orderkey", "l_linenumber"], "l_shipdate", "l_partkey", "l_suppkey", "price").select(
        "l_orderkey", "l_linenumber", "l_partkey", "price")


@query("e16_distinct_last_wins", """
SELECT l_orderkey, l_linenumber, arg_max(l_partkey, row(l_shipdate, l_partkey, l_suppkey, l_extendedprice)) AS l_partkey FROM lineitem GROUP BY 1, 2""")
def e16_last(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.col("l_extendedprice").alias("price"))
    return DD.distinct_last_wins(li, ["l_orderkey", "l_linenumber"], "l_shipdate", "l_partkey", "l_suppkey", "price").select(
        "l_orderkey", "l_linenumber", "l_partkey")


@query("d7_company_semi_join", f"""
WITH {V} SELECT posting FROM v WHERE contains({duck.norm('company')}, 'customer 1') OR contains({duck.norm('company')}, 'r 42 ltd')""")
def d7(t: Tables) -> DataFrame:
    """Results whose company contains a wanted name."""
    return t.v.filter(K.contains_name(text.normalize_text(F.col("company")), ["Customer 1", "R. 42, Ltd"])).select("posting")


@query("d8_unseen", r"""
WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS href FROM pages),
old AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS href FROM pages WHERE page_id % 2 = 0)
SELECT href FROM l WHERE href NOT IN (SELECT href FROM old)""")
def d8(t: Tables) -> DataFrame:
    links = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("href"))
    old = links.filter("page_id % 2 = 0").select("href")
    return links.select("href").distinct().join(old, "href", "left_anti")


@query("d10_group_membership", """
SELECT s_suppkey, 'g' || (s_suppkey % 5) AS grp FROM supplier WHERE s_acctbal > 0
UNION ALL SELECT s_suppkey, 'favorites' FROM supplier WHERE s_acctbal > 0 AND s_suppkey % 3 = 0""")
def d10(t: Tables) -> DataFrame:
    """Sources of every group: its own enabled ones, and every favourite in ``favorites``."""
    s = t.supplier.select("s_suppkey", F.concat(F.lit("g"), (F.col("s_suppkey") % 5).cast("string")).alias("grp"),
                          (F.col("s_suppkey") % 3 == 0).alias("favorite"), (F.col("s_acctbal") > 0).alias("enabled"))
    groups = F.array_distinct(F.array_compact(F.array("grp", F.when(F.col("favorite"), F.lit("favorites")))))
    return s.filter("enabled").select("s_suppkey", F.explode(groups).alias("grp"))


@query("d12_detail_join", f"""
WITH {V}, c AS (SELECT * FROM v WHERE kind = 'job' AND n % 2 = 0 AND n % 6 <> 0)
SELECT posting, grp, coalesce(d.text, '') AS detail FROM c LEFT JOIN documents d ON d.doc_id = c.n""")
def d12(t: Tables) -> DataFrame:
    """Details for the survivors without description and without a remembered verdict."""
    missing = t.v.filter("kind = 'job' AND n % 2 = 0").select("posting", "grp", "n", F.lit("").alias("description"))
    known = t.v.filter("n % 6 = 0").select("posting")
    details = t.documents.select(F.col("doc_id").alias("n"), F.col("text").alias("detail"))
    out = S.join_details(missing, details, ["n"], "posting", known)
    return out.select("posting", "grp", F.col("description").alias("detail"))


# --- sets and merges -------------------------------------------------------------------------------------------
@query("g1_union_sources", f"WITH {V} SELECT posting, title, CASE WHEN n % 2 = 1 THEN score END AS score FROM v WHERE n % 3 <> 0 OR n % 2 = 1")
def g1(t: Tables) -> DataFrame:
    even = t.v.filter("n % 2 = 0 AND n % 3 <> 0").select("posting", "title")
    return even.unionByName(t.v.filter("n % 2 = 1").select("posting", "title", "score"), allowMissingColumns=True)


@query("g2_except", """SELECT event_type || user_id AS link FROM (SELECT DISTINCT event_type, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20')
WHERE event_type || user_id NOT IN (SELECT event_type || user_id FROM events WHERE ts < TIMESTAMP '2024-01-10')""")
def g2(t: Tables) -> DataFrame:
    link = F.concat("event_type", F.col("user_id").cast("string")).alias("link")
    now = t.ev.filter(F.col("ts") >= F.lit("2024-01-20").cast("timestamp")).select(link).distinct()
    return now.join(t.ev.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp")).select(link), "link", "left_anti")


def _show_map(c: str):
    entries = F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), F.date_format(e["value"], "yyyy-MM-dd"))))
    return F.array_join(entries, ",")


@query("g3_merge_state", f"""
WITH {V}, b AS (SELECT posting AS key, n, grp, seen_at, n % 3 <> 2 AS mine, n % 3 <> 0 AS theirs FROM v)
SELECT key, CASE WHEN mine AND theirs THEN seen_at - INTERVAL 2 DAY WHEN mine THEN seen_at ELSE seen_at - INTERVAL 2 DAY END AS first_seen,
 CASE WHEN mine THEN seen_at + INTERVAL 1 DAY ELSE seen_at END AS last_seen,
 CASE WHEN mine AND theirs THEN CASE WHEN grp < 'x' THEN grp || '=' || strftime(seen_at - INTERVAL 3 DAY, '%Y-%m-%d') || ',' ELSE '' END || 'y=' || strftime(seen_at, '%Y-%m-%d')
  || ',z=' || strftime(seen_at, '%Y-%m-%d') WHEN mine THEN grp || '=' || strftime(seen_at, '%Y-%m-%d') || ',y=' || strftime(seen_at, '%Y-%m-%d')
  ELSE grp || '=' || strftime(seen_at - INTERVAL 3 DAY, '%Y-%m-%d') || ',z=' || strftime(seen_at, '%Y-%m-%d') END AS notified,
 CASE WHEN mine AND theirs THEN 'b,a,c' WHEN mine THEN 'a,b,c' ELSE 'b' END AS also_on,
 CASE WHEN mine AND n % 5 = 0 THEN 'm' WHEN theirs THEN 't' END AS verdict FROM b""")
def g3(t: Tables) -> DataFrame:
    """Two versions that overlap in a third of the keys."""
    b = t.v.select(F.col("posting").alias("key"), "n", "grp", F.col("seen_at").cast("timestamp").alias("seen_at"))
    mine = b.filter("n % 3 <> 2").select(
        "key", F.col("seen_at").alias("first_seen"), days("seen_at", 1).alias("last_seen"),
        F.map_from_arrays(F.array("grp", F.lit("y")), F.array("seen_at", "seen_at")).alias("notified"),
        F.when(F.col("n") % 3 == 1, F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("also_on"),
        F.when(F.col("n") % 5 == 0, F.lit("m")).alias("verdict"))
    theirs = b.filter("n % 3 <> 0").select(
        "key", days("seen_at", -2).alias("first_seen"), F.col("seen_at").alias("last_seen"),
        F.map_from_arrays(F.array("grp", F.lit("z")), F.array(days("seen_at", -3), F.col("seen_at"))).alias("notified"),
        F.array(F.lit("b")).alias("also_on"), F.lit("t").alias("verdict"))
    m = S.merge_state(mine, theirs)
    return m.select("key", "first_seen", "last_seen", _show_map("notified").alias("notified"),
                    F.array_join("also_on", ",").alias("also_on"), "verdict")


@query("g3_merge_groups", """
SELECT event_type AS grp, max(ts) AS last_run, max(ts) FILTER (WHERE user_id % 2 = 0) AS last_slot FROM events GROUP BY 1""")
def g3_groups(t: Tables) -> DataFrame:
    def version(which: int) -> DataFrame:
        return t.ev.filter(F.col("event_id") % 2 == which).groupBy(F.col("event_type").alias("grp")).agg(
            F.max("ts").alias("last_run"), F.max(F.when(F.col("user_id") % 2 == 0, F.col("ts"))).alias("last_slot"))
    return S.merge_groups(version(0), version(1))


@query("g3_merge_touched", """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 AND (s_suppkey % 4 = 0 OR s_suppkey % 5 = 0) THEN 'mine' ELSE 'theirs' END AS owner FROM supplier
WHERE s_suppkey % 3 <> 0 OR s_suppkey % 5 <> 0""")
def g3_touched(t: Tables) -> DataFrame:
    mine = t.supplier.filter("s_suppkey % 3 <> 0").select("s_suppkey", F.lit("mine").alias("owner"), (F.col("s_suppkey") % 4 == 0).alias("touched"))
    theirs = t.supplier.filter("s_suppkey % 5 <> 0").select("s_suppkey", F.lit("theirs").alias("owner"), F.lit(False).alias("touched"))
    return S.merge_touched(mine, theirs, "s_suppkey")


@query("g5_retention", f"WITH {V} SELECT posting FROM v WHERE posted_at IS NULL OR posted_at >= {NOW_SQL} - INTERVAL 90 DAY")
def g5(t: Tables) -> DataFrame:
    v = t.v.withColumn("posted_at", F.col("posted_at").cast("timestamp"))
    return S.expire(v, "posted_at", NOW).select("posting")


@query("h12_material_change", f"""
WITH {V} SELECT posting, CASE WHEN n % 7 = 0 THEN 'new' WHEN n % 11 = 0 THEN 'gone' ELSE 'changed' END AS change FROM v
WHERE (n % 7 = 0) <> (n % 11 = 0) OR (n % 7 <> 0 AND n % 11 <> 0 AND n % 13 = 0)""")
def h12(t: Tables) -> DataFrame:
    before = t.v.filter("n % 7 <> 0").select("posting", "title", "score")
    after = t.v.filter("n % 11 <> 0").select("posting", "title", F.when(F.col("n") % 13 == 0, F.col("score") + 1).otherwise(F.col("score")).alias("score"))
    return S.material_change(before, after, "posting", ["title", "score"])


@query("f1_rank_results", f"""
WITH {V} SELECT posting, row_number() OVER (ORDER BY CASE WHEN n % 9 = 0 THEN 0 ELSE score END DESC, coalesce(posted_at, seen_at) DESC, posting) AS rank FROM v""")
def f1(t: Tables) -> DataFrame:
    """The rank of every posting."""
    v = t.v.select("posting", F.when(F.col("n") % 9 != 0, F.col("score")).alias("score"), F.col("posted_at").cast("timestamp").alias("posted_at"),
                   F.col("seen_at").cast("timestamp").alias("first_seen"))
    keyed = v.select("posting", F.coalesce("score", F.lit(0)).alias("score"), G.newest(NOW).alias("newest"))
    return G.number_all(keyed, F.desc("score"), F.desc("newest"), F.asc("posting")).select("posting", F.col("rank").cast("bigint").alias("rank"))


@query("f9_recent_notified", f"""
WITH {V} SELECT posting AS key, CASE WHEN n % 4 = 1 THEN seen_at + INTERVAL 1 DAY ELSE seen_at END AS notified_at FROM v
WHERE n % 3 <> 0 AND n % 4 IN (0, 1) AND CASE WHEN n % 4 = 1 THEN seen_at + INTERVAL 1 DAY ELSE seen_at END >= TIMESTAMP '2001-07-03'""")
def f9(t: Tables) -> DataFrame:
    from datetime import datetime

    return S.recent_notified(seen(t), datetime(2001, 7, 3)).select("key", "notified_at")


# --- the flagship: decisions of a run, then what is new by group, company and family ----------------------------
def decide_run(t: Tables) -> DataFrame:
    """Waterfall, previous publications, merge across sources: every posting with its final decision."""
    w = W.decide(waterfall_input(t), NOW, WATERFALL_AGE, 35)
    w = w.select("posting", "source_key", "native_id", "grp", "company", "family", "score", "decision", "target", "n",
                 text.fingerprint(F.col("company"), F.col("title"), F.col("posting")).alias("fp"), urls.canonical_url(F.col("url")).alias("curl"))
    w = written(w, "decided")
    survivors = w.filter("decision IS NULL").select(
        "posting", "score", "source_key", "native_id", F.concat_ws("|", "grp", "fp", "target").alias("tok_fp"),
        F.when(F.col("curl") != "", F.concat_ws("|", "grp", "curl")).alias("tok_url"),
        (F.col("n") % 37 == 0).alias("prev_here"), (F.col("n") % 41 == 0).alias("prev_elsewhere"))
    merged = DD.decide_duplicates(survivors, "posting", ["tok_fp", "tok_url"], DD.rank_order("score", "source_key", "native_id"))
    dup = merged.select("posting", F.col("decision").alias("_dup"))
    return w.join(dup, "posting", "left").withColumn("decision", F.coalesce("decision", "_dup")).drop("_dup")


RUN = f"""RECURSIVE {WATERFALL_SQL}, rows AS (SELECT posting AS key, grp, grp || '|' || {duck.fingerprint('company', 'title', 'posting')} || '|' || target AS tok1,
 'u' || grp || '|' || {duck.canonical_url('url')} AS tok2, n % 37 = 0 AS prev_here, n % 37 <> 0 AND n % 41 = 0 AS prev_else,
 row_number() OVER (ORDER BY coalesce(sc, 0) DESC, source_key, native_id) AS rk FROM d WHERE decision IS NULL), {walk_sql('rows')},
final AS (SELECT d.posting, d.grp, d.company, d.fam, d.source_key, coalesce(d.decision, x.decision) AS decision FROM d LEFT JOIN decided x ON x.key = d.posting)"""


@query("entry_new_and_refused", f"""
WITH {RUN} SELECT 'group' AS dimension, grp AS label, count(*)::BIGINT AS n FROM final WHERE decision IS NULL GROUP BY 2
UNION ALL SELECT 'company', company, count(*) FROM final WHERE decision IS NULL GROUP BY 2
UNION ALL SELECT 'family', coalesce(fam, 'other'), count(*) FROM final WHERE decision IS NULL GROUP BY 2
UNION ALL SELECT 'refused', decision, count(*) FROM final WHERE decision IS NOT NULL GROUP BY 2""")
def entry_query(t: Tables) -> DataFrame:
    """One pass over the decided run: each row contributes its labels, and one aggregate counts them."""
    d = decide_run(t)

    def pair(dimension: str, label) -> object:
        return F.struct(F.lit(dimension).alias("dimension"), label.alias("label"))

    new = F.array(pair("group", F.col("grp")), pair("company", F.col("company")), pair("family", F.coalesce("family", F.lit("other"))))
    refused = F.array(pair("refused", F.col("decision")))
    labels = F.when(F.col("decision").isNull(), new).otherwise(refused)
    return d.select(F.inline(labels)).groupBy("dimension", "label").agg(F.count("*").alias("n"))


@query("e1_funnel", f"""
WITH {RUN} SELECT grp, count(*)::BIGINT AS fetched,
 count(*) FILTER (WHERE decision IS NULL OR decision NOT IN ('already_notified', 'baseline', 'too_old', 'location', 'excluded'))::BIGINT AS candidates,
 count(*) FILTER (WHERE decision IS NULL)::BIGINT AS matches, count(*) FILTER (WHERE source_key <> 's5')::BIGINT AS ai_scored,
 count(*) FILTER (WHERE decision = 'duplicate_other_group')::BIGINT AS also_elsewhere FROM final GROUP BY 1""")
def e1(t: Tables) -> DataFrame:
    return ST.funnel(decide_run(t).withColumn("ai_scored", F.col("source_key") != "s5"), "grp")


@query("e1_rejections", f"WITH {RUN} SELECT grp, decision AS reason, count(*)::BIGINT AS n FROM final WHERE decision IS NOT NULL GROUP BY 1, 2")
def e1_reasons(t: Tables) -> DataFrame:
    return ST.rejections(decide_run(t), "grp")


