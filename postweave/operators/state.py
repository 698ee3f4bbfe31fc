"""Remembered state: observe, join, merge, expire."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.dates import at
from .segments import with_latest, with_previous

DAY_US = 86_400_000_000
ATTRIBUTES = ["title", "company", "url", "loc", "posted_at", "fp", "src"]


def observe(postings: DataFrame, seen: DataFrame, now: datetime) -> DataFrame:
    """Postings with what is remembered of them: ``first_seen``, ``is_new``, ``baseline``, ``notified``."""
    known = seen.select("key", F.col("first_seen").alias("_fs"), "baseline", "notified")
    out = postings.join(known, "key", "left")
    return (out.withColumn("is_new", F.col("_fs").isNull()).withColumn("first_seen", F.coalesce("_fs", at(now)))
            .withColumn("baseline", F.coalesce("baseline", F.lit(False))).drop("_fs"))


def observe_log(log: DataFrame, key: str, days: int | None = V.SEEN_DAYS, order: tuple[str, str] = ("ts", "seq")) -> DataFrame:
    """Every sighting (key, ts, seq) with ``is_new``, ``first_seen`` and ``last_seen``: the batch form of ``streaming.ordered.observe_stream``.

    A key that was not sighted for more than ``days`` is forgotten, its next sighting is new again; last_seen moves with the first sighting of a
    day.  Windows run per key and day, so a key with a third of all rows is spread over its days.
    """
    ts, day = F.unix_micros(order[0]), F.floor(F.unix_micros(order[0]) / DAY_US)
    out = with_previous(log, [key], list(order), ts, day, "_before")
    forgotten = F.lit(False) if days is None else ts - F.col("_before") > days * DAY_US
    out = out.withColumn("is_new", F.col("_before").isNull() | forgotten)
    moved = F.col("is_new") | (F.floor(F.col("_before") / DAY_US) != day)
    out = with_latest(out, [key], list(order), F.when(F.col("is_new"), F.col(order[0])), day, "first_seen")
    return with_latest(out, [key], list(order), F.when(moved, F.col(order[0])), day, "last_seen").drop("_before")


def remembered(log: DataFrame, key: str, attributes: Column, days: int | None = V.SEEN_DAYS, now: datetime | None = None,
               order: tuple[str, str] = ("ts", "seq")) -> DataFrame:
    """(key, first_seen, last_seen, latest) after all sightings; with ``now`` only of keys that are not forgotten yet."""
    last = F.struct(*order)
    out = observe_log(log, key, days, order).groupBy(key).agg(
        F.max_by(F.struct("first_seen", "last_seen"), last).alias("_v"), F.max_by(attributes, last).alias("latest"), F.max(order[0]).alias("_ts"))
    if now is not None and days is not None:
        out = expire(out, "_ts", now, days)
    return out.select(key, F.col("_v.first_seen").alias("first_seen"), F.col("_v.last_seen").alias("last_seen"), "latest")


def publish_once(attempts: DataFrame, keys: list[str], order: tuple[str, str] = ("ts", "seq")) -> DataFrame:
    """(keys, seq, published_at): the first delivered attempt of each pair; attempts that failed mark nothing."""
    first = attempts.filter("delivered").groupBy(*keys).agg(F.min(F.struct(*order)).alias("_f"))
    return first.select(*keys, F.col("_f")[order[1]].alias("seq"), F.col("_f")[order[0]].alias("published_at"))


def first_run(rows: DataFrame, source: str, run: Column, order: tuple[str, str] = ("ts", "seq")) -> DataFrame:
    """Adds ``first_run``: whether a row belongs to the run its source was added with, the run of its earliest row."""
    rows = rows.withColumn("_run", run)
    first = rows.groupBy(source).agg(F.min_by("_run", F.struct(*order)).alias("_first"))
    return rows.join(first, source).withColumn("first_run", F.col("_run") == F.col("_first")).drop("_run", "_first")


def with_baseline(rows: DataFrame, source: str, key: str, undated: Column, run: Column, order: tuple[str, str] = ("ts", "seq")) -> DataFrame:
    """Adds ``baseline``: undated rows of a source's first run, and later undated rows of the same keys.

    A key marked in a first run stays marked, so it is never new, unless it comes back with a date."""
    rows = first_run(rows, source, run, order).withColumn("_undated", F.coalesce(undated, F.lit(False)))
    marked = rows.filter("first_run AND _undated").groupBy(key).agg(F.min(F.struct(*order)).alias("_marked"))
    out = rows.join(marked, key, "left")
    return out.withColumn("baseline", F.coalesce(F.col("_undated") & (F.struct(*order) >= F.col("_marked")), F.lit(False))).drop("_undated", "_marked")


def first_look(postings: DataFrame, seen: DataFrame, added: DataFrame, now: datetime, group: str, max_age_days: float, bootstrap: bool = False) -> DataFrame:
    """What a run decides before any filter: observed postings with ``baseline`` and ``decision`` (null: a candidate).

    ``postings``: key, source_key, posted_at, kind; ``added``: the sources (source_key) that took part in an earlier run.  A bootstrap run marks all it observes as
    baseline and passes nothing on.  Otherwise a posting published in ``group`` is 'already_notified'; an undated one of a new source becomes baseline;
    undated baseline is 'baseline'; what is older than ``max_age_days`` is 'too_old'.
    """
    known = added.select("source_key").distinct().withColumn("_added", F.lit(True))
    rows = observe(postings, seen, now).join(known, "source_key", "left")
    published = F.coalesce(F.map_contains_key("notified", F.lit(group)), F.lit(False))
    undated = F.col("posted_at").isNull() & (F.col("kind") == "job")
    marked = F.lit(True) if bootstrap else ~published & undated & F.col("_added").isNull()
    rows = rows.withColumn("baseline", F.col("baseline") | marked).drop("_added")
    age = F.unix_micros(at(now)) - F.unix_micros(F.coalesce("posted_at", "first_seen"))
    decision = F.when(published, F.lit("already_notified")).when(undated & F.col("baseline"), F.lit("baseline")).when(
        age > int(max_age_days * DAY_US), F.lit("too_old"))
    return rows.withColumn("decision", F.lit("bootstrap") if bootstrap else decision)


def next_seen(postings: DataFrame, seen: DataFrame, now: datetime) -> DataFrame:
    """The state after a run: first_seen stays, last_seen moves at most once a day, attributes are the latest."""
    mine = postings.select("key", *[F.col(c).alias(f"_{c}") for c in ATTRIBUTES], F.col("tgt").alias("_tgt"),
                           F.lit(True).alias("_here"))
    both = seen.join(mine, "key", "full_outer")
    now = at(now)
    here = F.coalesce("_here", F.lit(False))
    same_day = F.coalesce(F.to_date("last_seen") == F.to_date(now), F.lit(False))
    fixed = {
        "first_seen": F.coalesce("first_seen", now),
        "last_seen": F.when(here & ~same_day, now).otherwise(F.col("last_seen")),
        "tgt": F.coalesce("_tgt", "tgt"),
    }
    for c in ATTRIBUTES:
        fixed[c] = F.when(here, F.col(f"_{c}")).otherwise(F.col(c))
    return both.select(*[fixed.get(c, F.col(c)).alias(c) for c in seen.columns])


def cached_verdicts(postings: DataFrame, verdicts: DataFrame, criteria: str) -> DataFrame:
    """Verdicts are reused only under the same criteria; the filter is pushed to the verdict scan."""
    same = verdicts.filter(F.col("criteria") == criteria).drop("criteria")
    return postings.join(same, "key", "left")


def _publishers(notified: DataFrame, by: list[str]) -> DataFrame:
    """Per identity and group the two extreme publishing keys: enough to tell whether *another* key published."""
    return notified.groupBy(*by, "grp").agg(F.min("key").alias("_lo"), F.max("key").alias("_hi"))


def published_elsewhere(postings: DataFrame, published: DataFrame) -> DataFrame:
    """Adds ``prev_groups``: groups in which the same offer was published under another key, sorted.

    Same canonical URL (whatever the place), or same fingerprint in a compatible place (equal, or one unknown).
    ``published``: (key, fp, curl, tgt, grp).  The published side is folded per identity and group before the join,
    so a hot token never pairs its rows with each other: a posting meets at most groups x places rows.
    """
    keyed = postings.select("key", "fp", "curl", F.col("tgt").alias("_t"))
    other = (F.col("_lo") != F.col("key")) | (F.col("_hi") != F.col("key"))
    by_url = keyed.filter(F.col("curl") != "").join(_publishers(published.filter(F.col("curl") != ""), ["curl"]), "curl")
    by_url = by_url.filter(other).select("key", "grp")
    by_fp = keyed.join(_publishers(published, ["fp", "tgt"]), "fp")
    fits = F.col("_t").isNull() | F.col("tgt").isNull() | (F.col("_t") == F.col("tgt"))
    by_fp = by_fp.filter(other & fits).select("key", "grp")
    groups = by_url.unionByName(by_fp).groupBy("key").agg(F.array_sort(F.collect_set("grp")).alias("prev_groups"))
    return postings.join(groups, "key", "left").withColumn(
        "prev_groups", F.coalesce("prev_groups", F.array().cast("array<string>")))


def names_for_earlier(postings: DataFrame, published: DataFrame, rank: Column) -> DataFrame:
    """(key, names) of earlier publications: the source names of later copies of the same offer, best copy first.

    ``postings``: (key, fp, curl, tgt, source_name), the copies that were not published because another group had the offer; ``published`` as for
    ``published_elsewhere``.  Copies are folded to one row per identity and name before the join, with their two extreme keys, which tell whether another key than
    the publication's own gave the name; so a hot token meets at most sources x places rows, not all its copies.
    """
    def folded(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by, "source_name").agg(F.min("key").alias("_lo"), F.max("key").alias("_hi"), F.min(rank).alias("_r"))
    known = published.select("key", "fp", "curl", F.col("tgt").alias("_t")).distinct()
    other = (F.col("_lo") != F.col("key")) | (F.col("_hi") != F.col("key"))
    by_url = known.filter(F.col("curl") != "").join(folded(postings.filter(F.col("curl") != ""), ["curl"]), "curl").filter(other)
    fits = F.col("_t").isNull() | F.col("tgt").isNull() | (F.col("_t") == F.col("tgt"))
    by_fp = known.join(folded(postings, ["fp", "tgt"]), "fp").filter(other & fits)
    named = by_url.select("key", "source_name", "_r").unionByName(by_fp.select("key", "source_name", "_r"))
    named = named.groupBy("key", "source_name").agg(F.min("_r").alias("_r"))
    ordered = F.array_sort(F.collect_list(F.struct("_r", "source_name")))
    return named.groupBy("key").agg(F.transform(ordered, lambda x: x["source_name"]).alias("names"))


def merge_destinations(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """(channel, route, ident): of two chats made for one route both sides keep the older one, the smaller number."""
    number = F.col("ident").cast("decimal(38,0)")
    return mine.unionByName(theirs).groupBy("channel", "route").agg(F.min_by("ident", number).alias("ident"))


def merge_state(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Two versions of SEEN: earliest publication per group, earliest first_seen, latest last_seen, other sources
    united (theirs first), my verdict and attributes where I have the key.  Both sides should be bucketed by key."""
    columns = mine.columns
    m = mine.select("key", *[F.col(c).alias(f"m_{c}") for c in columns if c != "key"], F.lit(True).alias("m_"))
    t = theirs.select("key", *[F.col(c).alias(f"t_{c}") for c in columns if c != "key"], F.lit(True).alias("t_"))
    both = m.join(t, "key", "full_outer")
    only_one = F.col("m_").isNull() | F.col("t_").isNull()

    def one(c: str) -> Column:
        return F.when(F.col("m_").isNull(), F.col(f"t_{c}")).otherwise(F.col(f"m_{c}"))

    merged = {
        "notified": F.map_zip_with("m_notified", "t_notified", lambda _, a, b: F.least(a, b)),
        "first_seen": F.least("m_first_seen", "t_first_seen"),
        "last_seen": F.greatest("m_last_seen", "t_last_seen"),
        "also_on": F.when(F.size("t_also_on") > 0, F.array_distinct(F.concat(
            "t_also_on", F.coalesce("m_also_on", F.array().cast("array<string>"))))).otherwise(F.col("m_also_on")),
        "verdict": F.coalesce("m_verdict", "t_verdict") if "verdict" in columns else None,
    }
    out = [F.col("key")]
    for c in columns:
        if c != "key":
            both_sides = merged.get(c)
            out.append((one(c) if both_sides is None else F.when(only_one, one(c)).otherwise(both_sides)).alias(c))
    return both.select(*out)


def merge_groups(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Group bookkeeping: the later last_run and last_slot."""
    return mine.unionByName(theirs).groupBy("grp").agg(F.max("last_run").alias("last_run"), F.max("last_slot").alias("last_slot"))


def merge_touched(mine: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Source and monitor rows: theirs, unless this run touched the row."""
    kept = theirs.join(mine.filter("touched").select(key), key, "left_anti")
    mine_only = mine.join(theirs.select(key), key, "left_anti").unionByName(
        mine.filter("touched").join(theirs.select(key), key, "left_semi"))
    return mine_only.drop("touched").unionByName(kept.drop("touched"))


def expire(df: DataFrame, column: str, now: datetime, days: int = V.SEEN_DAYS) -> DataFrame:
    """Drop rows older than the window; a missing date is kept.  One comparison, pushed to the scan."""
    limit = F.timestamp_micros(F.unix_micros(at(now)) - F.lit(days * 86_400_000_000))
    return df.filter(F.col(column).isNull() | (F.col(column) >= limit))


def recent_notified(seen: DataFrame, since: datetime) -> DataFrame:
    """Entries whose latest publication is not before ``since``; ``notified_at`` orders them."""
    latest = F.array_max(F.map_values("notified"))
    return seen.withColumn("notified_at", latest).filter(F.col("notified_at") >= at(since))


def material_change(before: DataFrame, after: DataFrame, key: str, watched: list[str]) -> DataFrame:
    """Keys whose watched columns differ between two snapshots; empty means the write can be skipped."""
    def digest(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.sha1(F.to_json(F.struct(*watched))).alias(name))

    both = digest(before, "_b").join(digest(after, "_a"), key, "full_outer")
    return both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(
        key, F.when(F.col("_b").isNull(), F.lit("new")).when(F.col("_a").isNull(), F.lit("gone"))
        .otherwise(F.lit("changed")).alias("change"))


def join_details(postings: DataFrame, details: DataFrame, on: list[str], key: str, known: DataFrame | None = None, budget: int | None = None,
                 group: str | None = None, *order: Column) -> DataFrame:
    """Postings without description get the one of their detail row; those with a remembered verdict (``known``) need none and are left out.

    ``budget``: how many details may be fetched per ``group`` in one run, in ``order``; None joins all.
    """
    wanted = postings.filter(F.coalesce(F.col("description"), F.lit("")) == "")
    if known is not None:
        wanted = wanted.join(known.select(key), key, "left_anti")
    if budget is not None:
        w = Window.partitionBy(*([group] if group else [])).orderBy(*order, key)
        wanted = wanted.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= budget).drop("_rn")
    return wanted.drop("description").join(details, on, "left").withColumn("description", F.coalesce("detail", F.lit(""))).drop("detail")
