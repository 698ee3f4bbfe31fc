"""Status history of postings.

The log ``STATUS_EVENT(id, seq, day, status)`` is the truth; the row of a posting is folded from it.  Nothing here
gathers a posting's whole history into one task: repeats are found by a lag over segments, current values by
map-side combined ``max_by``.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..session import small_table
from ..functions.status import parse_status, same_status, split_history, valid_day
from .segments import with_previous, with_row_number, with_total_before


def status_changes(log: DataFrame, order: list[str], segment: Column) -> DataFrame:
    """Entries that change the status of their posting; a repeated status adds nothing."""
    out = with_previous(log, ["id"], order, F.col("status"), segment, "_before")
    return out.filter(F.col("_before").isNull() | ~same_status(F.col("status"), F.col("_before"))).drop("_before")


def fold_status(log: DataFrame, order: list[str], segment: Column) -> DataFrame:
    """(id, status, date, changes, first_day): the current row of every posting."""
    changed = status_changes(log, order, segment)
    last = F.struct(*order)
    return changed.groupBy("id").agg(F.max_by("status", last).alias("status"), F.max_by("day", last).alias("date"),
                                     F.count("*").alias("changes"), F.min("day").alias("first_day"))


def fill_info(log: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
    """Empty information is filled once: the first non-empty value of each field per posting."""
    first = F.struct(*order)
    return log.groupBy("id").agg(*[F.min_by(f, F.when(F.col(f) != "", first)).alias(f) for f in fields])


def last_change(history: Column, row_date: Column) -> Column:
    """The later of the last history entry's date and the row's date, invalid ones ignored."""
    entry = F.try_element_at(split_history(history), F.lit(-1))["day"]
    return F.greatest(entry, valid_day(row_date))


def change_log(rows: DataFrame) -> DataFrame:
    """Every dated history entry of every row: (id, seq, day, status)."""
    return rows.select("id", F.posexplode(split_history(F.col("history"))).alias("seq", "_e")).select(
        "id", "seq", F.col("_e.day").alias("day"), F.col("_e.status").alias("status")).filter("day IS NOT NULL")


def status_counts(rows: DataFrame) -> DataFrame:
    """Rows per canonical status; a non-empty unknown word counts as 'other'."""
    known = rows.filter(F.trim("status") != "").select(F.coalesce(parse_status(F.col("status")), F.lit("other")).alias("status"))
    return known.groupBy("status").agg(F.count("*").alias("n"))


def pending(rows: DataFrame, changed: Column, today: date, follow_up_days: int) -> DataFrame:
    """Starred and not applied yet (to_apply); applied and quiet for ``follow_up_days`` or more (follow_up)."""
    code = parse_status(F.col("status"))
    limit = F.lit(today - timedelta(days=follow_up_days))
    kind = F.when(code == "interested", F.lit("to_apply")).when((code == "applied") & (changed <= limit), F.lit("follow_up"))
    return rows.withColumn("pending", kind).withColumn("since", changed).filter("pending IS NOT NULL")


def weekly_moves(changes: DataFrame, first: date, last: date) -> DataFrame:
    """Changes per status in the local days first..last."""
    name = F.coalesce(parse_status(F.col("status")), F.col("status"))
    return changes.filter(F.col("day").between(F.lit(first), F.lit(last))).groupBy(name.alias("status")).agg(F.count("*").alias("n"))


def _skipped(wanted: DataFrame, taken: DataFrame, chunk: int) -> DataFrame:
    """(_base, _r, _skipped): how many numbers in use lie below the ``_r``-th free number of a base.

    The j-th number in use, k, has k - j free ones before it; it lies below the r-th free number if these are fewer than r.  So numbers in use and wanted ranks go
    in one order, by free numbers before them, and a running count along it says how many are skipped.
    """
    used = with_row_number(taken, ["_base"], ["_k"], F.floor(F.col("_k") / chunk), "_j")
    marks = used.select("_base", (F.col("_k") - F.col("_j") + 1).cast("bigint").alias("_r"), F.lit(0).alias("_rank"))
    marks = marks.unionByName(wanted.select("_base", F.col("_r").cast("bigint").alias("_r"), F.lit(1).alias("_rank")))
    counted = with_total_before(marks, ["_base"], ["_r", "_rank"], F.col("_rank") == 0, F.floor(F.col("_r") / chunk), "_skipped")
    return counted.filter("_rank = 1").select("_base", "_r", "_skipped")


def detect_manual(rows: DataFrame, today: date, position: str = "pos", chunk: int = 100_000) -> DataFrame:
    """Rows changed or added by hand.

    A row without id gets one from its content; equal contents are numbered in file order, skipping ids already used.
    A status that differs from the last history entry is appended with the row's date if that is valid and later than
    the last entry, else today.  Adds ``manual`` (what happened) and the new ``id``, ``date`` and ``history``.
    """
    info = [F.coalesce(F.col(c), F.lit("")) for c in ("company", "title", "url")]
    blank = (F.coalesce("id", F.lit("")) == "")
    usable = blank & (F.concat(*info) != "")
    base = F.concat(F.lit("m-"), F.substring(F.sha1(F.concat_ws("|", *info)), 1, 8))
    keyed = rows.withColumn("_base", F.when(usable, base))
    taken = rows.filter(F.col("id").rlike(r"^m-[0-9a-f]{8}(-\d+)?$")).select(
        F.regexp_extract("id", r"^(m-[0-9a-f]{8})", 1).alias("_base"),
        F.coalesce(F.regexp_extract("id", r"-(\d+)$", 1).try_cast("int"), F.lit(1)).alias("_k"))
    fresh = with_row_number(keyed.filter("_base IS NOT NULL"), ["_base"], [position], F.floor(F.col(position) / chunk), "_r")
    fresh = fresh.join(_skipped(fresh.select("_base", "_r"), taken.filter("_k > 0").distinct(), chunk), ["_base", "_r"])
    free = F.col("_r") + F.col("_skipped")
    made = F.when(free == 1, F.col("_base")).otherwise(F.concat(F.col("_base"), F.lit("-"), free.cast("string")))
    fresh = fresh.withColumn("id", made).drop("_r", "_skipped")
    out = fresh.unionByName(keyed.filter("_base IS NULL"))
    entries = split_history(F.col("history"))
    last = F.try_element_at(entries, F.lit(-1))
    status = F.trim(F.coalesce("status", F.lit("")))
    typed = valid_day(F.trim(F.coalesce("date", F.lit(""))))
    skip = blank & ~F.coalesce(F.col("_base").isNotNull(), F.lit(False))
    changed = (status != "") & ~same_status(status, F.coalesce(last["status"], F.lit(""))) & ~skip
    when = F.when(typed.isNull() | F.coalesce(typed <= last["day"], F.lit(False)), F.lit(today)).otherwise(typed)
    text = F.concat(F.date_format(when, "yyyy-MM-dd"), F.lit(" "), status, F.lit(" " + V.MANUAL_MARK))
    history = F.concat_ws("; ", F.when(F.trim(F.coalesce("history", F.lit(""))) != "", F.array_join(F.filter(
        F.transform(F.split("history", ";"), lambda e: F.trim(e)), lambda e: e != ""), "; ")), text)
    return (out.withColumn("manual", changed)
            .withColumn("_new_date", F.when(changed & typed.isNull(), F.date_format(when, "yyyy-MM-dd")).otherwise(F.col("date")))
            .withColumn("history", F.when(changed, history).otherwise(F.col("history")))
            .withColumn("date", F.col("_new_date")).drop("_new_date", "_base"))


def resolve_reactions(refs: DataFrame, marks: DataFrame, known: DataFrame, current: DataFrame) -> DataFrame:
    """(id, chat, msg, target): status changes asked for by reactions.

    ``marks``: reactions found now ('a', 'd', 'ad' or ''); ``known``: those already handled; unchanged ones are
    ignored.  With both marks the one that is not the current status wins; other statuses are never overridden.
    """
    j = (refs.join(marks, ["chat", "msg"]).join(known.withColumnRenamed("seen", "_known"), ["chat", "msg"], "left")
         .join(current.select("id", "status"), "id", "left"))
    code = parse_status(F.col("status"))
    may = code.isNull() | code.isin([s for s in V.REACTION_MAY_CHANGE if s])
    target = (F.when(F.col("seen") == "ad", F.when(code == "applied", F.lit("discarded")).otherwise(F.lit("applied")))
              .when(F.col("seen") == "a", F.lit("applied")).when(F.col("seen") == "d", F.lit("discarded")))
    news = (F.col("seen") != F.coalesce("_known", F.lit(""))) & (F.col("seen") != "")
    out = j.filter(news & may).withColumn("target", target)
    return out.filter(code.isNull() | (F.col("target") != code)).select("id", "chat", "msg", "target")


def resolve_keys(asked: DataFrame, messages: DataFrame, seen: DataFrame) -> DataFrame:
    """Job id to posting key: the message table, else the reverse index of SEEN."""
    from ..functions.text import job_id

    by_message = messages.select("id", F.col("key").alias("_m"))
    by_seen = seen.select(job_id(F.col("key")).alias("id"), F.col("key").alias("_s"))
    return asked.join(by_message, "id", "left").join(by_seen, "id", "left").withColumn("key", F.coalesce("_m", "_s")).drop("_m", "_s")


def info_from_message(text: Column, link: Column) -> Column:
    """Company and title read from the first line of a message ('Company — Title'), for keys no longer in SEEN."""
    first = F.substring_index(text, "\n", 1)
    cut = F.instr(first, " — ")
    return F.struct(F.trim(F.when(cut > 0, F.substring(first, F.lit(1), cut - 1)).otherwise(first)).alias("company"),
                    F.trim(F.when(cut > 0, F.substring(first, cut + 3, F.length(first))).otherwise(F.lit(""))).alias("title"),
                    F.coalesce(link, F.lit("")).alias("url"))


def feedback(current: DataFrame, messages: DataFrame, seen: DataFrame) -> DataFrame:
    """Marks of postings the tool sent: status joined to its message reference and to what is known of the posting."""
    return (current.filter(parse_status(F.col("status")).isNotNull()).withColumn("status", parse_status(F.col("status")))
            .join(messages.select("id", "key"), "id").join(seen.select("key", "src", "family"), "key"))


def merge_logs(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Two versions of the status log: their union, each operation once.  Folding the result again gives the merged
    tracker, whatever the order of the merges: both edits survive and applying an operation twice changes nothing."""
    return theirs.unionByName(mine).distinct()


def merge_references(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Message references united by (id, chat, msg): theirs where both have one."""
    both = theirs.withColumn("_p", F.lit(0)).unionByName(mine.withColumn("_p", F.lit(1)))
    rest = [c for c in theirs.columns if c not in ("id", "chat", "msg")]
    won = both.groupBy("id", "chat", "msg").agg(F.min_by(F.struct(*rest), "_p").alias("_r"))
    return won.select("id", "chat", "msg", *[F.col("_r")[c].alias(c) for c in rest])


def tracker_totals(rows: DataFrame, changed: Column, today: date, follow_up_days: int) -> DataFrame:
    """(section, label, n): rows per status with zeros for the others, the number of rows, and what is pending."""
    statuses = [*V.STATUSES, "other"]
    code = F.coalesce(parse_status(F.col("status")), F.lit("other"))
    limit = F.lit(today - timedelta(days=follow_up_days))
    known = F.trim("status") != ""
    one = F.struct(F.lit("total").alias("section"), F.lit("rows").alias("label"))
    count = F.when(known, F.struct(F.lit("counts").alias("section"), code.alias("label")))
    waiting = F.when(code == "interested", F.struct(F.lit("pending").alias("section"), F.lit("to_apply").alias("label"))).when(
        (code == "applied") & (changed <= limit), F.struct(F.lit("pending").alias("section"), F.lit("follow_up").alias("label")))
    found = rows.select(F.inline(F.array_compact(F.array(one, count, waiting)))).groupBy("section", "label").agg(F.count("*").alias("n"))
    every = [("total", "rows"), *[("counts", x) for x in statuses], ("pending", "to_apply"), ("pending", "follow_up")]
    return small_table(rows.sparkSession, "section string, label string", every).join(found, ["section", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def last_changes(rows: DataFrame, position: str, n: int = 10) -> DataFrame:
    """The ``n`` latest dated changes, newest first: of one day the row further down, and in a row the later entry, comes first."""
    each = rows.select("id", position, F.posexplode(split_history(F.col("history"))).alias("seq", "_e"))
    each = each.select("id", position, "seq", F.col("_e.day").alias("day"), F.coalesce(parse_status(F.col("_e.status")), F.col("_e.status")).alias("status")).filter("day IS NOT NULL")
    return latest(each, n, F.desc("day"), F.desc(position), F.desc("seq"))


def latest(changes: DataFrame, n: int, *order: Column) -> DataFrame:
    return changes.orderBy(*order).limit(n)
