"""Keyed folds in order of event time, as stateful streams whose state expires.

Rows wait in list state until the watermark has passed them and are then folded by (ts, seq), so files in any order give what a batch over
all rows gives, as long as rows come within the watermark's delay.  State lives in RocksDB under the query's checkpoint: a restart goes on where the last
committed batch ended, and only keys that a batch touches are read and written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import fixed_values as V
from ..functions.status import parse_status
from ..functions.text import normalize_text

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_US = 86_400_000_000

Step = Callable[[tuple | None, tuple], tuple[tuple, list[tuple]]]


class OrderedFold(StatefulProcessor):
    """``step(state, row)`` gives the next state and output rows; ``row`` is (us, seq, columns...), ``state`` None at first.

    A key's rows inside the watermark's delay are held at once when their time has come; the delay and the source's rate limit bound them.
    ``ttl_us`` after its last row a key is forgotten: to ``step`` a later row is the first one again, and a timer frees the state.
    """

    def __init__(self, step: Step, columns: list[str], row_schema: str, state_schema: str, output: list[str], ttl_us: int | None):
        self.step, self.columns, self.row_schema = step, columns, row_schema
        self.state_schema, self.output, self.ttl_us = state_schema, output, ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"last_us long, {self.state_schema}")
        self.waiting = handle.getListState("waiting", self.row_schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            batch = list(zip(*(frame[c].tolist() for c in self.columns), strict=True))
            if batch:
                self.waiting.appendList(batch)
                earliest = min(r[0] for r in batch)
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get())
        ready = sorted((r for r in rows if r[0] <= passed), key=lambda r: (r[0], r[1]))
        held = tuple(self.state.get()) if self.state.exists() else None
        last, state = (held[0], held[1:]) if held else (None, None)
        out: list[tuple] = []
        for row in ready:
            if last is not None and self.ttl_us is not None and row[0] - last > self.ttl_us:
                state = None
            state, more = self.step(state, tuple(row))
            last = row[0]
            out += more
        if ready:
            rest = [r for r in rows if r[0] > passed]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(-(-min(r[0] for r in rest) // 1000))
            else:
                self.waiting.clear()
            self.state.update((last, *state))
        if last is not None and self.ttl_us is not None:
            if last + self.ttl_us < passed:
                self.state.clear()
            elif ready:
                self.handle.registerTimer(-(-(last + self.ttl_us) // 1000) + 1)
        if out:
            frame = pd.DataFrame(out, columns=self.output)
            for i, value in enumerate(key):
                frame.insert(i, f"key_{i}", value)
            yield frame

    def close(self) -> None:
        pass


def fold_in_order(events: DataFrame, keys: list[str], columns: dict[str, str], step: Step, state: str, output: dict[str, str],
                  delay: str, ttl_us: int | None = None) -> DataFrame:
    """Rows that ``step`` puts out: the keys and ``output`` (name to type; ``*_us`` micros become timestamps).

    ``events`` has the keys, ``ts``, ``seq`` (unique within a key's instant, orders equal times) and ``columns`` (name to type).  Rows later than ``delay`` behind the newest one are dropped.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    kinds = dict(events.dtypes)
    source = events.withWatermark("ts", delay).select(*keys, "ts", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), *columns)
    fields = ["us", "seq", *columns]
    row_schema = ", ".join(["us long", "seq long", *[f"{c} {kind}" for c, kind in columns.items()]])
    schema = ", ".join([*[f"key_{i} {kinds[k]}" for i, k in enumerate(keys)], *[f"{c} {kind}" for c, kind in output.items()]])
    fold = OrderedFold(step, fields, row_schema, state, list(output), ttl_us)
    out = source.groupBy(*keys).transformWithStateInPandas(fold, schema, "append", "eventTime")
    shown = [F.timestamp_micros(c).alias(c[:-3]) if c.endswith("_us") else F.col(c) for c in output]
    return out.select(*[F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)], *shown)


# --- steps: plain functions of the state and one row -----------------------------------------------------------------
def observe_step(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
    """State (first, last sighting that counts); last_seen moves with the first sighting of a day."""
    us, seq = row[:2]
    if state is None:
        return (us, us), [(seq, us, True, us, us)]
    first, last = state
    last = us if us // DAY_US != last // DAY_US else last
    return (first, last), [(seq, us, False, first, last)]


def publish_step(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
    """State (published,): only a delivered attempt marks it, others are tried again."""
    us, seq, delivered = row
    if (state is None or not state[0]) and delivered:
        return (True,), [(seq, us)]
    return state or (False,), []


def first_run_step(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
    """State (the first run,): rows of that run are the ones a source was added with."""
    us, seq, run = row
    first = run if state is None else state[0]
    return (first,), [(seq, us, run == first)]


def status_step(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
    """State (comparable word, changes): a repeated status adds nothing."""
    us, seq, day, status, word = row
    if state is not None and state[0] == word:
        return state, []
    changes = 1 + (state[1] if state else 0)
    return (word, changes), [(seq, us, day, status, changes)]


def throttle_step(wait_us: int) -> Step:
    def step(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        us = row[0]
        if state is None or us - state[0] >= wait_us:
            return (us,), [(us,)]
        return state, []
    return step


def health_step(most: int) -> Step:
    """State (streak,): rows that are worth storing, a recovery or one of the first ``most`` failures."""
    def step(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        us, seq, ok = row
        before = state[0] if state else 0
        streak = 0 if ok else before + 1
        material = before > 0 if ok else before < most
        return (streak,), [(seq, us, "recovered" if ok else "failing", min(streak, most))] if material else []
    return step


# --- streams ---------------------------------------------------------------------------------------------------------
def observe_stream(events: DataFrame, key: str = "key", days: int = V.SEEN_DAYS, delay: str = "1 day") -> DataFrame:
    """(key, seq, ts, is_new, first_seen, last_seen) for every row; a key not seen for ``days`` is new again (batch form: ``state.observe_log``)."""
    return fold_in_order(events, [key], {}, observe_step, "first_us long, seen_us long",
                         {"seq": "long", "ts_us": "long", "is_new": "boolean", "first_seen_us": "long", "last_seen_us": "long"}, delay, days * DAY_US)


def publish_stream(attempts: DataFrame, keys: list[str], days: int | None = None, delay: str = "1 day") -> DataFrame:
    """(keys, seq, published_at): the first attempt (ts, seq, delivered) of each pair that arrived (batch form: ``state.publish_once``)."""
    return fold_in_order(attempts, keys, {"delivered": "boolean"}, publish_step, "published boolean", {"seq": "long", "published_at_us": "long"}, delay,
                         None if days is None else days * DAY_US)


def first_run_stream(rows: DataFrame, source: str, run: str, delay: str = "1 day") -> DataFrame:
    """(source, seq, ts, first_run): whether a row belongs to the run (a text) that its source was added with."""
    return fold_in_order(rows.withColumn("run_", F.col(run).cast("string")), [source], {"run_": "string"}, first_run_step, "run string",
                         {"seq": "long", "ts_us": "long", "first_run": "boolean"}, delay)


def status_stream(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """(id, seq, ts, day, status, changes): the entries that change a posting's status (batch form: ``tracker.status_changes``)."""
    words = log.withColumn("word", F.coalesce(F.concat(F.lit("="), parse_status(F.col("status"))), normalize_text(F.col("status")), F.lit("")))
    return fold_in_order(words, ["id"], {"day": "date", "status": "string", "word": "string"}, status_step, "word string, changes long",
                         {"seq": "long", "ts_us": "long", "day": "date", "status": "string", "changes": "long"}, delay)


def throttle_stream(events: DataFrame, interval_minutes: int, delay: str = "0 seconds") -> DataFrame:
    """Events (key, ts) at least ``interval - 2`` minutes after the last emitted one of their key; a key's state is freed as soon as it decides nothing any more."""
    wait = (interval_minutes - V.INTERVAL_TOLERANCE_MINUTES) * 60_000_000
    numbered = events if "seq" in events.columns else events.withColumn("seq", F.lit(0).cast("long"))
    return fold_in_order(numbered, ["key"], {}, throttle_step(wait), "emitted_us long", {"ts_us": "long"}, delay, max(wait, 1))


def health_stream(log: DataFrame, most: int, delay: str = "1 day") -> DataFrame:
    """(source_key, seq, ts, change, streak): changes of health worth storing (batch form: ``health.health_changes``)."""
    return fold_in_order(log, ["source_key"], {"ok": "boolean"}, health_step(most), "streak long",
                         {"seq": "long", "ts_us": "long", "change": "string", "streak": "long"}, delay)
