"""Stateful streams against their batch forms: files in any order, a restart in the middle, state that expires."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postweave.operators import health as H
from postweave.operators import state as S
from postweave.operators import tracker as TR
from postweave.operators.slots import throttle
from postweave.operators.stored import BucketStore, add_names
from postweave.sources import captures as C
from postweave.streaming import ordered as O

START = datetime(2026, 1, 1)
FAR = START + timedelta(days=4000)  # moves the watermark past all rows before
WORDS = ["applied", "aplicado", "offer", "x", "X", ""]


@pytest.fixture(scope="module")
def log(spark):
    """Sightings of a few keys, one of them with a third of all rows, with gaps of up to several days."""
    rnd = random.Random(4)
    rows, at = [], START
    for i in range(360):
        at += timedelta(minutes=rnd.choice([1, 7, 50, 400]), seconds=rnd.randrange(3)) if i % 5 else timedelta(0)  # every fifth at the same time
        key = "hot" if i % 3 == 0 else f"u{rnd.randrange(12)}"
        rows.append((key, i, at, at.date(), rnd.choice(WORDS), rnd.random() < 0.6))
    return spark.createDataFrame(rows, "key string, seq bigint, ts timestamp, day date, status string, ok boolean").persist()


def land(log, folder, part, of=6, seed=1):
    """One file of a random split, so that the files are not in order of time."""
    log.filter(F.pmod(F.xxhash64("seq", F.lit(seed)), F.lit(of)) == part).coalesce(1).write.mode("append").parquet(folder)


def streamed(spark, tmp_path, log, make, key="key"):
    """What the stream puts out: files land shuffled, half of them after a restart, the last row moves the watermark on."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = make(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "chk")).outputMode("append").trigger(
            availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
    for part in range(3):
        land(log, folder, part)
    run()
    for part in range(3, 6):
        land(log, folder, part)
    last = log.limit(1).select([F.lit("~").alias(c) if c == key else F.lit(FAR).alias(c) if c == "ts" else F.col(c) for c in log.columns])
    last.coalesce(1).write.mode("append").parquet(folder)
    run()
    return spark.read.parquet(out).filter(F.col(key) != "~")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_sightings_and_expiry(spark, tmp_path, log):
    got = streamed(spark, tmp_path, log, lambda s: O.observe_stream(s, days=1, delay="400 days"))
    columns = ["key", "seq", "ts", "is_new", "first_seen", "last_seen"]
    want = rows(S.observe_log(log, "key", 1).select(columns))
    assert rows(got.select(columns)) == want
    assert sum(r[3] for r in want) > log.select("key").distinct().count()  # some keys were forgotten and came back


def test_publication_marks_what_was_delivered(spark, tmp_path, log):
    attempts = log.withColumnRenamed("status", "grp").withColumn("delivered", F.col("ok"))
    got = streamed(spark, tmp_path, attempts, lambda s: O.publish_stream(s, ["key", "grp"], delay="400 days"))
    assert rows(got.select("key", "grp", "seq", "published_at")) == rows(S.publish_once(attempts, ["key", "grp"]))


def test_first_run_of_a_source(spark, tmp_path, log):
    got = streamed(spark, tmp_path, log, lambda s: O.first_run_stream(s, "key", "day", delay="400 days"))
    want = S.first_run(log, "key", F.col("day")).select("key", "seq", "ts", "first_run")
    assert rows(got.select("key", "seq", "ts", "first_run")) == rows(want)


def test_status_changes_with_late_rows(spark, tmp_path, log):
    statuses = log.withColumnRenamed("key", "id")
    got = streamed(spark, tmp_path, statuses, lambda s: O.status_stream(s, delay="400 days"), "id")
    want = TR.status_changes(statuses, ["ts", "seq"], F.date_trunc("hour", "ts"))
    assert rows(got.select("id", "seq", "day", "status")) == rows(want.select("id", "seq", "day", "status"))
    assert got.groupBy("id").agg(F.max("changes").alias("n"), F.count("*").alias("m")).filter("n <> m").count() == 0


def test_health_changes(spark, tmp_path, log):
    runs = log.withColumnRenamed("key", "source_key")
    got = streamed(spark, tmp_path, runs, lambda s: O.health_stream(s, 2, delay="400 days"), "source_key")
    want = H.health_changes(runs, ["ts", "seq"], F.date_trunc("hour", "ts"), 2)
    assert rows(got.select("source_key", "ts", "seq", "change", "streak")) == rows(
        want.withColumn("streak", F.least("streak", F.lit(2))).select("source_key", "ts", "seq", "change", "streak"))


def test_throttle(spark, tmp_path, log):
    got = streamed(spark, tmp_path, log, lambda s: O.throttle_stream(s, 60, delay="400 days"))
    want = throttle(log.select("key", "ts").distinct(), "key", "ts", 60)
    assert rows(got.select("key", "ts")) == rows(want)


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    """What comes later than the delay is not folded; what came in time is."""
    folder = str(tmp_path / "in")
    schema = "key string, seq bigint, ts timestamp"
    parts = [[("a", 1, START), ("b", 2, START + timedelta(hours=30))], [("a", 3, START + timedelta(hours=1)), ("c", 4, START + timedelta(hours=50))], [("~", 5, FAR)]]
    names = []
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(schema).parquet(folder)
        query = O.observe_stream(source, days=1, delay="1 day").writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "chk")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        names.append(i)
    got = {r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got - {5} == {1, 2, 4}


# --- stored buckets ----------------------------------------------------------------------------------------------------
def files(spark, store):
    return {b: sorted(spark.read.parquet(f"{store.path}/v{v:012d}/bucket={b}").inputFiles()) for b, v in store.manifest(spark).items()}


def test_an_upsert_leaves_other_buckets_alone(spark, tmp_path):
    store = BucketStore(str(tmp_path / "t"), "key string, also_on array<string>", buckets=8)
    keys = [f"k{i}" for i in range(40)]
    store.upsert(spark.createDataFrame([(k, ["board"]) for k in keys], store.schema), 1, lambda old, new: new)
    before = files(spark, store)
    more = spark.createDataFrame([("k3", ["x", "board", "y"]), ("k3x", ["z"])], "key string, names array<string>")
    touched = store.upsert(more, 2, add_names)
    after = files(spark, store)
    assert len(touched) <= 2 and {b for b in before if before[b] != after[b]} <= set(touched)
    got = {r.key: r.also_on for r in store.read(spark).collect()}
    assert got == {k: ["board"] for k in keys} | {"k3": ["board", "x", "y"]}


def test_a_repeated_version_counts_once_and_old_files_go(spark, tmp_path):
    store = BucketStore(str(tmp_path / "t"), "key string, n long", buckets=4, keep=2)

    def add(old, new):
        return old.unionByName(new).groupBy("key").agg(F.sum("n").alias("n"))
    for version in (1, 2, 2, 2, 3, 4, 5):
        store.upsert(spark.createDataFrame([("a", 1), (f"b{version}", 1)], store.schema), version, add)
    assert {r.key: r.n for r in store.read(spark).collect()} == {"a": 5} | {f"b{v}": 1 for v in range(1, 6)}
    assert store.versions(spark) == [4, 5]
    kept = {(v, b) for n in (5, 6) for b, v in store.manifest(spark, n).items()}
    found = {(int(p.parent.name[1:]), int(p.name[7:])) for p in (tmp_path / "t").glob("v*/bucket=*")}
    assert found == kept


def test_a_bucket_may_become_empty(spark, tmp_path):
    store = BucketStore(str(tmp_path / "t"), "key string, n long", buckets=1)
    one = spark.createDataFrame([("a", 1)], store.schema)
    store.upsert(one, 1, lambda old, new: new)
    store.upsert(one, 2, lambda old, new: old.join(new, "key", "left_anti"))
    assert store.read(spark).collect() == [] and store.manifest(spark) == {}
    store.upsert(one.limit(0), 3, lambda old, new: new)
    assert store.versions(spark) == [1, 2, 3]


def test_destinations_keep_the_older_chat(spark):
    def side(*rows_):
        return spark.createDataFrame(rows_, "channel string, route string, ident string")
    out = S.merge_destinations(side(("tg", "a", "90"), ("tg", "b", "7")), side(("tg", "a", "100"), ("dc", "a", "5")))
    assert {(r.channel, r.route, r.ident) for r in out.collect()} == {("tg", "a", "90"), ("tg", "b", "7"), ("dc", "a", "5")}


def test_names_for_earlier_publications(spark):
    schema = "key string, fp string, curl string, tgt string, source_name string, score int"
    later = spark.createDataFrame([("n1", "f", "u1", "x", "Zed", 1), ("n2", "f", "", None, "Abe", 5), ("n3", "g", "u9", "x", "Own", 9), ("n4", "f", "", "y", "Far", 9)], schema)
    earlier = spark.createDataFrame([("p1", "f", "", "x", "A"), ("p1", "f", "", "x", "B"), ("p2", "q", "u1", "y", "A"), ("n3", "g", "u9", "x", "A")],
                                    "key string, fp string, curl string, tgt string, grp string")
    out = S.names_for_earlier(later, earlier, -F.col("score"))
    assert {r.key: r.names for r in out.collect()} == {"p1": ["Abe", "Zed"], "p2": ["Zed"]}


# --- runs ----------------------------------------------------------------------------------------------------------------
def test_first_look(spark):
    now = START
    seen = spark.createDataFrame([("old", START - timedelta(days=50), True, {}), ("sent", START, False, {"g": START}), ("other", START, False, {"h": START})],
                                 "key string, first_seen timestamp, baseline boolean, notified map<string,timestamp>")
    postings = spark.createDataFrame([
        ("old", "s1", None, "job"), ("sent", "s1", None, "job"), ("other", "s1", START, "job"), ("late", "s1", START - timedelta(days=9), "job"), ("fresh", "s1", None, "job"),
        ("added", "s2", None, "job"), ("dated", "s2", START, "job"), ("page", "s2", None, "page_change")],
        "key string, source_key string, posted_at timestamp, kind string")
    added = spark.createDataFrame([("s1",)], "source_key string")
    got = {r.key: (r.decision, r.baseline) for r in S.first_look(postings, seen, added, now, "g", 7).collect()}
    assert got == {"old": ("baseline", True), "sent": ("already_notified", False), "other": (None, False), "late": ("too_old", False), "fresh": (None, False),
                   "added": ("baseline", True), "dated": (None, False), "page": (None, False)}
    everything = S.first_look(postings, seen, added, now, "g", 7, bootstrap=True).collect()
    assert {(r.decision, r.baseline) for r in everything} == {("bootstrap", True)} and len(everything) == 8


# --- captured files --------------------------------------------------------------------------------------------------------
def test_broken_files_become_error_rows_and_nothing_is_read_twice(spark, tmp_path):
    for source, payload in (("a b", b'{"x": 1}\n{"x": \n'), ("bad", b"\xff\xfe\x00broken"), ("fine", b'[1, 2]\n')):
        folder = tmp_path / "in" / f"source_key={source.replace(' ', '%20')}"
        folder.mkdir(parents=True)
        (folder / "1.json").write_bytes(payload)
    want = {("a b", True, None), ("a b", False, "body is not JSON"), ("bad", False, "body is not UTF-8"), ("fine", True, None)}
    assert {(r.source_key, r.ok, r.error) for r in C.scan_captures(spark, str(tmp_path / "in")).collect()} == want

    def drain():
        return C.drain(C.capture_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "chk"))
    assert drain() == 3 and drain() == 0
    (tmp_path / "in" / "source_key=fine" / "2.json").write_bytes(b'{"y": 2}\n')
    assert drain() == 1
    assert spark.read.parquet(str(tmp_path / "good")).count() == 3 and spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_resume_by_identity(spark):
    schema = "box string, validity string, uid long"
    rows_ = spark.createDataFrame([("in", "v1", 1), ("in", "v1", 5), ("new", "v1", 1), ("reset", "v2", 1), ("reset", "v2", 9)], schema)
    done = spark.createDataFrame([("in", "v1", 3), ("reset", "v1", 8)], "box string, validity string, done long")
    fresh = C.resume(rows_, done, "box", "validity", "uid")
    assert {(r.box, r.uid) for r in fresh.collect()} == {("in", 5), ("new", 1), ("reset", 1), ("reset", 9)}
    after = C.offsets_after(fresh, "box", "validity", "uid", done)
    assert {(r.box, r.validity, r.done) for r in after.collect()} == {("in", "v1", 5), ("new", "v1", 1), ("reset", "v2", 9)}
    assert C.resume(rows_, after, "box", "validity", "uid").count() == 0
