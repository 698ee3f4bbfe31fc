"""Operators against brute force, and streams against batches."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postweave.operators import dedupe as DD
from postweave.operators import packing as PK
from postweave.operators import places as P
from postweave.operators import routing as R
from postweave.operators import slots as SL
from postweave.operators import state as S
from postweave.operators import tracker as TR
from postweave.operators.stored import BucketStore
from postweave.session import small_table
from postweave.sources import mail as M
from postweave.sources import pages as PG
from postweave.sources import sinks
from postweave.streaming import observe as O


def walk(rows):
    """The definition, one row after the other: rows (key, score, tokens, eligible) in rank order."""
    held, out = {}, {}
    for key, score, tokens, ok in sorted(rows, key=lambda r: (-r[1], r[0])):
        hit = next((held[t] for t in tokens if t is not None and t in held), None)
        if hit is not None:
            out[key] = hit
        elif ok:
            out[key] = None
            held.update({t: key for t in tokens if t is not None})
        else:
            out[key] = "blocked"
    return out


@pytest.mark.parametrize("seed, n, spread", [(1, 400, 60), (2, 400, 400), (3, 300, 3)])
def test_rank_greedy_equals_the_walk(spark, seed, n, spread):
    rnd = random.Random(seed)
    rows = [(f"k{i:04d}", rnd.randrange(20), (f"f{rnd.randrange(spread)}", None if rnd.random() < 0.1 else f"u{rnd.randrange(spread)}"), rnd.random() > 0.1) for i in range(n)]
    df = spark.createDataFrame([(k, s, a, b, ok) for k, s, (a, b), ok in rows], "key string, score int, t1 string, t2 string, ok boolean")
    out, _ = DD.rank_greedy_dedupe(df, "key", ["t1", "t2"], DD.rank_order("score", "key"), F.col("ok"))
    got = {r["key"]: r["dup_of"] or (None if r["kept"] else "blocked") for r in out.collect()}
    assert got == walk(rows)


def test_a_hot_group_of_copies_is_one_row_before_the_rounds(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 7).cast("int").alias("score"),
                                  F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("t1"), F.lit(None).cast("string").alias("t2"))
    out, _ = DD.rank_greedy_dedupe(df, "key", ["t1", "t2"], DD.rank_order("score", "key"))
    assert out.filter("kept AND t1 = 'hot'").count() == 1 and out.filter("dup_of IS NOT NULL").count() == 999


def throttle_walk(stamps, wait):
    last, out = None, []
    for ts in sorted(stamps):
        if last is None or ts - last >= wait:
            out.append(ts)
            last = ts
    return out


def test_throttle_equals_the_walk(spark):
    rnd = random.Random(5)
    start = datetime(2026, 1, 1)
    rows = [(k, start + timedelta(seconds=rnd.randrange(86400 * 2))) for k in ("a", "a", "a", "b") for _ in range(400)]
    df = spark.createDataFrame(rows, "key string, ts timestamp")
    for segment, size in ((1, 1), (3, 1), (3, 20), (12, 1), (12, 100), (12, 5000)):
        got = sorted((r["key"], r["ts"]) for r in SL.throttle(df, "key", "ts", 10, segment_intervals=segment, rows=size).distinct().collect())
        want = sorted((k, ts) for k in ("a", "b") for ts in throttle_walk({t for kk, t in rows if kk == k}, timedelta(minutes=8)))
        assert got == want


def test_every_days_on_a_hot_key_and_many_small_ones(spark):
    rnd = random.Random(11)
    start = datetime(2026, 1, 1)
    rows = [(k, start + timedelta(days=rnd.randrange(400), hours=rnd.randrange(24), minutes=rnd.randrange(60))) for k in ["hot"] * 900 + [f"k{i}" for i in range(60)] * 4]
    got = {(r["key"], r["slot"]) for r in SL.slot_runs(spark.createDataFrame(rows, "key string, ts timestamp"), "key", "ts", "UTC", ["08:00", "15:00"], every_days=3).collect()}
    want = set()
    for key in {k for k, _ in rows}:
        slots = set()
        for ts in (t for k, t in rows if k == key):
            made = [d.replace(hour=h, minute=0) for d in (ts, ts - timedelta(days=1)) for h in (8, 15)]
            slot = max(s for s in made if s <= ts)
            if ts - slot <= timedelta(hours=12):
                slots.add(slot)
        last = None
        for slot in sorted(slots):
            if last is None or (slot.date() - last.date()).days >= 3:
                want.add((key, slot))
                last = slot
    assert got == want


def test_packed_rows_equal_the_fold(spark):
    rnd = random.Random(7)
    rows = [(k, i, "x" * rnd.randrange(1, 60)) for k, n in (("a", 400), ("b", 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, t string")
    whole = df.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("p"))
    want = {(r["k"], r["m"], r["t"]) for r in whole.select("k", F.posexplode(PK.pack_texts(F.transform("p", lambda x: x["t"]), 100)).alias("m", "t")).collect()}
    for size in (1, 30, 5000):
        got = {(r["k"], r["msg"], r["text"]) for r in PK.pack_rows(df, "k", "i", "t", F.floor(F.col("i") / 50), 100, segment_rows=size).collect()}
        assert got == want


def test_long_parts_go_on_in_the_next_message(spark):
    rnd = random.Random(8)
    rows = [(k, i, "".join(rnd.choice("abcdé😀") for _ in range(rnd.choice([1, 40, 99, 100, 101, 200, 350])))) for k, n in (("a", 120), ("b", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, t string")
    want, cut = set(), set()
    for out, most in ((want, None), (cut, 100)):
        for k in ("a", "b"):
            messages = []
            for t in (t[:most] for kk, _, t in rows if kk == k):
                for part in (t[a:a + 100] for a in range(0, len(t), 100)):
                    if messages and len(messages[-1]) + 2 + len(part) <= 100:
                        messages[-1] += "\n\n" + part
                    else:
                        messages.append(part)
            out |= {(k, m, t) for m, t in enumerate(messages)}
    whole = df.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("p"))
    for expected, option in ((want, {}), (cut, {"cut": True})):
        assert {tuple(r) for r in whole.select("k", F.posexplode(PK.pack_texts(F.col("p"), 100, **option))).collect()} == expected
        for size in (1, 5000):
            assert {tuple(r) for r in PK.pack_rows(df, "k", "i", "t", F.floor(F.col("i") / 50), 100, segment_rows=size, **option).collect()} == expected
    assert sum(len(t.replace("\n\n", "")) for _, _, t in want) == sum(len(t) for _, _, t in rows)


def test_long_numbered_lines_go_on_in_the_next_message(spark):
    df = spark.createDataFrame([("h", [("a" * 25, 1), ("b", 2), (None, 0)], "f")], "h string, p array<struct<text:string,number:int>>, f string")
    got = df.select(PK.pack_numbered(F.col("h"), F.col("p"), F.col("f"), 10).alias("m")).first()["m"]
    assert [(m["text"], m["numbers"]) for m in got] == [("h", []), ("a" * 10, [1]), ("a" * 10, []), ("aaaaa\nb\nf", [2])]
    cut = df.select(PK.pack_numbered(F.col("h"), F.col("p"), F.col("f"), 10, cut=True).alias("m")).first()["m"]
    assert [(m["text"], m["numbers"]) for m in cut] == [("h", []), ("a" * 10, [1]), ("b\nf", [2])]


def test_slots(spark):
    df = spark.createDataFrame([(datetime(2026, 9, 27, 7, 30),), (datetime(2026, 10, 25, 7, 59),), (datetime(2026, 10, 25, 8, 0),)], "ts timestamp")
    got = [r["s"] for r in df.select("ts", SL.latest_slot(F.col("ts"), "Europe/Berlin", ["09:00"]).alias("s")).orderBy("ts").collect()]
    assert got == [datetime(2026, 9, 27, 7), datetime(2026, 10, 24, 7), datetime(2026, 10, 25, 8)]
    sunday = [r["s"] for r in df.limit(1).select(SL.latest_slot(F.col("ts"), "Europe/Berlin", ["18:00"], [6]).alias("s")).collect()]
    assert sunday == [datetime(2026, 9, 20, 16)]


GEO_COUNTRIES = [("DE", "DEU", ["Germany", "Deutschland", "Alemania"]), ("PT", "PRT", ["Portugal"]), ("US", "USA", ["United States", "USA"]), ("CA", "CAN", ["Canada"]), ("GE", "GEO", ["Georgia"])]
GEO_CITIES = [("Hamburg", [], "DE", 1700000), ("Munich", ["München", "Muenchen"], "DE", 1400000), ("Lisbon", ["Lisboa", "Lisbonne"], "PT", 500000), ("Toronto", [], "CA", 2700000), ("Porto", [], "PT", 230000)]


def test_places(spark):
    countries = small_table(spark, "iso2 string, iso3 string, names array<string>", GEO_COUNTRIES)
    cities = small_table(spark, "name string, names array<string>, iso2 string, population bigint", GEO_CITIES)
    geo = P.build_gazetteer(countries, cities)
    places = [P.Place("DE", label="Germany"), P.Place("PT", "Lisbon"), P.Place("CA", "Toronto", ("GTA",))]
    cases = {"Berlin, Germany": "Germany", "DEU - Hamburg": "Germany", "Hamburg": "Germany", "München, BY, DE": "Germany", "HAMBURG, HH, DE, 20095": "Germany", "Remote - Deutschland": "Germany",
             "Lisboa, PT": "Lisbon", "Lisbonne": "Lisbon", "Lisboa, LI, PT": "Lisbon", "GTA": "Toronto", "Toronto, ON, CA": "Toronto", "Toronto, Ohio, United States": None,
             "Hamburg, New York, United States": None, "Porto, GE": None, "Porto": None, "": None}
    df = spark.createDataFrame([(k, [k]) for k in cases], "key string, locs array<string>")
    got = {r["key"]: r["target"] for r in P.match_places(df, "key", "locs", places, geo, P.city_aliases(places, cities, geo)).collect()}
    assert got == cases


def test_merge_state_is_idempotent_and_commutes_on_its_minima(spark):
    schema = "key string, first_seen timestamp, last_seen timestamp, notified map<string,timestamp>, also_on array<string>"
    t = [datetime(2026, 1, d) for d in range(1, 9)]
    a = spark.createDataFrame([("x", t[2], t[3], {"g": t[3]}, ["p"]), ("only_a", t[0], t[1], {}, [])], schema)
    b = spark.createDataFrame([("x", t[1], t[5], {"g": t[1], "h": t[4]}, ["q", "p"]), ("only_b", t[0], t[1], {}, ["z"])], schema)
    ab = {r["key"]: r for r in S.merge_state(a, b).collect()}
    ba = {r["key"]: r for r in S.merge_state(b, a).collect()}
    assert ab["x"]["first_seen"] == t[1] and ab["x"]["last_seen"] == t[5] and ab["x"]["notified"] == {"g": t[1], "h": t[4]} and ab["x"]["also_on"] == ["q", "p"]
    assert set(ab) == {"x", "only_a", "only_b"}
    assert all(ab[k][c] == ba[k][c] for k in ab for c in ("first_seen", "last_seen", "notified"))
    assert sorted(map(str, S.merge_state(a, a).collect())) == sorted(map(str, a.collect()))


def test_manual_ids_skip_used_numbers(spark):
    import hashlib

    base = "m-" + hashlib.sha1(b"C|T|").hexdigest()[:8]
    rows = [(1, base, "C", "T", "", "applied", "2026-09-01", "2026-09-01 applied"), (2, f"{base}-3", "C", "T", "", "", "", "")]
    rows += [(3 + i, "", "C", "T", "", "", "", "") for i in range(3)] + [(9, "", "", "", "", "applied", "", "")]
    df = spark.createDataFrame(rows, "pos bigint, id string, company string, title string, url string, status string, date string, history string")
    got = {r["pos"]: r["id"] for r in TR.detect_manual(df, date(2026, 9, 30)).collect()}
    assert [got[p] for p in (3, 4, 5)] == [f"{base}-2", f"{base}-4", f"{base}-5"] and got[9] == ""


def test_routes_without_index_carry_warnings_in_the_catch_all(spark):
    groups = spark.createDataFrame([("g",)], "grp string")
    assert R.warning_carriers(groups, R.Routes(other="rest")).first().asDict() == {"grp": "g", "route": "rest", "kind": "other"}
    assert R.warning_carriers(groups, R.Routes(summary="idx")).first()["route"] == "idx"


def test_plain_mail_and_bad_mail(spark):
    mails = [(1, b"From: A <a@b.test>\r\nSubject: S\r\nDate: Fri, 25 Sep 2026 08:00:00 +0200\r\n\r\nhello <x> https://x.test/1\r\n"), (2, b"\xff\xfe")]
    got = {r["uid"]: r for r in M.parse_messages(spark.createDataFrame(mails, "uid bigint, content binary")).collect()}
    assert got[1]["sender"] == "a@b.test" and got[1]["body"].startswith("<pre>hello &lt;x>") and got[1]["sent_at"] == datetime(2026, 9, 25, 6)
    assert set(got) == {1, 2}


def stream(spark, tmp_path, rows, schema, files=4):
    """The rows as a file stream of several micro-batches."""
    df = spark.createDataFrame(rows, schema)
    for i in range(files):
        df.filter(F.col("seq") % files == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(query_writer, tmp_path):
    q = query_writer.option("checkpointLocation", str(tmp_path / "chk")).start()
    q.processAllAvailable()
    q.stop()


@pytest.fixture(scope="module")
def log():
    rnd = random.Random(9)
    start = datetime(2026, 1, 1)
    return [(f"u{rnd.randrange(6)}", i, start + timedelta(minutes=i * 7), rnd.choice(["applied", "aplicado", "offer", "x"])) for i in range(300)]


def test_publish_once_retries_what_was_not_delivered(spark, tmp_path, log):
    src = stream(spark, tmp_path, log, "key string, seq bigint, ts timestamp, grp string")
    store = BucketStore(str(tmp_path / "pub"), O.PUBLISHED_SCHEMA, ["key", "grp"], 8)
    run(src.writeStream.foreachBatch(O.publish_batch(store, lambda df, n: df.filter("key <> 'u0'") if n == 0 else df)), tmp_path)
    got = store.read(spark)
    assert got.count() == got.select("key", "grp").distinct().count() == len({(r[0], r[3]) for r in log})


def test_grace_stream_keeps_one_row_per_slot(spark, tmp_path, log):
    rows = [(k, i, ts, ts.replace(hour=0, minute=0)) for k, i, ts, _ in log]
    schema = "key string, seq bigint, ts timestamp, slot timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run(O.first_within_grace(src).writeStream.format("memory").queryName("gr").outputMode("append"), tmp_path)
    assert spark.table("gr").count() == len({(r[0], r[3]) for r in rows})


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "x, y", 1), ("b", None, 2)], "id string, notes string, n int")
    sinks.write_tracker_csv(df, str(tmp_path / "csv"))
    assert sorted(r["id"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == ["a", "b"]
    sinks.json_lines(df).write.text(str(tmp_path / "json"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "json")).count() == 2
    lines = spark.createDataFrame([("1", 1, "| b |"), ("1", 0, "| a |")], "section string, line_ord int, line string")
    sinks.write_report(lines, str(tmp_path / "md"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "md")).collect()] == ["| a |", "| b |"]
    assert sinks.scan_payloads(spark.read, str(tmp_path / "md"), "binaryFile").filter("length > 0").count() >= 1


def test_keywords_of_any_length_and_beginnings(spark):
    from postweave.operators.keywords import find_keyword_join
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "internship in data"), (3, "international"), (4, "senior data engineers wanted"), (5, "")], "id int, n string")
    table = spark.createDataFrame([(1, "b c d e f g", "b c d e f g"), (2, "intern*", "intern"), (3, "senior data eng*", "senior data eng"), (4, "*", "")], "ord int, keyword string, norm string")
    got = {r.id: r.keyword for r in find_keyword_join(docs, "id", F.col("n"), table).collect()}
    assert got == {1: "b c d e f g", 2: "intern*", 3: "intern*", 4: "senior data eng*", 5: None}


def test_only_sequences_as_long_as_a_keyword_are_built(spark, monkeypatch):
    from postweave.operators import keywords as K

    monkeypatch.setattr(K, "word_grams", None)  # sequences of all lengths up to the longest
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "c d"), (3, None), (4, "x")], "id int, n string")
    table = spark.createDataFrame([(1, "b c d e f", "b c d e f"), (2, "x", "x"), (3, "c d", "c d")], "ord int, keyword string, norm string")
    assert {r.id: r.keyword for r in K.find_keyword_join(docs, "id", F.col("n"), table).collect()} == {1: "b c d e f", 2: "c d", 3: None, 4: "x"}


def test_a_title_is_read_once_and_questions_are_taken_apart_once(spark, capsys):
    from datetime import datetime

    from postweave.functions.jsons import dig
    from postweave.sources import json_map as J
    from postweave.sources import vendors as VD

    now = datetime(2026, 9, 27)
    asked = [("ReqId", "1"), ("JobTitle", "old"), ("JOBTITLE", "A &amp; B"), ("City", " Zug "), ("JobDescription", "<p>d</p>"), ("LastUpdated", "2026-09-01")]
    questions = ", ".join(f'{{"QuestionName": "{k}", "Value": "{v}"}}' for k, v in asked)
    body = f'{{"Jobs": {{"Job": [{{"Questions": [{questions}], "Link": "https://x.test/1"}}, {{"Questions": [], "Link": "https://x.test/2"}}, {{}}]}}}}'
    captures = spark.createDataFrame([("s", 1, body), ("s", 2, "no json")], "source_key string, page_no int, body string")
    got = J.normalize_json(captures, VD.brassring(["city", "state"]), now).collect()
    assert [(r.native_id, r.title, r.url, r.locations, r.description, str(r.posted_at), r.posted_precision) for r in got] == [
        ("1", "A & B", "https://x.test/1", ["Zug"], "d", "2026-09-01 00:00:00", "date")]
    marked = J.Mapping("", id="id", title=lambda v: F.concat(F.lit("MARK"), dig(v, "t")))
    capsys.readouterr()
    J.normalize_json(captures, marked, now).explain()
    assert capsys.readouterr().out.count("MARK") == 1


def test_scores_are_validated_and_budgets_do_not_depend_on_partitions(spark):
    from postweave.operators.scoring import score_batches
    docs = spark.createDataFrame([(f"k{i}", "t", "x" * 5000) for i in range(9)], "key string, title string, description string").repartition(4)
    answers = [{"score": "87"}, {"score": 140, "family": 3}, {"score": None}, {"score": "nan", "reason": ""}]

    def scorer(batch):
        assert all(len(d["description"]) == 5000 for d in batch)
        return {i: answers[int(d["key"][1:]) % 4] for i, d in enumerate(batch)}
    got = {r.key: (r.score, r.family, r.reason) for r in score_batches(docs, scorer, batch_size=2).collect()}
    assert got["k0"] == (87, None, None) and got["k1"] == (100, None, None) and got["k2"][0] == 0 and got["k3"] == (0, None, None) and len(got) == 9
    some = score_batches(docs, scorer, batch_size=2, max_calls=2).collect()
    assert sorted(r.key for r in some) == ["k0", "k1", "k2", "k3"]


def test_numbers_over_the_whole_order(spark):
    from postweave.operators.digest import number_all
    df = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(1000)], "v int, i int").repartition(7)
    assert [(r.v, r.rank) for r in number_all(df, F.desc("v"), F.asc("i")).orderBy("rank").collect()] == [(999 - i, i + 1) for i in range(1000)]


def test_acceptance_has_one_gate(spark):
    from postweave.operators.stats import acceptance
    rows = [("applied", "s1", "f"), ("discarded", "s1", None), ("offer", None, "f"), ("offer", None, "f"), ("offer", None, "f")]
    marks = spark.createDataFrame(rows, "status string, src string, family string")
    assert acceptance(marks, F.col("src"), F.col("src"), F.col("family"), min_marks=5).collect() == []
    got = {(r.name, r.wanted, r.discarded) for r in acceptance(marks, F.col("src"), F.col("src"), F.col("family"), min_marks=2).collect()}
    assert got == {("s1", 1, 1), ("f", 4, 0)}


def test_long_chains_of_duplicates_and_rows_without_tokens(spark):
    from postweave.operators.dedupe import rank_greedy_dedupe, rank_order
    rows = [(f"k{i}", f"a{i // 2}", f"b{(i + 1) // 2}", 100 - i) for i in range(40)] + [(f"n{i}", None, None, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "key string, a string, b string, score int")
    out, _ = rank_greedy_dedupe(df, "key", ["a", "b"], rank_order("score", "key"))
    kept, owned = set(), {}
    for key, a, b, _ in rows[:40]:
        hit = owned.get(("a", a)) or owned.get(("b", b))
        if not hit:
            kept.add(key)
            owned |= {("a", a): key, ("b", b): key}
    assert {r.key for r in out.collect() if r.kept} == kept | {f"n{i}" for i in range(5)}


def test_links_decode_every_reference(spark):
    hrefs = {"/caf&eacute;?a=1&amp;b=2": "/café?a=1&b=2", "&#x2F;jobs&#47;5?x&#x3D;1": "/jobs/5?x=1", "/a&middot;b&ndash;c&hellip;": "/a·b–c…",
             "/q&amp;eacute;": "/q&eacute;", "/plain": "/plain"}
    body = "".join(f'<a href="{h}">link &amp; {i}</a>' for i, h in enumerate(hrefs))
    pages = spark.createDataFrame([("p", "https://www.example.com/x", body)], "source_key string, url string, body string")
    want = ["https://www.example.com" + h for h in hrefs.values()]
    assert [(r["href"], r["text"]) for r in PG.page_links(pages).orderBy("pos").collect()] == [(h, f"link & {i}") for i, h in enumerate(want)]
    known = spark.createDataFrame([("p", h) for h in want[:-1]], "source_key string, href string")
    assert [r["href"] for r in PG.new_links(pages, known, known, r"\.example\.").collect()] == want[-1:]


def test_numbers_of_equal_contents_fill_the_gaps(spark):
    """Ids in use are skipped wherever they are; a walk in file order gives the same."""
    rnd = random.Random(3)
    import hashlib

    def base(company):
        return "m-" + hashlib.sha1(f"{company}|t|".encode()).hexdigest()[:8]
    rows, used = [], {"hot": [1, 2, 5, 9, 10, 11, 40], "b": [3], "c": []}
    for company, numbers in used.items():
        rows += [(base(company) + (f"-{n}" if n > 1 else ""), "other", "t", "", "", "", "", 0) for n in numbers]
    rows += [("", c, "t", "", "", "", "", 0) for c in ["hot"] * 60 + ["b"] * 4 + ["c"] * 3]
    rnd.shuffle(rows)
    rows = [(*r[:-1], i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "id string, company string, title string, url string, status string, date string, history string, pos int")
    got = {r["pos"]: r["id"] for r in TR.detect_manual(df, date(2026, 1, 1), chunk=7).collect()}
    ids, want = {r[0] for r in rows if r[0]}, {}
    for r in rows:
        if r[0]:
            want[r[-1]] = r[0]
            continue
        name, n = base(r[1]), 1
        while name in ids:
            n += 1
            name = f"{base(r[1])}-{n}"
        ids.add(name)
        want[r[-1]] = name
    assert got == want


def test_long_chains_take_a_bounded_number_of_rounds(spark, monkeypatch):
    """Rows that each wait for the one before: a round at a time would be 500 rounds."""
    rounds = []
    cut = DD.cut_lineage
    monkeypatch.setattr(DD, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    rnd = random.Random(12)
    rows = [(f"c{i:04d}", 5000 - i, f"t{i // 2}", f"u{(i + 1) // 2}") for i in range(1000)]  # neighbours share one token, in turn the first and the second
    rows += [(f"g{i:04d}", rnd.randrange(100), f"h{rnd.randrange(40)}", f"k{rnd.randrange(400)}") for i in range(500)]
    rows += [("n1", None, "t5", None), ("n2", 7, None, None)]
    df = spark.createDataFrame(rows, "key string, score int, a string, b string")
    held, want = set(), set()
    for key, _, a, b in sorted(rows, key=lambda r: (-(r[1] or 0), r[0])):
        own = {("a", a), ("b", b)} - {("a", None), ("b", None)}
        if held.isdisjoint(own):
            held |= own
            want.add(key)
    out, _ = DD.rank_greedy_dedupe(df, "key", ["a", "b"], DD.rank_order("score", "key"))
    assert {r["key"] for r in out.filter("kept").collect()} == want and len(rounds) <= 6
    # The large component, of the rows without a chain, goes on in rounds.
    some = df.filter("key NOT LIKE 'c%'")
    out, _ = DD.rank_greedy_dedupe(some, "key", ["a", "b"], DD.rank_order("score", "key"), rounds_first=1, small=100)
    rest = {r[0] for r in rows if r[0][0] != "c"}
    held, want = set(), set()
    for key, _, a, b in sorted((r for r in rows if r[0] in rest), key=lambda r: (-(r[1] or 0), r[0])):
        own = {("a", a), ("b", b)} - {("a", None), ("b", None)}
        if held.isdisjoint(own):
            held |= own
            want.add(key)
    assert {r["key"] for r in out.filter("kept").collect()} == want
