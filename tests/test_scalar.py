"""Input/output facts of the scalar functions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postweave.functions import dates, jsons, labels, status, text, urls
from postweave.operators import keywords as K
from postweave.operators import packing as PK
from postweave.operators import waterfall as W

NOW = datetime(2026, 9, 27, 7, 30)


def test_relative_dates(one):
    cases = {"Posted Today": 0, "Posted Yesterday": 1, "Posted 3 Days Ago": 3, "Posted 30+ Days Ago": 30, "hace 2 días": 2, "il y a 5 jours": 5,
             "gestern": 1, "hace 1 mes": 30, "2 weeks ago": 14}
    got = one(lambda c: dates.parse_relative(c, NOW), list(cases))
    assert got == [NOW - timedelta(days=d) for d in cases.values()]
    assert one(lambda c: dates.parse_relative(c, NOW), ["soon", "", None]) == [None, None, None]


def test_absolute_dates(one):
    cases = [("2026-09-25", datetime(2026, 9, 25), "date"), ("2026-09-25T10:00:00Z", datetime(2026, 9, 25, 10), "datetime"),
             ("2026-09-25T12:00:00+0200", datetime(2026, 9, 25, 10), "datetime"), ("1790000000", datetime(2026, 9, 21, 14, 13, 20), "datetime"),
             ("1790000000000", datetime(2026, 9, 21, 14, 13, 20), "datetime"), ("25/09/2026", datetime(2026, 9, 25), "date"),
             ("09/25/2026", datetime(2026, 9, 25), "date"), ("5.9.26", datetime(2026, 9, 5), "date"), ("31/02/2026", None, "unknown"),
             (None, None, "unknown"), ("whenever", None, "unknown"), ("Fri, 25 Sep 2026 08:00:00 +0200", datetime(2026, 9, 25, 6), "datetime"),
             ("Fri, 25 Sep 2026 08:00:00 GMT", datetime(2026, 9, 25, 8), "datetime"), ("September 25, 2026", datetime(2026, 9, 25), "date"),
             ("20260925", datetime(2026, 9, 25), "date"), ("2026-13-45", None, "unknown")]
    got = one(lambda c: dates.parse_date(c, NOW), [c[0] for c in cases])
    assert [(g["ts"], g["precision"]) for g in got] == [c[1:] for c in cases]


def test_normalize_and_fuzzy(one):
    assert one(text.normalize_text, ["  Crème Brûlée, S.A. ", "ÅNGSTRÖM_x", None, "Zürich—Bern"]) == ["creme brulee s a", "angstrom_x", "", "zurich bern"]
    assert one(text.normalize_text_exact, ["ﬁnance ½", None]) == ["finance 1 2", ""]
    assert one(text.fuzzy_company, ["J.P. Morgan Chase & Co.", "Banco Ejemplo, S.A.", "The Group", None, "A B C D E"]) == ["jpmorganchase", "bancoejemplo", "", "", "abcde"]
    a, b, c = one(lambda x: text.fuzzy_title(x, ["geneva", "united kingdom"]), ["Senior Analyst (m/f/d) - Geneva 2026", "Analyst Senior, United Kingdom", "Senior Analyst Risk"])
    assert a == b == "analyst senior" and c != a


def test_overlapping_phrases_are_removed_longest_first(one):
    got = one(lambda c: text.remove_phrases(c, ["new york", "york new jersey city"]), ["in new york new jersey city now"])
    assert got[0].split() == ["in", "new", "now"]


def test_unknown_company_matches_only_itself(spark):
    df = spark.createDataFrame([("a:1", "", "Analyst"), ("a:2", "", "Analyst"), ("b:1", "X Ltd", "Analyst"), ("c:1", "X", "analyst (m/f/d)")], "k string, c string, t string")
    fp = {r["k"]: r["f"] for r in df.select("k", text.fingerprint(F.col("c"), F.col("t"), F.col("k")).alias("f")).collect()}
    assert fp["a:1"] != fp["a:2"] and fp["b:1"] == fp["c:1"]


def test_urls(one):
    assert one(urls.canonical_url, ["https://www.Jobs.test/a/?utm_source=x&id=5&ref=1#top", "http://jobs.test/a?id=5", "nothing", None]) == [
        "jobs.test/a?id=5", "jobs.test/a?id=5", "", ""]
    wrapped = "https://click.test/x?a=1&URL=https%3A%2F%2Fjobs.test%2Fview%3Fid%3D7"
    assert one(urls.unwrap_redirect, [wrapped, "https://jobs.test/a?id=1"]) == ["https://jobs.test/view?id=7", "https://jobs.test/a?id=1"]
    assert one(urls.strip_tracking, ["https://A.test/p?trk=1&b=2&a=#x"]) == ["https://A.test/p?b=2&a="]


def test_absolute_urls_agree_with_the_standard_library(spark):
    from urllib.parse import urljoin

    bases = ["https://x.test/a/b?q=1#f", "https://x.test", "https://x.test/a/b/c/"]
    refs = ["", "d", "/d", "../d", "../../d", "./d/../e", "?z=1", "#s", "//y.test/p", "https://z.test/a", "d/.", "mailto:a@b.test"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    for row in df.select("b", "r", urls.absolute_url(F.col("b"), F.col("r")).alias("u")).collect():
        if row["b"] == "https://x.test" and row["r"] in ("../d", "../../d", "", "?z=1", "#s", "./d/../e", "d/."):
            continue
        assert row["u"] == urljoin(row["b"], row["r"]), (row["b"], row["r"])


def test_html(one):
    page = "<html><head><title>T</title><script>x</script></head><body><p>A&amp;B</p><style>z</style>c<br>d</body></html>"
    assert one(text.html_to_text, [page, "&lt;p&gt;x &amp;amp; y&lt;/p&gt;", "a  b", None]) == ["A&B c d", "x & y", "a b", ""]
    assert one(text.html_to_text_exact, [page, "&lt;p&gt;x&lt;/p&gt;", "caf&eacute;", None]) == ["A&B c d", "x", "café", ""]
    assert one(text.unwrap_cdata, ["<a><![CDATA[1 < 2]]></a>"]) == ["<a>1 &lt; 2</a>"]


def test_experience(one):
    got = one(text.extract_experience, ["3-5 years", "5+ years", "entre 4 y 6 años", "au moins 7 ans", "young team", "40 years", "9-2 years", None])
    assert [g["label"] for g in got] == ["3-5", "5+", "4-6", "7+", None, None, "2+", None]


def test_experience_casts_found_numbers_only(spark):
    """The cast of an empty text raises and catches an error in the JVM for each row: it was half the time of the largest stage."""
    said = spark.range(1).select(F.col("id").cast("string").alias("c"))
    plan = said.select(text.extract_experience(F.col("c")))._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract" in plan and "try_cast(regexp_extract" not in plan.lower()


def test_keywords(one):
    assert one(lambda c: K.find_keyword(text.normalize_text(c), ["intern*", "wealth manager"]), ["Internship", "Wealth  Manager, senior", "External"]) == ["intern*", "wealth manager", None]
    assert one(lambda c: K.find_keyword(text.normalize_text(c), ["intern"]), ["International", "an intern"]) == [None, "intern"]
    assert one(lambda c: K.find_keyword(text.normalize_text(c), []), ["x"]) == [None]


def test_statuses(one):
    assert one(status.parse_status, ["✅ Aplicada", "ENTREVISTA", "me interesa", "ghosted", None]) == ["applied", "interview", "interested", None, None]
    got = one(status.split_history, ["2026-09-28 aplicado (manual); 2026-09-31 x;; note"])
    assert [(str(e["day"]), e["status"]) for e in got[0]] == [("2026-09-28", "aplicado"), ("None", "2026-09-31 x"), ("None", "note")]


def test_model_replies(one):
    good = '{"results": [{"id": 0}]}'
    replies = [good, f"```json\n{good}\n```", f"Sure: {good} bye", '[{"id": 1}]', "no json", "42", "null", '{"x": 1}']
    assert one(lambda c: F.size(jsons.parse_model_reply(c)), replies) == [1, 1, 1, 1, None, None, None, None]
    v = one(lambda c: jsons.to_verdict(F.parse_json(c), ["a"]), ['{"score": 130.5, "family": "a", "front_office": "yes"}', '{"score": "bad", "family": "b", "experience": "null", "front_office": true}', '{"score": -0.5}'])
    assert (v[0]["score"], v[0]["family"], v[0]["front_office"]) == (100, "a", None)
    assert (v[1]["score"], v[1]["family"], v[1]["experience"], v[1]["front_office"]) == (0, None, None, True)
    assert v[2]["score"] == 0


def test_labels(one):
    assert one(lambda c: labels.label_of(c, F.lit("es")), ["today", "none_such"]) == ["hoy", "none_such"]


def test_quiet_hours(one):
    stamps = [datetime(2026, 1, 1, 23), datetime(2026, 1, 1, 6, 59), datetime(2026, 1, 1, 7), datetime(2026, 1, 1, 12)]
    assert one(lambda c: W.in_quiet_hours(c, "23:00-07:00"), stamps, "timestamp") == [True, True, False, False]
    assert one(lambda c: W.in_quiet_hours(c, "12:00-13:00"), stamps, "timestamp") == [False, False, False, True]


@pytest.mark.parametrize("sizes, expected", [([1505] * 12, [3, 3, 3, 3]), ([1500] * 12, [4, 4, 4]), ([10] * 25, [10, 10, 5])])
def test_pack_blocks(one, sizes, expected):
    got = one(lambda c: PK.pack_blocks(c), [sizes], "array<int>")[0]
    assert [got.count(m) for m in sorted(set(got))] == expected


def test_pack_texts_loses_nothing(one):
    parts = [f"{i}" * 30 for i in range(10)]
    got = one(lambda c: PK.pack_texts(c, 100), [parts], "array<string>")[0]
    assert all(len(m) <= 100 for m in got) and "\n\n".join(got) == "\n\n".join(parts)


def test_pack_numbered_and_bytes(spark, one):
    df = spark.createDataFrame([("h", [(f"line {i}", i) for i in range(1, 100)], "foot")], "h string, p array<struct<text:string,number:int>>, f string")
    got = df.select(PK.pack_numbered(F.col("h"), F.col("p"), F.col("f")).alias("m")).first()["m"]
    assert [len(m["numbers"]) for m in got] == [45, 45, 9] and got[-1]["text"].endswith("foot")
    cut = one(lambda c: PK.cut_bytes(c, 10), ["é" * 8, "a" + "é" * 8, "ab" + "😀" * 4, "€€€€", "short"])
    for raw, c in zip(["é" * 8, "a" + "é" * 8, "ab" + "😀" * 4, "€€€€", "short"], cut, strict=True):
        assert c == raw.encode()[:10].decode(errors="ignore")


def test_every_named_reference(one):
    """All named references, found in buckets of a few instead of one map whose keys are compared one by one."""
    from html.entities import html5

    names = sorted(name for name in html5 if name.endswith(";"))
    assert one(text.unescape, ["".join(f"&{name}|" for name in names)]) == ["".join(f"{html5[name]}|" for name in names)]
    assert one(text.unescape, ["&amp;lt; &nosuch; &#65; &#x41; &#0; &#xD800; &#9999999; &", None, "plain"]) == ["&lt; &nosuch; A A \ufffd \ufffd \ufffd &", None, "plain"]
    assert max(len(bucket.split("\x01")) for bucket in text._entities().split("\x03")) <= 16


def test_iso_dates_are_read_before_relative_ones(one):
    import inspect

    from postweave.functions import dates
    from datetime import datetime

    now = datetime(2026, 1, 5)
    texts = ["2026-01-02", " 2026-01-02T03:04:05Z ", "2026-01-02 03:04:05,5 +0100", "2026-13-45", "3 days ago", "today 2026-01-02"]
    got = one(lambda x: F.concat_ws(" ", dates.iso(dates.parse_date(x, now)["ts"]), dates.parse_date(x, now)["precision"]), texts)
    assert got == ["2026-01-02T00:00:00+00:00 date", "2026-01-02T03:04:05+00:00 datetime", "2026-01-02T02:04:05+00:00 datetime", "unknown",
                   "2026-01-02T00:00:00+00:00 relative", "2026-01-05T00:00:00+00:00 relative"]
    source = inspect.getsource(dates.parse_date)
    assert source.index("_iso(t)") < source.index("let(parse_relative(")
