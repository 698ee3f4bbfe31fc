"""Captured pages and mails that break simple readers."""

import pytest
from pyspark.sql import functions as F

from postweave.sources import mail as M
from postweave.sources import pages as P
from postweave.sources.markup import Page, selectors, visible_text


def found(html, **named):
    page = Page(html, selectors(**named))
    return {name: [page.text(i) for i in page.all(name)] for name in named}


def test_selectors():
    html = """<div id=a class="x y"><p>one<b>two</b></p><ul><li>3<li class="x">4<ul><li>5</ul></ul></div><p data-k="v w">six</p><A HREF="/z">seven</A>"""
    assert found(html, a="div.x.y", b="div p b", c="ul li", d="li li, #a p", e='[data-k="v w"]', f="a[href]", g="*", h="div div", i="p.x") == {
        "a": ["onetwo 3 4 5".replace("onetwo", "one two")], "b": ["two"], "c": ["3", "4 5", "5"], "d": ["one two", "5"], "e": ["six"], "f": ["seven"],
        "g": ["one two 3 4 5", "one two", "two", "3 4 5", "3", "4 5", "5", "5", "six", "seven"], "h": [], "i": []}


@pytest.mark.parametrize("bad", ["div > p", "a:hover", "p + p", "[href", "li,,a", ","])
def test_unsupported_selectors_raise_when_the_mapping_is_made(bad):
    with pytest.raises(ValueError):
        P.ListMapping(bad)


def test_parts_of_an_element():
    page = Page("<ul><li><a href=1>x</a>tail</li><li>no link</li></ul><a href=2>out</a>", selectors(item="li", link="a"))
    first, second = page.all("item")
    assert page.first("link", first) is not None and page.first("link", second) is None and len(page.all("link")) == 2
    assert page.all("missing") == [] and page.first("missing", first) is None


def test_hidden_text_and_stray_ends():
    assert visible_text("<body>a<script>if (a<b) x</script> b</p></div>c<style>y</style>") == "a b c"
    assert visible_text("plain &amp; simple") == "plain & simple" and visible_text("") == ""


def test_many_nested_tags():
    deep = "<div><b class=k>" * 10_000 + "<li class=job>x</li>" + "</b></div>" * 10_000
    assert found(deep, a="li.job", b="div b li") == {"a": ["x"], "b": ["x"]}
    assert found("<ul><li>" * 5_000 + "x", a="li")["a"][-1] == "x"


def pages_of(spark, *bodies):
    return spark.createDataFrame([(f"s{i}", 1, "https://h.test/", b) for i, b in enumerate(bodies)], "source_key string, page_no int, url string, body string")


def test_one_broken_page_never_ends_the_others(spark):
    bodies = ["<div>" * 20_000 + "<li class=j><a href=/1>T</a></li>", None, "", "<li class=j", "<li class=j><a href=/2>U</a>"]
    got = P.read_items(pages_of(spark, *bodies), P.ListMapping("li.j", "a")).collect()
    assert {(r.source_key, r.title, r.href) for r in got} == {("s0", "T", "/1"), ("s4", "U", "/2")}


def test_deep_json(spark):
    good = '<script type="application/ld+json">{"@type": "JobPosting", "title": "T"}</script>'
    bodies = [f'<script type="application/ld+json">{"[" * 100_000}</script>{good}', f'<script type="application/ld+json">{"[" * 5000}{"]" * 5000}</script>{good}', good]
    got = P.extract_jsonld(pages_of(spark, *bodies)).select("source_key", F.to_json("item").alias("j")).collect()
    assert sorted(r.source_key for r in got) == ["s0", "s1", "s2"] and {r.j for r in got} == {'{"@type":"JobPosting","title":"T"}'}


def test_plain_mail_from_raw_message_to_posting(spark):
    body = "Hello\r\n\r\nSenior Analyst & Lead\r\nACME <Group> \u00b7 Zug\r\n<https://www.linkedin.com/comm/jobs/view/an-analyst-1234567?x=1>\r\n\r\nOther Role\r\nhttps://www.linkedin.com/jobs/view/7654321.\r\n"
    raw = ("From: LinkedIn <jobs@linkedin.com>\r\nSubject: s\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n" + body).encode()
    messages = M.parse_messages(spark.createDataFrame([(1, raw), (2, b"\xff")], "uid bigint, content binary")).withColumn("site", M.route_by_sender(F.col("sender")))
    links = M.mail_links(messages.filter("uid = 1"))
    assert [r.text for r in links.orderBy("pos").collect()] == ["Hello", "Other Role"]
    got = {r.native_id: r.title for r in M.links_to_postings(links.withColumn("site", F.lit("linkedin"))).collect()}
    assert set(got) == {"1234567", "7654321"} and got["7654321"] == "Other Role"


def test_levels_skip_wrappers_and_reach_the_body(spark):
    html = "<html><body>" + "<div>" * 30 + "<p><a href='https://a.test/1'>x</a> side</p>" + "</div>" * 30 + "<a href='https://a.test/2'>y</a></body></html>"
    links = M.mail_links(spark.createDataFrame([(1, html)], "uid bigint, body string")).orderBy("pos").collect()
    assert [[lv.lines for lv in r.levels] for r in links] == [[["x"], ["x", "side"]], [["y"]]]


def test_frames_are_bounded_by_rows_and_by_bytes():
    import pyarrow as pa
    from postweave.sources.batches import FRAME_BYTES, FRAME_ROWS, frames

    schema = pa.schema([("i", pa.int64()), ("t", pa.string())])
    many = list(frames(((i, "x") for i in range(2 * FRAME_ROWS + 1)), schema))
    assert [b.num_rows for b in many] == [FRAME_ROWS, FRAME_ROWS, 1] and many[-1].column("i").to_pylist() == [2 * FRAME_ROWS]
    wide = list(frames(((i, "x" * FRAME_BYTES) for i in range(3)), schema))
    assert [b.num_rows for b in wide] == [1, 1, 1] and list(frames((), schema)) == []


class OneBatch:
    """A table of one batch, whose steps run here."""

    def __init__(self, batch):
        self.batch = batch

    def select(self, *_):
        return self

    def withColumn(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.out = list(run(iter([self.batch])))
        return self


def test_mails_and_lists_go_out_in_frames():
    import pyarrow as pa
    from postweave.sources.batches import FRAME_ROWS

    html = '<table><tr><td><a href="https://a.test/1">Some title</a></td></tr></table>'
    mails = OneBatch(pa.record_batch({"uid": pa.array(range(5_000), pa.int64()), "body": pa.array([html] * 5_000)}))
    M.mail_links(mails)
    assert sum(b.num_rows for b in mails.out) == 5_000 and max(b.num_rows for b in mails.out) <= FRAME_ROWS
    pages = OneBatch(pa.record_batch({"source_key": pa.array(["s"] * 5_000), "page_no": pa.array([1] * 5_000, pa.int32()), "url": pa.array(["u"] * 5_000),
                                      "body": pa.array(["<li class=j><a href=/1>T</a></li>"] * 5_000)}))
    P.read_items(pages, P.ListMapping("li.j", "a"))
    assert sum(b.num_rows for b in pages.out) == 5_000 and max(b.num_rows for b in pages.out) <= FRAME_ROWS


def test_unreadable_mails_and_missing_dates(spark):
    raw = [(1, b"From: A <a@b.test>\r\nSubject: s\r\nDate: Fri, 03 Aug 2001 08:00:00 +0200\r\n\r\nx"), (2, b"From: c@d.test\r\n\r\ny"), (3, None)]
    got = {r.uid: (r.sender, str(r.sent_at), r.error) for r in M.parse_messages(spark.createDataFrame(raw, "uid bigint, content binary")).collect()}
    assert got == {1: ("a@b.test", "2001-08-03 06:00:00", None), 2: ("c@d.test", "None", None), 3: (None, "None", "TypeError")}


def test_jsonld_keeps_the_other_columns(spark):
    page = '<script type="application/ld+json">[{"@type": "JobPosting", "title": "A"}, {"@type": "X"}, {"@type": ["JobPosting"], "title": "B"}]</script>'
    pages = spark.createDataFrame([(1.5, [1, None], None, page), (None, None, "u", page), (2.0, [], "v", "none"), (3.0, [], "w", None)], "a double, b array<int>, url string, body string")
    got = sorted((str(r.a), r.b, r.url, r.pos, r.t) for r in P.extract_jsonld(pages).select("a", "b", "url", "pos", F.expr("variant_get(item, '$.title', 'string')").alias("t")).collect())
    assert got == [("1.5", [1, None], None, 0, "A"), ("1.5", [1, None], None, 1, "B"), ("None", None, "u", 0, "A"), ("None", None, "u", 1, "B")]


def test_tags_without_attributes_take_few_steps(monkeypatch):
    """A run of plain tags is one call of the tokenizer, and gives what the standard tokenizer gives."""
    from html.parser import HTMLParser

    html = "<html><body>" + "<b>" * 3_000 + "<ul><li>x<li>y<script>if (a<b) x</script><title><b></title><P>z"
    calls = []
    start = Page.parse_starttag
    monkeypatch.setattr(Page, "parse_starttag", lambda self, i: calls.append(i) or start(self, i))
    quick = Page(html, selectors(a="li", b="b li"))
    assert len(calls) < 10
    monkeypatch.setattr(Page, "parse_starttag", HTMLParser.parse_starttag)
    plain = Page(html, selectors(a="li", b="b li"))
    assert (quick.tags, quick.parent, quick.last, quick.texts, quick.hits) == (plain.tags, plain.parent, plain.last, plain.texts, plain.hits)
