import re

import numpy as np
import pytest

from postweave.llm.boosted import Boosted
from postweave.llm.html_examples import pages
from postweave.llm.html_extract import Page, blocks_of, decode, extract, main_text, train
from postweave.llm.html_tree import clean, parse


def words_of(marked):
    """Words inside and outside the marked article of a labelled page, by the same tree."""
    marks = [m for m in re.findall(r"<[a-zA-Z][^>]*>", marked) if m.split()[0].strip("<>") not in ("title", "style")]
    page = Page(re.sub(r' data-y="[01]"', "", marked))
    chosen = [False] * len(page.nodes)
    for i, m in enumerate(marks, 1):
        chosen[i] = 'data-y="1"' in m or ('data-y="0"' not in m and chosen[page.nodes[i].parent])
    return "\n".join(blocks_of(page, chosen))


def test_tree_of_odd_markup():
    nodes, texts = parse("<p>one<b>two<p>three</p><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><!-- <p>x -->4 < 5<script>var a='</p>';</script><br/>end")
    shown = [(nodes[i].tag, t) for i, t in texts]
    assert shown == [("p", "one"), ("b", "two"), ("p", "three"), ("li", "a"), ("li", "b"), ("td", "1"), ("td", "2"), ("td", "3"), ("page", "4 "), ("page", "<"), ("page", " 5"), ("br", "\n"), ("page", "end")]
    assert [nodes[n.parent].tag for n in nodes if n.tag == "li"] == ["ul", "ul"]
    for odd in ("", "<", "<>", "</p>", "<!--", "<!doctype", "<a href='", "<script>", "a\x00b", "<p" * 50, "</" * 50, "İ<script>İ</script>x"):
        parse(odd)


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "<article><p>The article text is here, deep down.</p></article>" + "</div>" * 20_000
    assert isinstance(extract([deep], train())[0], str)
    long = "<article>" + "<p>Sentence number one, and two.</p>" * 20_000 + "</article>"
    assert extract([long], train())[0].count("\n") == 19_999


def test_references_and_white_space():
    assert clean(" a&amp;b\n &copy;&nbsp; c\t&#8211;&#x41; ") == "a&b © c –A"


def test_trees_fit_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    model = Boosted(trees=40, depth=3).fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0) == y[3000:]).mean() > 0.95


def test_decoding_is_consistent_and_best():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 8))
        nodes, _ = parse("")
        nodes = nodes[:1]
        from postweave.llm.html_tree import Node
        for i in range(1, n):
            nodes.append(Node("div", int(rng.integers(0, i)), {}))
        score = rng.normal(size=n) * 3

        def value(states):
            total = 0.0 if states[0] != 1 else -0.5
            for i, s in enumerate(states):
                total += score[i] if s == 1 else -score[i]
                if i:
                    before = states[nodes[i].parent]
                    if (before, s) in ((0, 2), (1, 0), (2, 0), (2, 1)):
                        return -np.inf
                    total -= {(0, 1): 0.5, (1, 2): 2.0}.get((before, s), 0.0)
            return total
        chosen = decode(nodes, score, np.ones(n))
        best = max(value(s) for s in np.ndindex(*[2] + [3] * (n - 1)))
        possible = [s for s in np.ndindex(*[2] + [3] * (n - 1)) if [x == 1 for x in s] == chosen]
        assert abs(max(map(value, possible)) - best) < 1e-9


def test_held_out_layouts():
    model = train()
    made = pages(150, seed=977)
    got = extract([re.sub(r' data-y="[01]"', "", p) for p in made], model)
    f1 = []
    for page, text in zip(made, got, strict=True):
        want, have = set(words_of(page).split("\n")), set(text.split("\n"))
        both = len(want & have)
        f1.append(2 * both / max(len(want) + len(have), 1))
    print(np.mean(f1), np.mean([x == 1 for x in f1]))
    assert np.mean(f1) > 0.93


def test_pages_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r for r in main_text(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    exact = 0
    for r in rows:
        inside = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        want = "\n".join(b for b in (clean(re.sub(r"<[^>]*>", " ", part)) for part in re.split(r"</?(?:p|h1)>", inside)) if b)
        exact += got[r.page_id].text == want
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    assert exact == len(rows)


@pytest.mark.parametrize("page,kept,gone", [
    ("<body><div id='menu'><a href='/'>Home</a> <a href='/b'>More</a></div><div class='post-body'><h2>Title of it</h2><p>The first paragraph, with words enough to read.</p>"
     "<div class='advert'>Buy now cheap</div><p>The second paragraph goes on, and ends.</p></div><div class='cookie-notice'>We use cookies.</div><div id='comments'><p>Nice post, thanks!</p></div></body>",
     ["Title of it", "The first paragraph", "The second paragraph"], ["Home", "Buy now", "cookies", "Nice post"]),
    ("<main><p>Only a short text here.</p></main><aside><p>Related: other things to read</p></aside><footer>Contact us</footer>", ["Only a short text"], ["Related", "Contact us"]),
])
def test_hand_written_pages(page, kept, gone):
    text = extract([page], train())[0]
    assert all(k in text for k in kept) and not any(g in text for g in gone), text


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (2, "u", "", "t"), (None, "u", "plain words only, no markup at all.", "t"), (2, "u", "<script>x</script>", "t")], "page_id long, url string, html string, text string")
    rows = main_text(df).collect()
    assert len(rows) == 4 and all(r.text is not None and r.n_chars == len(r.text) for r in rows)
    assert main_text(df.limit(0)).collect() == []
