"""Main text of web pages: boosted trees over DOM-node features, then a decoding that keeps ancestors and descendants consistent."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosted import Boosted
from .html_examples import pages as labelled_pages
from .html_tree import BLOCK, Node, clean, parse
from .shared import blocks, spread_out, table

SCHEMA = "page_id long, url string, text string, n_chars long"
# Groups of attribute tokens and tags that speak for or against an article.
GROUPS = [
    ("content contents article articlebody post posts entry story body text main prose copy maincontent single blog blogpost pagecontent"),
    ("nav menu navbar navigation breadcrumb breadcrumbs topbar links tabs pagination pager toc tablist menubar"),
    ("header masthead banner logo top branding head sitetitle"),
    ("footer bottom copyright legal foot contentinfo colophon imprint"),
    ("sidebar aside widget widgets related recommended recommendations trending popular tags rail complementary mostread more side outbrain"),
    ("ad ads advert adverts advertisement sponsored sponsor promo promotion promoted adbox advertising dfp adsense adslot banner"),
    ("cookie cookies notice gdpr consent alert popup newsletter subscribe subscription modal paywall message dialog signup overlay toast disclaimer"),
    ("comment comments discussion replies reply disqus responses reader respond commentlist thread"),
    ("share social sharing follow print tools facebook twitter buttons"),
    ("form search login register input contact"),
]
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "li", "ul", "td", "nav", "aside", "header", "footer", "form", "blockquote", "table", "button", "label"]
_TOKEN = re.compile(r"[A-Za-z][a-z]+|[A-Z]+")
_GROUP_OF = {w: g for g, words in reversed(list(enumerate(GROUPS))) for w in words.split()}
_TAG_GROUP = {"article": 0, "main": 0, "nav": 1, "header": 2, "footer": 3, "aside": 4, "form": 9, "button": 9, "label": 9, "dialog": 6}
_TAG_MASK = {tag: 1 << g for tag, g in _TAG_GROUP.items()}
_TAG_PLACE = {tag: i for i, tag in enumerate(TAGS)}
_NAMES = ("class", "id", "role", "itemprop", "aria-label")
_SPLIT_TOKENS = re.compile(r"[^A-Za-z]+")


@cache
def _groups_of(value: str) -> int:
    """Bit mask of the groups that an attribute value's tokens belong to (``cookie-notice``, ``postBody``)."""
    mask = 0
    for word in _SPLIT_TOKENS.split(value):
        if word:
            for token in {word.lower(), *(t.lower() for t in _TOKEN.findall(word))}:
                g = _GROUP_OF.get(token)
                if g is not None:
                    mask |= 1 << g
    return mask


class Page:
    """The tree of a page with sums over subtrees: characters, characters in links, stops, elements, words, paragraphs."""

    def __init__(self, source: str):
        self.nodes, self.texts = parse(source)
        nodes, n = self.nodes, len(self.nodes)
        in_link, self.hidden = [False] * n, [False] * n
        for i, node in enumerate(nodes):
            parent, attributes = node.parent, node.attributes
            above = parent >= 0
            in_link[i] = node.tag == "a" or (above and in_link[parent])
            self.hidden[i] = (above and self.hidden[parent]) or (bool(attributes) and (
                "hidden" in attributes or ("style" in attributes and "display:none" in attributes["style"].replace(" ", "").lower())))
        chars, linked, stops, words = [0] * n, [0] * n, [0] * n, [0] * n
        for at, text in self.texts:
            size = len(text.strip())
            if size:
                chars[at] += size
                if in_link[at]:
                    linked[at] += size
                stops[at] += text.count(",") + text.count(".") + text.count("?") + text.count("!")
                words[at] += text.count(" ") + 1
        self.own = chars[:]
        elements, paragraphs = [1] * n, [int(node.tag == "p") for node in nodes]
        for i in range(n - 1, 0, -1):
            p = nodes[i].parent
            chars[p] += chars[i]
            linked[p] += linked[i]
            stops[p] += stops[i]
            elements[p] += elements[i]
            words[p] += words[i]
            paragraphs[p] += paragraphs[i]
        self.sums = np.array([chars, linked, stops, elements, words, paragraphs], float).T

    def features(self) -> np.ndarray:
        nodes, n = self.nodes, len(self.nodes)
        depth, masks, above, tags, place, siblings, children = [0] * n, [0] * n, [0] * n, [-1] * n, [0] * n, [1] * n, [0] * n
        for i, node in enumerate(nodes):
            mask = _TAG_MASK.get(node.tag, 0)
            if node.attributes:
                for name in _NAMES:
                    value = node.attributes.get(name)
                    if value:
                        mask |= _groups_of(value)
            masks[i] = mask
            parent = node.parent
            if parent >= 0:
                depth[i] = depth[parent] + 1
                above[i] = above[parent] | masks[parent]
                place[i], siblings[i] = node.order, len(nodes[parent].children)
            tags[i] = _TAG_PLACE.get(node.tag, -1)
            children[i] = len(node.children)
        parents = np.array([max(node.parent, 0) for node in nodes])
        chars, linked, stops, elements, words, paragraphs = self.sums.T
        up = self.sums[parents]
        with np.errstate(divide="ignore", invalid="ignore"):
            columns = [np.log1p(chars), linked / chars, np.log1p(chars / elements), chars / max(chars[0], 1), chars / up[:, 0], stops / words, np.log1p(elements), np.log1p(paragraphs),
                       np.array(depth), np.array(siblings), np.array(place) / np.array(siblings), np.array(self.own) / chars, up[:, 1] / up[:, 0], np.log1p(up[:, 0]), np.log1p(up[:, 5]),
                       np.arange(n) / n, np.array(children), np.log1p(words), np.log1p(up[:, 0] / up[:, 3])]
        self.marked = [bool(m & ~1) for m in masks]  # says itself that it is something else
        bits = np.arange(len(GROUPS))
        groups = (np.array(masks)[:, None] >> bits) & 1
        groups_above = (np.array(above)[:, None] >> bits) & 1
        kinds = np.array(tags)[:, None] == np.arange(len(TAGS))
        return np.concatenate([np.nan_to_num(np.stack(columns, axis=1), posinf=0.0, neginf=0.0), groups, groups_above, kinds], axis=1)


def decode(nodes: list[Node], score: np.ndarray, weight: np.ndarray, enter: float = 0.5, leave: list[float] | float = 2.0) -> list[bool]:
    """For each node whether it is article, so that the sum of weighted scores is best among the consistent choices.

    From the page down a node is outside, article, or cut out of an article; outside may turn to article, article to cut, never back. So no
    part of a cut subtree is article, and no article lies inside another one's rejected part.  Turns cost ``enter``
    and ``leave`` (which may differ by node)."""
    n = len(nodes)
    leave = leave if isinstance(leave, list) else [leave] * n
    gain = score * weight
    outside, inside, cut = np.zeros(n), gain.copy(), -gain
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        outside[i] -= gain[i]
        outside[p] += max(outside[i], inside[i] - enter)
        inside[p] += max(inside[i], cut[i] - leave[i])
        cut[p] += cut[i]
    state = [0] * n
    state[0] = 0 if outside[0] - gain[0] >= inside[0] - enter else 1
    for i in range(1, n):
        before = state[nodes[i].parent]
        if before == 0:
            state[i] = 0 if outside[i] >= inside[i] - enter else 1
        elif before == 1:
            state[i] = 1 if inside[i] >= cut[i] - leave[i] else 2
        else:
            state[i] = 2
    return [s == 1 for s in state]


def blocks_of(page: Page, chosen: list[bool]) -> list[str]:
    """Texts of the chosen nodes in page order, a block for each block element's run of text."""
    nodes = page.nodes
    block = [0] * len(nodes)
    for i, node in enumerate(nodes):
        block[i] = i if node.parent < 0 or node.tag in BLOCK else block[node.parent]
    out, current, parts = [], -1, []
    last = -1
    for at, text in page.texts:
        # A block that goes on after a block inside it starts a new run.
        inner = last >= 0 and block[at] == current and any(nodes[k].tag in BLOCK for k in range(last + 1, at + 1))
        if block[at] != current or inner:
            if parts:
                out.append(clean("".join(parts)))
            current, parts = block[at], []
        last = max(last, at)
        if chosen[at] and not page.hidden[at]:
            parts.append(text)
    if parts:
        out.append(clean("".join(parts)))
    return [b for b in out if b]


@cache
def train(number: int = 900, seed: int = 11) -> Boosted:
    """Boosted trees on the nodes of labelled pages (a small table made by rule, see html_examples)."""
    xs, ys = [], []
    for marked in labelled_pages(number, seed):
        marks = [m for m in re.findall(r'<[a-zA-Z][^>]*>', marked)]
        page = Page(re.sub(r' data-y="[01]"', "", marked))
        x = page.features()
        wanted = [(m.split()[0].strip("<>").lower(), 'data-y="1"' in m, 'data-y="0"' in m) for m in marks]
        wanted = [w for w in wanted if w[0] not in ("title", "style")]
        y = np.zeros(len(page.nodes))
        for i, (node, (tag, start, stop)) in enumerate(zip(page.nodes[1:], wanted, strict=True), 1):
            assert node.tag == tag
            y[i] = 1.0 if start else 0.0 if stop else y[node.parent]
        full = page.sums[:, 0] > 0
        xs.append(x[full])
        ys.append(y[full])
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys))


def extract(sources: list[str], model: Boosted) -> list[str]:
    """Main text of each page."""
    pages = [Page(s) for s in sources]
    grids = [p.features() for p in pages]
    scores = model.score(np.concatenate(grids)) if grids else np.zeros(0)
    out, at = [], 0
    for page, grid in zip(pages, grids, strict=True):
        score = np.clip(scores[at:at + len(grid)], -6, 6)
        at += len(grid)
        weight = np.where(page.sums[:, 0] > 0, 1.0, 0.0)
        out.append("\n".join(blocks_of(page, decode(page.nodes, score, weight, leave=[0.5 if m else 8.0 for m in page.marked]))))
    return out


def main_text(pages: DataFrame, page: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """The article of every page: (page_id, url, text, n_chars), one row per row.

    Blocks have their character references decoded, white space as single blanks, and are joined by a line feed; null or empty pages and pages
    without an article have empty text; null keys and urls stay; other columns are ignored.  No shuffle; pages are handled in
    small groups.
    """
    model = train()

    def run(batches):
        for batch in batches:
            keys, urls, sources = (batch.column(i) for i in range(3))
            source = [s or "" for s in sources.to_pylist()]
            for a, b in blocks([len(s) for s in source]):
                texts = extract(source[a:b], model)
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), urls.slice(a, b - a), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])
    columns = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).alias("html"))
    return spread_out(columns).mapInArrow(run, SCHEMA)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
