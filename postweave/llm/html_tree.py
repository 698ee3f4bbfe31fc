"""A forgiving, iterative HTML tree: enough of the parsing rules to find the blocks of a page.  No recursion, linear scanning."""

from __future__ import annotations

import html
import re

VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed svg math object select".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul legend""".split())
#: Opening one of these ends an open element named on the right, up to the nearest boundary.
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
           "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
BOUNDARY = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",))}
TABLE = frozenset(("table",))

_TAG = re.compile(r"""<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|=|["'])*)>?|[!?][^>]*>?)""")
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label|hidden|style|type|href)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "order", "children", "attributes")

    def __init__(self, tag: str, parent: int, attributes: dict[str, str], order: int = 0):
        self.tag, self.parent, self.attributes, self.order = tag, parent, attributes, order
        self.children: list[int] = []


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes in page order (0 is the page itself) and runs of text as (node, text); scripts, styles and comments are left out.

    A paragraph ends where another block begins; an unknown end tag is ignored; an end tag closes everything inside it."""
    nodes, texts, stack, at, size = [Node("page", -1, {})], [], [0], 0, len(page)
    low = None
    open_tags: dict[str, int] = {}

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            open_tags[nodes[stack.pop()].tag] -= 1

    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            texts.append((stack[-1], page[at:mark]))
        if mark == size:
            break
        m = _TAG.match(page, mark)
        if not m:
            texts.append((stack[-1], "<"))
            at = mark + 1
            continue
        at = m.end()
        if m[1]:
            end = page.find("-->", at)
            at = size if end < 0 else end + 3
            continue
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if open_tags.get(tag):
                depth = len(stack) - 1
                while nodes[stack[depth]].tag != tag:
                    depth -= 1
                close_to(depth)
            continue
        if tag in RAW:
            if low is None:
                low = page.lower()
                if len(low) != size:  # some letters change length: keep places right
                    low = "".join(c if len(c.lower()) != 1 else c.lower() for c in page)
            if not m[4].rstrip().endswith("/"):
                end = low.find("</" + tag, at)
                gone = size if end < 0 else page.find(">", end)
                at = size if gone < 0 else min(gone + 1, size)
            continue
        if tag in BLOCK and open_tags.get("p"):
            depth = len(stack) - 1
            while nodes[stack[depth]].tag != "p":
                depth -= 1
            close_to(depth)
        if tag in IMPLIED:
            wanted, stop = IMPLIED[tag], BOUNDARY.get(tag, TABLE)
            if any(open_tags.get(w) for w in wanted):
                depth, found = len(stack) - 1, 0
                while depth > 0 and nodes[stack[depth]].tag not in stop:
                    if nodes[stack[depth]].tag in wanted:
                        found = depth
                    depth -= 1
                if found:
                    close_to(found)
        node = len(nodes)
        attributes = {}
        if m[4]:
            for a in _ATTRIBUTE.finditer(m[4]):
                attributes[a[1].lower()] = a[2] or a[3] or a[4] or ""
        nodes.append(Node(tag, stack[-1], attributes, len(nodes[stack[-1]].children)))
        nodes[stack[-1]].children.append(node)
        if tag not in VOID and not (m[4] and m[4].endswith("/") and tag not in BLOCK):
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
        elif tag == "br":
            texts.append((node, "\n"))
    return nodes, texts


def clean(text: str) -> str:
    """Character references decoded, runs of white space as one blank, trimmed."""
    return _BLANK.sub(" ", html.unescape(text)).strip()
