"""Captured HTML in one pass: the standard tokenizer feeds flat arrays, and a selector automaton runs along the open elements."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Sequence
from functools import cache
from html.parser import HTMLParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HIDDEN = {"script", "style"}
_RAW_TEXT = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}  # their contents may be read otherwise
_PLAIN_TAG = re.compile(r"<([A-Za-z][A-Za-z0-9]*)>")
_COMPOUND = re.compile(r"(?P<tag>[\w-]+|\*)?(?P<rest>(?:[.#][\w-]+|\[[\w-]+(?:=(?:\"[^\"\]]*\"|[^\"\]]*))?\])*)")
_PART = re.compile(r"[.#][\w-]+|\[[^\]]+\]")


class Compound:
    """One element test: tag, id, classes, attributes."""

    __slots__ = ("tag", "classes", "attrs")

    def __init__(self, text: str):
        m = _COMPOUND.fullmatch(text)
        if not text or not m:
            raise ValueError(f"selector not supported: {text!r}")
        self.tag = None if m["tag"] in (None, "*") else m["tag"].lower()
        self.classes, self.attrs = [], []
        for part in _PART.findall(m["rest"]):
            if part[0] == ".":
                self.classes.append(part[1:])
            elif part[0] == "#":
                self.attrs.append(("id", part[1:]))
            else:
                name, eq, value = part[1:-1].partition("=")
                self.attrs.append((name, value.strip('"') if eq else None))

    def fits(self, attrs: dict[str, str]) -> bool:
        if self.classes:
            own = (attrs.get("class") or "").split()
            if not all(c in own for c in self.classes):
                return False
        return all(name in attrs and (value is None or attrs[name] == value) for name, value in self.attrs)


class Selectors:
    """Named selectors: compounds joined by blanks (descendants), alternatives by commas.  Anything else raises when they are made.

    A chain of k compounds has k bits; bit j is set at an element if the first j + 1 compounds fit a path of elements that ends in it or above.  So one look at
    the parent's bits and at the tests for the element's tag tells which selectors the element meets.
    """

    def __init__(self, **named: str | None):
        self.named = {name: text for name, text in named.items() if text}
        self.by_tag: dict[str | None, list[tuple[Compound, int, int, str | None]]] = {}
        bit = 0
        for name, text in self.named.items():
            for alternative in re.split(r",(?![^\[]*\])", text):
                chain = [Compound(c) for c in re.findall(r"(?:\[[^\]]*\]|\S)+", alternative)]
                if not chain:
                    raise ValueError(f"selector not supported: {text!r}")
                for j, compound in enumerate(chain):
                    need = 1 << (bit + j - 1) if j else 0
                    self.by_tag.setdefault(compound.tag, []).append((compound, need, 1 << (bit + j), name if j == len(chain) - 1 else None))
                bit += len(chain)

        self.any_tag = tuple(self.by_tag.get(None, ()))
        self.tests = {tag: (*tests, *self.any_tag) for tag, tests in self.by_tag.items() if tag is not None}

    def step(self, above: int, tag: str, attrs: dict[str, str]) -> tuple[int, list[str]]:
        """(bits of the element, names of the selectors it meets)."""
        bits, met = above, []
        for compound, need, own, name in self.tests.get(tag, self.any_tag):
            if above & need == need and compound.fits(attrs):
                bits |= own
                if name is not None and name not in met:
                    met.append(name)
        return bits, met


@cache
def selectors(**named: str | None) -> Selectors:
    return Selectors(**named)


class Page(HTMLParser):
    """Elements in document order as arrays: ``tags``, ``attrs``, ``parent`` and the end of each one's descendants and texts."""

    def __init__(self, html: str, wanted: Selectors):
        super().__init__(convert_charrefs=True)
        self.wanted = wanted
        self.tags, self.attrs, self.parent, self.last, self.text_from, self.text_to = [], [], [], [], [], []
        self.texts: list[str] = []
        self.hits: dict[str, list[int]] = {name: [] for name in wanted.named}
        self._open: list[tuple[int, int]] = []  # (element, bits)
        self._count: defaultdict[str, int] = defaultdict(int)  # open elements by tag
        self._hidden = 0  # open elements whose text is not shown
        self.feed(html)
        self.close()
        for node, _ in self._open:
            self.last[node], self.text_to[node] = len(self.tags), len(self.texts)

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns are not needed."""
        return j

    def parse_starttag(self, i: int) -> int:
        """A run of tags without attributes takes a short way to what the standard tokenizer makes of it."""
        plain, end = _PLAIN_TAG.match(self.rawdata, i), i
        while plain is not None and (tag := plain[1].lower()) not in _RAW_TEXT:
            self.lasttag, end = tag, plain.end()
            self.handle_starttag(tag, ())
            plain = _PLAIN_TAG.match(self.rawdata, end)
        return end if end > i else super().parse_starttag(i)

    def _add(self, tag: str, attrs: Sequence) -> tuple[int, int]:
        parent, above = self._open[-1] if self._open else (-1, 0)
        node, texts, own = len(self.tags), len(self.texts), {k: v or "" for k, v in attrs} if attrs else {}
        bits = above
        if tag in self.wanted.tests or self.wanted.any_tag:
            bits, met = self.wanted.step(above, tag, own)
            for name in met:
                self.hits[name].append(node)
        self.tags.append(tag)
        self.attrs.append(own)
        self.parent.append(parent)
        self.last.append(node + 1)
        self.text_from.append(texts)
        self.text_to.append(texts)
        return node, bits

    def _pop(self) -> None:
        node, _ = self._open.pop()
        tag = self.tags[node]
        self._count[tag] -= 1
        self._hidden -= tag in _HIDDEN
        self.last[node], self.text_to[node] = len(self.tags), len(self.texts)

    def _li_open(self) -> bool:
        """Whether a list item is open inside the innermost list."""
        for node, _ in reversed(self._open):
            if self.tags[node] in ("li", "ul", "ol"):
                return self.tags[node] == "li"
        return False

    def handle_starttag(self, tag: str, attrs: Sequence) -> None:
        if tag == "li" and self._count["li"] and self._li_open():
            self.handle_endtag("li")
        entry = self._add(tag, attrs)
        if tag not in _VOID:
            self._open.append(entry)
            self._count[tag] += 1
            self._hidden += tag in _HIDDEN

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._add(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self._count[tag]:
            while self.tags[self._open[-1][0]] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data: str) -> None:
        if not self._hidden:
            self.texts.append(data)

    # --- an element's parts -----------------------------------------------------------------------------------------
    def text(self, node: int) -> str:
        return " ".join(" ".join(self.texts[self.text_from[node]:self.text_to[node]]).split())

    def lines(self, node: int) -> list[str]:
        flat = "\n".join(self.texts[self.text_from[node]:self.text_to[node]]).split("\n")
        return [x for x in (" ".join(line.split()) for line in flat) if x]

    def all(self, name: str, node: int | None = None) -> list[int]:
        """Elements that meet a selector, below ``node`` or in the whole page; none for a selector that was not given."""
        found = self.hits.get(name, [])
        return found if node is None else found[bisect_right(found, node):bisect_left(found, self.last[node])]

    def first(self, name: str, node: int) -> int | None:
        found = self.hits.get(name, [])
        i = bisect_right(found, node)
        return found[i] if i < len(found) and found[i] < self.last[node] else None


def visible_text(html: str) -> str:
    page = Page(html, selectors(body="body"))
    body = page.all("body")
    return page.text(body[0]) if body else " ".join(" ".join(page.texts).split())
