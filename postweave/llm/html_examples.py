"""Labelled pages for the extractor: own layouts with own words, made by rule.  Elements that start an article carry data-y="1", elements
that start something else inside it data-y="0"; the marks are taken off before the pages are parsed."""

from __future__ import annotations

import random
import re

_WORDS = """harbour winter council garden evening signal river market copper village letter student window bridge morning engine island summer
paper forest teacher history station number picture weather season question answer company machine captain valley museum kitchen journey
people water music science small open early bright quiet rapid steady local modern simple certain public and the of to in with from for""".split()
_CONTENT = ["content", "main-content", "article-body", "post", "entry-content", "story", "post-content", "text", "article", "body-copy", "page-content", "blog-post", "prose", "single"]
_MENUS = ["menu", "nav", "navbar", "main-menu", "navigation", "breadcrumbs", "topbar", "links", "toc-menu", "tabs"]
_HEADS = ["header", "site-header", "masthead", "banner", "logo", "top", "branding"]
_FEET = ["footer", "site-footer", "bottom", "copyright", "legal", "foot"]
_SIDES = ["sidebar", "aside", "widget", "related", "recommended", "most-read", "trending", "popular", "tags", "rail"]
_ADS = ["ad", "ads", "advert", "sponsored", "promo", "adbox", "advertisement", "banner-ad", "sponsor", "promotion"]
_NOTES = ["cookie", "cookie-notice", "notice", "gdpr", "consent", "alert", "popup", "newsletter", "subscribe", "modal", "paywall", "message", "cookie-banner"]
_TALK = ["comments", "comment-list", "discussion", "replies", "disqus", "responses", "reader-comments", "comment"]
_SHARES = ["share", "social", "share-buttons", "byline-links", "follow", "print-tools"]
_PLAIN = ["container", "wrapper", "row", "col", "inner", "section", "box", "block", "x1", "layout", "grid", "page"]


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(_WORDS) for _ in range(self.r.randint(low, high)))

    def sentences(self, n: int) -> str:
        return " ".join(self.words(4, 18).capitalize() + self.r.choice(".....?!") for _ in range(n))

    def attrs(self, names: list[str], tag_too: bool = False) -> str:
        name = self.r.choice(names)
        return self.r.choice([f' class="{name}"', f' id="{name}"', f' class="{self.r.choice(_PLAIN)} {name}"', f" class='{name}'"] + [""] * (1 if tag_too else 0))

    def listed(self, n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(n)) + "</ul>"

    def menu(self) -> str:
        n = self.r.randint(3, 9)
        return self.r.choice([f"<nav{self.attrs(_MENUS, True)}>{self.listed(n)}</nav>", f"<div{self.attrs(_MENUS)}>{self.listed(n)}</div>",
                              f"<div{self.attrs(_MENUS)}>" + " | ".join(f'<a href="#">{self.words(1, 2)}</a>' for _ in range(n)) + "</div>"])

    def head(self) -> str:
        inside = self.r.choice([f"<h1>{self.words(1, 3)}</h1>", f'<a href="/">{self.words(1, 3)}</a><p>{self.words(2, 6)}</p>', f"<span>{self.words(1, 4)}</span>", self.menu()])
        return self.r.choice([f"<header{self.attrs(_HEADS, True)}>{inside}</header>", f"<div{self.attrs(_HEADS)}>{inside}</div>"])

    def foot(self) -> str:
        inside = self.r.choice([f"&copy; {self.words(1, 4)}. {self.sentences(1)}", f"<p>{self.words(3, 9)} &middot; <a href='/'>{self.words(1, 2)}</a></p>", self.listed(4) + f"<p>{self.words(2, 8)}</p>"])
        return self.r.choice([f"<footer{self.attrs(_FEET, True)}>{inside}</footer>", f"<div{self.attrs(_FEET)}>{inside}</div>"])

    def side(self) -> str:
        inside = f"<h3>{self.words(1, 3)}</h3>" + self.r.choice([self.listed(self.r.randint(2, 6)), f"<p>{self.sentences(1)}</p>", "".join(f'<div><a href="#">{self.words(4, 9)}</a></div>' for _ in range(4)), f"<p>{self.sentences(3)}</p>"])
        return self.r.choice([f"<aside{self.attrs(_SIDES, True)}>{inside}</aside>", f"<div{self.attrs(_SIDES)}>{inside}</div>", f"<section{self.attrs(_SIDES)}>{inside}</section>"])

    def ad(self) -> str:
        inside = self.r.choice([self.words(3, 12), self.sentences(self.r.randint(1, 3)), f'<a href="#">{self.words(3, 8)}</a>', f"<p>{self.sentences(2)}</p><a href='#'>{self.words(1, 2)}</a>"])
        return f"<{(t := self.r.choice(['div', 'div', 'section', 'aside', 'p']))}{self.attrs(_ADS)}>{inside}</{t}>"

    def note(self) -> str:
        inside = self.r.choice([f"<p>{self.sentences(2)}</p><button>{self.words(1, 2)}</button>", self.sentences(1), f"<p>{self.sentences(1)} <a href='#'>{self.words(1, 2)}</a></p>",
                                f"<form><label>{self.words(1, 3)}</label><input type=text><button>{self.words(1, 1)}</button></form>"])
        return f"<{(t := self.r.choice(['div', 'div', 'section', 'aside']))}{self.attrs(_NOTES)}>{inside}</{t}>"

    def form(self) -> str:
        return f"<form action='/s'><p>{self.words(2, 6)}</p><label>{self.words(1, 3)} <input name=q></label><button>{self.words(1, 2)}</button></form>"

    def talk(self) -> str:
        one = self.r.choice([lambda: f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.sentences(self.r.randint(1, 4))}</p></div>', lambda: f"<li><p>{self.words(1, 2)}</p><p>{self.sentences(self.r.randint(1, 3))}</p></li>",
                             lambda: f"<article class='comment'><p>{self.sentences(self.r.randint(1, 4))}</p></article>"])
        inside = "".join(one() for _ in range(self.r.randint(1, 5)))
        tag = self.r.choice(["div", "section", "ul", "ol", "aside"])
        return f"<{tag}{self.attrs(_TALK)}>{self.r.choice(['', f'<h2>{self.words(1, 2)}</h2>'])}{inside}</{tag}>"

    def share(self) -> str:
        return f"<div{self.attrs(_SHARES)}>" + "".join(f'<a href="#">{self.words(1, 1)}</a> ' for _ in range(self.r.randint(2, 5))) + "</div>"

    def waste(self) -> str:
        return self.r.choice([self.ad, self.note, self.side, self.form, self.share, self.menu])()

    def cut(self, made: str) -> str:
        """Marked as not part of the article around it."""
        at = min(i for i in (made.find(" "), made.find(">")) if i > 0)
        return made[:at] + ' data-y="0"' + made[at:]

    def odd(self) -> str:
        """Text that is no good prose: still part of the article."""
        words = self.words(3, 60).split()
        return self.r.choice([" | ".join(words), " ".join(w + self.r.choice(["***", "$$$", "%%%", "###", "!!", ""]) for w in words), " ".join(words), " ".join(words).upper(), " ".join([words[0]] * len(words))])

    def article(self) -> list[str]:
        style, parts = self.r.random(), [f"<h1>{self.words(2, 9)}</h1>"] if self.r.random() < 0.75 else []
        for _ in range(self.r.choice([1, 1, 2, 3, 4, 6, 8, 12, 20])):
            k = self.r.random()
            if k < 0.08:
                parts.append(f"<p>{self.odd()}</p>")
            elif k < 0.68:
                parts.append(f"<p>{self.sentences(self.r.choice([1, 1, 2, 3, 5, 7]))}</p>" if style < 0.8 else f"<div>{self.sentences(self.r.choice([1, 2, 4]))}</div>")
            elif k < 0.74:
                parts.append(f"<p>{self.words(1, 3).capitalize()}.</p>")
            elif k < 0.80:
                parts.append(f"<h2>{self.words(1, 6)}</h2>")
            elif k < 0.84:
                parts.append("<ul>" + "".join(f"<li>{self.words(2, 9)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif k < 0.88:
                parts.append(f"<blockquote><p>{self.sentences(2)}</p></blockquote>")
            elif k < 0.89:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 2)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif k < 0.895:
                parts.append(f"<p><b>{self.words(2, 6)}.<br><p>{self.sentences(2)}</p>")
            elif k < 0.91:
                parts.append(f'<p>{self.sentences(1)} <a href="/x">{self.words(1, 3)}</a> {self.sentences(1)}</p>')
            else:
                parts.append(self.cut(self.waste()))
        if self.r.random() < 0.12:
            parts.append(self.cut(self.talk()))
        return parts

    def page(self) -> str:
        parts = self.article()
        body = "".join(parts)
        kind = self.r.random()
        if kind < 0.08:  # no element around the article: its parts are marked themselves
            main = "".join(p if 'data-y="0"' in p else p.replace("<p>", '<p data-y="1">') if p.startswith("<p>") else re.sub(r"^<(\w+)", r'<\1 data-y="1"', p) for p in parts)
        elif kind < 0.35:
            main = f'<article{self.attrs(_CONTENT, True)} data-y="1">{body}</article>'
        elif kind < 0.5:
            main = f'<main data-y="1">{body}</main>'
        elif kind < 0.9:
            main = f'<{(t := self.r.choice(["div", "section", "td"]))}{self.attrs(_CONTENT)} data-y="1">{body}</{t}>'
        else:
            main = f'<div{self.attrs(_PLAIN)} data-y="1">{body}</div>'
        if main.startswith("<td"):
            main = f"<table><tr>{main}</tr></table>"
        some = lambda f, p: f() if self.r.random() < p else ""
        top = some(self.note, 0.2) + some(self.head, 0.6) + some(self.menu, 0.7) + some(self.ad, 0.4)
        end = some(self.share, 0.2) + some(self.side, 0.45) + some(self.ad, 0.25) + some(self.talk, 0.35) + some(self.form, 0.2) + some(self.foot, 0.85) + some(self.note, 0.15)
        if self.r.random() < 0.3:
            main = f"<main>{main}{some(self.side, 0.3)}{some(self.talk, 0.2)}</main>" if self.r.random() < 0.5 and "<main" not in main else f"<div{self.attrs(_PLAIN)}>{main}{some(self.side, 0.4)}</div>"
        page = f"<html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>{top}{main}{end}</body></html>"
        return page if self.r.random() < 0.8 else page.replace("<body>", f"<body><div{self.attrs(_PLAIN)}>").replace("</body>", "</div></body>")


def pages(number: int = 500, seed: int = 11) -> list[str]:
    return [_Maker(seed * 100_003 + i).page() for i in range(number)]
