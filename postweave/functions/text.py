"""Text keys and text clean-up, as Column expressions that stay inside the JVM."""

from __future__ import annotations

import html as _html
import re
import unicodedata
from collections.abc import Iterable, Sequence
from functools import lru_cache
from html.entities import html5
from zlib import crc32

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as V
from .binding import let

NON_WORD = r"[^\p{L}\p{N}_]+"


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """Arguments of ``translate`` that decompose a text and drop its marks, derived from the Unicode tables.

    Characters that decompose to exactly one non-mark character are replaced, combining marks are deleted.  Those that become several
    characters (ligatures, fractions, numerals) are in :func:`_unfolding`.
    """
    source, target, dropped = [], [], []
    for code in (*range(0xA0, 0xAC00), *range(0xF900, 0x10000)):  # all scripts but Hangul, whose syllables stay whole
        ch = chr(code)
        if unicodedata.combining(ch):
            dropped.append(ch)
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base != ch:
            source.append(ch)
            target.append(base)
    return "".join(source + dropped), "".join(target)


def literal_map(table: dict[str, str]) -> Column:
    """A constant map as one literal, which Spark builds once (thousands of literals would slow down planning)."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in table.items())), F.lit("\x01"), F.lit("\x02"))


@lru_cache(maxsize=1)
def _unfolding() -> dict[str, str]:
    """Characters that decompose to several, with what they become."""
    out = {}
    for code in (*range(0xA0, 0xAC00), *range(0xF900, 0x10000)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) > 1 and len(base) <= 18:
            out[chr(code)] = base
    return out


def _ranges(codes: list[int], gap: int = 6) -> list[tuple[int, int]]:
    """Few ranges that hold all codes (and some between them), since a pattern tests them one by one."""
    out: list[tuple[int, int]] = []
    for code in codes:
        if out and code - out[-1][1] <= gap:
            out[-1] = (out[-1][0], code)
        else:
            out.append((code, code))
    return out


def _unfold(c: Column) -> Column:
    """Several-character decompositions.  Few texts have any, and those have few kinds: one replacement per kind that occurs."""
    table = _unfolding()
    kinds = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _ranges(sorted(map(ord, table)))) + "]"
    known = literal_map(table)
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(f"({kinds})"), F.lit(1)))
    return F.when(c.rlike(kinds), F.aggregate(found, c, lambda acc, k: F.replace(acc, k, F.coalesce(F.try_element_at(known, k), k)))).otherwise(c)


def normalize_text(c: Column) -> Column:
    """Lower case, no accents, compatibility forms taken apart, runs of anything but letters, digits and ``_`` become one space; null gives ''."""
    text = F.coalesce(c, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)  # ASCII has nothing to take apart
    folded = F.when(plain, text).otherwise(F.translate(let(text, _unfold), *_folding()))
    return F.trim(F.regexp_replace(F.lower(folded), NON_WORD, " "))


@F.pandas_udf(T.StringType())
def normalize_text_exact(texts: pd.Series) -> pd.Series:
    """The same with full compatibility decomposition, for scripts and ligatures ``translate`` cannot express."""
    decomposed = texts.fillna("").map(
        lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower())
    return decomposed.str.replace(r"[^\w]+", " ", regex=True).str.strip()


def fuzzy_company(c: Column) -> Column:
    """Company key: initials glued together, legal forms and connectors dropped, no spaces."""
    glued = F.aggregate(
        F.split(normalize_text(c), " "), F.lit(""),
        lambda acc, tok: F.when(acc.rlike(r"(^| )\p{L}{1,3}$") & tok.rlike(r"^\p{L}$"), F.concat(acc, tok))
        .when(acc == "", tok).otherwise(F.concat_ws(" ", acc, tok)))
    return F.array_join(F.filter(F.split(glued, " "), lambda t: ~t.isin(V.COMPANY_NOISE)), "")


def _may_overlap(phrases: Sequence[str]) -> bool:
    heads = {tuple(p.split()[:n]) for p in phrases for n in range(1, len(p.split()))}
    return any(tuple(p.split()[-n:]) in heads for p in phrases for n in range(1, len(p.split())))


def remove_phrases(c: Column, phrases: Iterable[str]) -> Column:
    """Remove word phrases, longest first.  One alternation is enough unless two phrases can overlap in a text."""
    ordered = sorted({p for p in phrases if p}, key=lambda p: (-len(p), p))
    if not ordered:
        return c
    groups = [[p] for p in ordered] if _may_overlap(ordered) else [ordered]
    for group in groups:
        body = "|".join(re.escape(p).replace(r"\ ", " ") for p in group)
        c = F.regexp_replace(c, rf"(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])", " ")
    return c


def fuzzy_title(c: Column, places: Sequence[str] = ()) -> Column:
    """Title key: the sorted set of words left without noise words, numbers and (normalised) place names."""
    single = [p for p in places if p and " " not in p]
    phrase = remove_phrases(normalize_text(c), [p for p in places if " " in p])
    words = F.split(F.trim(F.regexp_replace(phrase, r"\s+", " ")), " ")
    kept = F.filter(words, lambda w: (w != "") & ~w.isin([*V.TITLE_NOISE, *single]) & ~w.rlike(r"^\p{Nd}+$"))
    return F.array_join(F.array_sort(F.array_distinct(kept)), " ")


def posting_key(source_key: Column, native_id: Column) -> Column:
    return F.concat(source_key, F.lit(":"), native_id)


def job_id(key: Column) -> Column:
    """Short stable id of a posting key."""
    return F.substring(F.sha1(key), 1, 12)


def fingerprint(company: Column, title: Column, key: Column, places: Sequence[str] = ()) -> Column:
    """Identity of an offer across sources.  Without a company a posting only matches itself."""
    comp = fuzzy_company(company)
    base = F.when(comp != "", F.concat(comp, F.lit("|"), fuzzy_title(title, places))).otherwise(
        F.concat(key, F.lit("|"), normalize_text(title)))
    return F.substring(F.sha1(base), 1, 16)


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


_REFERENCE = r"(&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)"


_BUCKETS = 512  # of named references: a map's keys are compared one by one


@lru_cache(maxsize=1)
def _entities() -> str:
    """Named references with their semicolon, from the standard library's table: a text per bucket of their checksum, which ``str_to_map`` reads."""
    buckets: list[list[str]] = [[] for _ in range(_BUCKETS)]
    for name, value in html5.items():
        if name.endswith(";"):
            buckets[crc32(f"&{name}".encode()) % _BUCKETS].append(f"&{name}\x02{value}")
    return "\x03".join("\x01".join(b) for b in buckets)


def unescape(c: Column) -> Column:
    """Decode all named and numeric character references.  What they decode to is not read again: the ampersand's own come last."""
    buckets = F.split(F.lit(_entities()), "\x03")

    def named(ref: Column) -> Column:
        known = F.str_to_map(F.get(buckets, F.crc32(ref.cast("binary")) % _BUCKETS), F.lit("\x01"), F.lit("\x02"))
        return F.coalesce(F.try_element_at(known, ref), ref)

    def numbered(ref: Column) -> Column:
        code = F.when(F.lower(F.substring(ref, 3, 1)) == "x", F.conv(F.regexp_extract(ref, "^&#[xX]([0-9A-Fa-f]+);$", 1), 16, 10)).otherwise(
            F.regexp_extract(ref, "^&#([0-9]+);$", 1)).try_cast("int")
        return let(code, lambda n: F.when((n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
                   .otherwise(F.lit("\ufffd")))

    def all_of(text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(1)))
        pairs = F.transform(found, lambda r: F.struct(r.alias("ref"), F.when(r.startswith("&#"), numbered(r)).otherwise(named(r)).alias("char")))
        decoded = let(pairs, lambda all_: F.aggregate(F.concat(F.filter(all_, lambda p: p["char"] != "&"), F.filter(all_, lambda p: p["char"] == "&")), text,
                                                      lambda acc, p: F.replace(acc, p["ref"], p["char"])))
        return F.when(text.contains("&"), decoded).otherwise(text)
    return let(c, all_of)


def html_to_text(c: Column, limit: int | None = None) -> Column:
    """Visible text of a fragment or page: scripts, styles and comments gone, tags become spaces, spaces collapsed.

    Whole-expression JVM version for the common entities; :func:`html_to_text_exact` knows all of them.
    """
    def without_tags(raw: Column) -> Column:
        body = F.regexp_replace(raw, r"(?is)^.*?<body[^>]*>", "")
        body = F.regexp_replace(body, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
        body = F.regexp_replace(body, r"(?s)<!--.*?-->", " ")
        return F.when(raw.contains("<"), F.regexp_replace(body, r"<[^>]*>", " ")).otherwise(raw)

    raw = let(F.coalesce(c, F.lit("")), lambda x: F.when(~x.contains("<") & x.contains("&lt;"), unescape(x)).otherwise(x))
    text = collapse_spaces(unescape(let(raw, without_tags)))
    return F.substring(text, 1, limit) if limit else text


@F.pandas_udf(T.StringType())
def html_to_text_exact(values: pd.Series) -> pd.Series:
    """The same with a real tokenizer and every entity."""
    from ..sources.markup import visible_text

    def one(value: str | None) -> str:
        if not value:
            return ""
        if "<" not in value and "&lt;" in value:
            value = _html.unescape(value)
        return visible_text(value) if "<" in value else " ".join(_html.unescape(value).split())

    return values.map(one)


def unwrap_cdata(c: Column) -> Column:
    """``<![CDATA[x]]>`` becomes the escaped text x."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(<!\[CDATA\[.*?\]\]>|.+?(?=<!\[CDATA\[|$))"), F.lit(1))

    def one(part: Column) -> Column:
        inner = F.regexp_extract(part, r"(?s)^<!\[CDATA\[(.*)\]\]>$", 1)
        return F.when(part.startswith("<![CDATA["), xml_escape(inner)).otherwise(part)

    return F.array_join(F.transform(parts, one), "")


def slug(c: Column) -> Column:
    return F.replace(normalize_text(c), F.lit(" "), F.lit("-"))


def slugify(c: Column) -> Column:
    ascii_only = F.trim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(ascii_only == "", F.lit("source")).otherwise(ascii_only)


def route_slug(c: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}_-]+", "-"), F.lit("-")), 1, 100)


def text_part(c: Column, pattern: str | None) -> Column:
    """The matched groups joined by spaces, else the whole match, else ''; no pattern keeps the text."""
    if not pattern:
        return c
    groups = re.compile(pattern).groups
    if not groups:
        return F.regexp_extract(c, pattern, 0)
    found = [F.regexp_extract(c, pattern, i) for i in range(1, groups + 1)]
    return F.concat_ws(" ", *[F.when(g != "", g) for g in found])


def is_title(c: Column) -> Column:
    """3 to 150 characters and not the label of a button."""
    bare = F.regexp_replace(c, r"^[ .:›>»]+|[ .:›>»]+$", "")
    return F.length(c).between(3, 150) & ~bare.rlike("(?iu)" + V.GENERIC_LINK_TEXT)


def split_company_location(lines: Column, title: Column) -> Column:
    """Struct (company, location, rest) from the lines around a title."""
    rest = F.filter(lines, lambda x: (x != title) & is_title(x) & (F.length(x) <= 120))
    first, second = F.get(rest, F.lit(0)), F.get(rest, F.lit(1))

    def struct(company: Column, location: Column, start: int) -> Column:
        tail = F.when(F.size(rest) >= start, F.slice(rest, start, F.size(rest))).otherwise(F.array().cast("array<string>"))
        return F.struct(company.alias("company"), location.alias("location"), tail.alias("rest"))

    out = F.when(F.size(rest) == 0, struct(F.lit(""), F.lit(""), 1))
    for sep in V.COMPANY_LOCATION_SEPARATORS:
        at = F.instr(first, sep)
        out = out.when(at > 0, struct(F.trim(F.substring(first, F.lit(1), at - 1)),
                                      F.trim(F.substring(first, at + len(sep), F.length(first))), 2))
    return out.otherwise(struct(first, F.coalesce(second, F.lit("")), 3))


def plain_text_blocks(text: Column) -> Column:
    """Blocks of a plain-text alert: lines gather until a line with URLs closes the block.

    Array of (title, rest, url), one element per URL.  A fold inside the row: no explode, no shuffle.
    """
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), collapse_spaces)
    empty = F.array().cast("array<string>")
    blocks = F.array().cast("array<struct<title:string,rest:array<string>,url:string>>")

    def step(acc: Column, line: Column) -> Column:
        urls = F.regexp_extract_all(line, F.lit(f"({V.BARE_URL})"), F.lit(1))
        lines_so_far = acc["chunk"]
        title = F.coalesce(F.get(lines_so_far, F.lit(0)), F.lit(""))
        rest = F.when(F.size(lines_so_far) > 1, F.slice(lines_so_far, 2, F.size(lines_so_far))).otherwise(empty)
        found = F.transform(urls, lambda u: F.struct(
            title.alias("title"), rest.alias("rest"), F.regexp_replace(u, r"[.,;]+$", "").alias("url")))
        has_url = F.size(urls) > 0
        chunk = F.when(has_url, empty).when(line != "", F.concat(lines_so_far, F.array(line))).otherwise(lines_so_far)
        done = F.when(has_url, F.concat(acc["blocks"], found)).otherwise(acc["blocks"])
        return F.struct(chunk.alias("chunk"), done.alias("blocks"))

    return F.aggregate(lines, F.struct(empty.alias("chunk"), blocks.alias("blocks")), step, lambda acc: acc["blocks"])


def extract_experience(c: Column) -> Column:
    """Struct (lo, hi, label): a stated range of years, else a stated minimum, else nulls.

    A number is cast only where its pattern is found: the cast of an empty text raises and catches an error, for each row and use.
    """
    text = F.coalesce(c, F.lit(""))
    rng, least = "(?iu)" + V.EXPERIENCE_RANGE, "(?iu)" + V.EXPERIENCE_MIN

    def number(pattern: str, group: int) -> Column:
        return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group)).try_cast("int")

    lo, hi, least_lo = number(rng, 1), number(rng, 2), number(least, 1)

    def struct(a: Column, b: Column, label: Column) -> Column:
        return F.struct(a.alias("lo"), b.alias("hi"), label.alias("label"))

    return (
        F.when((lo > 0) & (lo <= hi) & (hi <= V.EXPERIENCE_LIMIT),
               struct(lo, hi, F.concat(lo.cast("string"), F.lit("-"), hi.cast("string"))))
        .when((least_lo > 0) & (least_lo <= V.EXPERIENCE_LIMIT),
              struct(least_lo, F.lit(None).cast("int"), F.concat(least_lo.cast("string"), F.lit("+"))))
        .otherwise(struct(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("string"))))


def location_text(locations: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(locations, lambda x: x.isNotNull() & (x != ""))), " · ")


def xml_escape(c: Column) -> Column:
    for ch, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(ch), F.lit(entity))
    return c


def md_cell(c: Column) -> Column:
    return F.replace(F.replace(c.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def md_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(md_cell(c), F.lit("")) for c in cells]), F.lit(" |"))
