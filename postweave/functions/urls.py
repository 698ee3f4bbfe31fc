"""URL keys as Column expressions.  Every URL is split by the generic pattern of RFC 3986, so nothing can raise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from .binding import let

GENERIC = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SCHEME, HOST, PATH, QUERY, FRAGMENT = 1, 2, 3, 4, 5


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), GENERIC, group)


def decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(query: Column, keep_blank: bool) -> Column:
    """Array of decoded (k, v) structs in order of appearance."""
    def pair(token: Column) -> Column:
        at = F.instr(token, "=")
        name = F.when(at > 0, F.substring(token, F.lit(1), at - 1)).otherwise(token)
        value = F.when(at > 0, F.substring(token, at + 1, F.length(token))).otherwise(F.lit(""))
        return F.struct(decode(name).alias("k"), decode(value).alias("v"))

    tokens = F.filter(F.split(query, "&"), lambda t: t != "")
    pairs = F.transform(tokens, pair)
    return pairs if keep_blank else F.filter(pairs, lambda p: p["v"] != "")


def _encoded(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&")


def _not_tracking(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: ~p["k"].rlike("(?i)" + V.TRACKING_PARAM))


def canonical_url(url: Column) -> Column:
    """Key of a URL: host without ``www.``, path without trailing slash, sorted query without click tracking."""
    host = F.regexp_replace(F.lower(part(url, HOST)), r"^www\.", "")
    path = F.regexp_replace(part(url, PATH), "/+$", "")
    query = _encoded(F.array_sort(_not_tracking(query_pairs(part(url, QUERY), keep_blank=False))))
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def strip_tracking(url: Column) -> Column:
    """The URL without tracking parameters and fragment; order, scheme and host stay."""
    query = _encoded(_not_tracking(query_pairs(part(url, QUERY), keep_blank=True)))
    scheme = F.lower(part(url, SCHEME))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(part(url, HOST) != "", F.concat(F.lit("//"), part(url, HOST))).otherwise(F.lit("")),
        part(url, PATH), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _unquote(c: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone."""
    return decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def unwrap_redirect(url: Column) -> Column:
    """The target of click-tracking wrappers, up to four levels deep."""
    def step(current: Column, _: Column) -> Column:
        pairs = query_pairs(part(current, QUERY), keep_blank=True)
        # A name given twice has the place of its first and the value of its last appearance.
        settled = F.transform(pairs, lambda p: F.struct(
            p["k"].alias("k"), F.element_at(F.filter(pairs, lambda o: o["k"] == p["k"]), -1)["v"].alias("v")))
        target = F.get(F.filter(settled, lambda p: F.lower(p["k"]).isin(V.REDIRECT_PARAMS)
                                & _unquote(p["v"]).rlike("^https?://")), F.lit(0))["v"]
        return let(target, lambda t: F.when(t.isNull() | (t == ""), current)
                    .when(F.upper(t).contains("%2F"), _unquote(t)).otherwise(t))

    levels = F.sequence(F.lit(1), F.lit(V.REDIRECT_DEPTH))
    return F.when(url.contains("?"), F.aggregate(levels, url, step)).otherwise(url)


def _without_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/")
    empty = F.array().cast("array<string>")

    def step(acc: Column, seg: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        return F.when(seg == "..", up).when(seg == ".", acc).otherwise(F.concat(acc, F.array(seg)))

    folded = F.aggregate(segments, empty, step)
    ends_open = path.rlike(r"/\.{1,2}$")
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"),
                  F.concat(F.array_join(folded, "/"), F.when(ends_open, F.lit("/")).otherwise(F.lit("")))).otherwise(path)


def absolute_url(base: Column, href: Column) -> Column:
    """RFC 3986 reference resolution of ``href`` against an absolute ``base``."""
    href = F.coalesce(F.trim(href), F.lit(""))
    origin = F.concat(part(base, SCHEME), F.lit("://"), part(base, HOST))
    base_path = part(base, PATH)
    query = F.when(href.rlike(r"^[^#]*\?"), F.concat(F.lit("?"), part(href, QUERY))).otherwise(F.lit(""))
    base_query = F.when(base.rlike(r"^[^#]*\?"), F.concat(F.lit("?"), part(base, QUERY))).otherwise(F.lit(""))
    fragment = F.when(href.contains("#"), F.concat(F.lit("#"), part(href, FRAGMENT))).otherwise(F.lit(""))
    tail = F.concat(query, fragment)
    folder = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_replace(base_path, "[^/]*$", ""))
    return (
        F.when(href == "", base)
        .when(part(href, SCHEME) != "", href)
        .when(href.startswith("//"), F.concat(part(base, SCHEME), F.lit("://"), part(href, HOST),
                                              _without_dots(part(href, PATH)), tail))
        .when(href.startswith("/"), F.concat(origin, _without_dots(part(href, PATH)), tail))
        .when(href.startswith("?"), F.concat(origin, base_path, tail))
        .when(href.startswith("#"), F.concat(origin, base_path, base_query, fragment))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, part(href, PATH))), tail)))
