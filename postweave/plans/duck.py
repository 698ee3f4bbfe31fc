"""Fragments of the SQL twins.  They are written for another engine and share no code with the operators."""

from __future__ import annotations

from .. import fixed_values as F


def words(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents(coalesce({c}, ''))), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def fuzzy_company(c: str) -> str:
    glued = (f"list_reduce(string_split({norm(c)}, ' '), lambda acc, x: CASE WHEN "
             "regexp_matches(acc, '(^| )\\p{L}{1,3}$') AND regexp_matches(x, '^\\p{L}$') THEN acc || x "
             "ELSE acc || ' ' || x END)")
    return (f"array_to_string([t FOR t IN string_split({glued}, ' ') IF t NOT IN ({words(F.COMPANY_NOISE)})], '')")


def fuzzy_title(c: str, places: str = "''") -> str:
    return (f"array_to_string(list_sort(list_distinct([w FOR w IN string_split({norm(c)}, ' ') IF w <> '' AND w NOT IN "
            f"({words(F.TITLE_NOISE)}) AND w NOT IN ({places}) AND NOT regexp_full_match(w, '[0-9]+')])), ' ')")


def fingerprint(company: str, title: str, key: str, places: str = "''") -> str:
    fc = fuzzy_company(company)
    return (f"substr(sha1(CASE WHEN {fc} <> '' THEN {fc} || '|' || {fuzzy_title(title, places)} "
            f"ELSE {key} || '|' || {norm(title)} END), 1, 16)")


GENERIC = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_part(c: str, group: int) -> str:
    return f"regexp_extract({c}, '{GENERIC}', {group})"


def _pairs(query: str, keep_blank: bool) -> str:
    dec = "url_decode(replace({0}, '+', ' '))"
    pairs = (f"[{{'k': {dec.format('split_part(t, ' + chr(39) + '=' + chr(39) + ', 1)')}, "
             f"'v': {dec.format('CASE WHEN contains(t, ' + chr(39) + '=' + chr(39) + ') THEN substr(t, instr(t, ' + chr(39) + '=' + chr(39) + ') + 1) ELSE ' + chr(39) * 2 + ' END')}}} "
             f"FOR t IN string_split({query}, '&') IF t <> '']")
    cond = f"NOT regexp_matches(p.k, '(?i){F.TRACKING_PARAM}')" + ("" if keep_blank else " AND p.v <> ''")
    return f"[p FOR p IN {pairs} IF {cond}]"


def _encoded(pairs: str) -> str:
    enc = "replace(url_encode({0}), '%20', '+')"
    return f"array_to_string([{enc.format('p.k')} || '=' || {enc.format('p.v')} FOR p IN {pairs}], '&')"


def canonical_url(c: str) -> str:
    host = f"regexp_replace(lower({url_part(c, 2)}), '^www\\.', '')"
    query = _encoded(f"list_sort({_pairs(url_part(c, 4), False)})")
    return (f"CASE WHEN {host} = '' THEN '' ELSE {host} || rtrim({url_part(c, 3)}, '/') || "
            f"CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END")


def strip_tracking(c: str) -> str:
    query = _encoded(_pairs(url_part(c, 4), True))
    return (f"lower({url_part(c, 1)}) || '://' || {url_part(c, 2)} || {url_part(c, 3)} || "
            f"CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END")


def html_text(c: str) -> str:
    body = f"regexp_replace({c}, '^.*?<body[^>]*>', '', 'is')"
    body = f"regexp_replace({body}, '<script\\b[^>]*>.*?</script\\s*>', ' ', 'gis')"
    body = f"regexp_replace({body}, '<style\\b[^>]*>.*?</style\\s*>', ' ', 'gis')"
    body = f"regexp_replace({body}, '<!--.*?-->', ' ', 'gs')"
    text = f"regexp_replace({body}, '<[^>]*>', ' ', 'g')"
    for entity, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"),
                       ("&nbsp;", " "), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"),
                       ("&eacute;", "é"), ("&copy;", "©"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{ch}')"
    return f"trim(regexp_replace({text}, '[\\s ]+', ' ', 'g'))"


def utc(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S+00:00')"
