"""Type of a source from its URL: the rule rows of ``fixed_values.SITE_RULES`` as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.urls import HOST, PATH, QUERY, part, query_pairs


def _param(url: Column, name: str) -> Column:
    return F.get(F.filter(query_pairs(part(url, QUERY), False), lambda p: F.lower(p["k"]) == name), F.lit(0))["v"]


def _taken(spec: str, url: Column, pattern: str) -> tuple[Column, Column | None]:
    """The value a rule takes, and a condition that must hold for the rule to fit."""
    host = part(url, HOST)
    label = F.substring_index(host, ".", 1)
    kind, _, rest = spec.partition(":")
    if spec.startswith("="):
        return F.lit(spec[1:]), None
    if kind == "path":
        return F.regexp_extract(part(url, PATH), pattern, int(rest)), None
    if kind == "query":
        name, _, instead = rest.partition("|")
        value = _param(url, name)
        return (F.coalesce(value, F.concat(label, F.lit(instead.removeprefix("label")))), None) if instead else (value, value.isNotNull())
    return (label if spec == "label" else host), None


def detect_source_type(url: Column) -> Column:
    """Struct (type, params); null type when no rule matches."""
    out = []
    for kind, host, path, takes in V.SITE_RULES:
        fits = part(url, HOST).rlike(host) if host else F.lit(True)
        if path:
            fits = fits & part(url, PATH).rlike(path)
        items = []
        for name, spec in takes.items():
            value, needed = _taken(spec, url, path)
            fits = fits if needed is None else fits & needed
            items += [F.lit(name), value]
        out.append(F.when(fits, F.struct(F.lit(kind).alias("type"), F.create_map(*items).alias("params"))))
    return F.coalesce(*out)


def resolve_type(explicit: Column, url: Column) -> Column:
    """An explicit type wins over the detected one."""
    return F.coalesce(explicit, detect_source_type(url)["type"])
