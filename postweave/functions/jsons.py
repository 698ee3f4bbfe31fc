"""JSON values: safe access, templates, pruning, model replies."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

PLACEHOLDER = re.compile(r"\{(\w+)\}")
_PATH_PART = re.compile(r"([^.\[\]]+)|\[(-?\d+)\]")


def dig(value: Column, path: str, kind: str = "string") -> Column:
    """Value at ``a.b[0].c`` of a VARIANT, null wherever the path breaks.  Negative indexes count from the end."""
    pending = "$"
    for name, index in _PATH_PART.findall(path):
        if index and int(index) < 0:
            items = F.try_variant_get(value, pending, "array<variant>")
            value, pending = F.try_element_at(items, F.lit(int(index))), "$"
        elif index:
            pending += f"[{int(index)}]"
        else:
            pending += f"['{name}']" if not re.fullmatch(r"\w+", name) else f".{name}"
    return F.try_variant_get(value, pending, kind)


def as_list(value: Column, kind: str = "variant") -> Column:
    """An array stays, null becomes empty, a scalar becomes one element."""
    empty = F.array().cast("array<variant>")
    out = let(value, lambda v: F.when(v.isNull() | F.is_variant_null(v), empty).otherwise(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))
    return out if kind == "variant" else F.transform(out, lambda v: F.try_variant_get(v, "$", kind))


def render_template(template: str, values: Mapping[str, Column]) -> Column:
    """``{name}`` replaced by the value; an unknown name stays; a template that is one name keeps its type."""
    only = PLACEHOLDER.fullmatch(template)
    if only and only.group(1) in values:
        return values[only.group(1)]
    parts: list[Column] = []
    at = 0
    for m in PLACEHOLDER.finditer(template):
        parts.append(F.lit(template[at:m.start()]))
        known = values.get(m.group(1))
        parts.append(F.lit(m.group(0)) if known is None else F.coalesce(known.cast("string"), F.lit("")))
        at = m.end()
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def prune_nulls(**fields: Column) -> Column:
    """JSON text without null, '' and empty arrays: each field is nulled first, then ``to_json`` leaves it out."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))


def object_or_null(**fields: Column) -> Column:
    """A nested object, null if none of its fields has a value (so that ``prune_nulls`` leaves it out)."""
    return F.when(F.coalesce(*[F.when(c.isNotNull(), F.lit(True)) for c in fields.values()], F.lit(False)),
                  F.struct(*[c.alias(name) for name, c in fields.items()]))


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def null_if_no_items(c: Column) -> Column:
    return F.when(F.size(c) > 0, c)


def criteria_hash(criteria: Mapping[str, Any]) -> str:
    """12 hex digits of the canonical JSON of the criteria.  One value per run, so it is a literal."""
    return hashlib.sha1(json.dumps(criteria, sort_keys=True).encode()).hexdigest()[:12]


def parse_model_reply(text: Column) -> Column:
    """VARIANT array of results in a model reply; null for a reply without results.

    Code fences go first; a bare list is taken as the results; an object inside prose is rescued.
    """
    bare = F.trim(F.regexp_replace(F.trim(text), r"(?m)^```(?:json)?|```$", ""))
    whole = F.try_parse_json(bare)
    inner = F.try_parse_json(F.regexp_extract(bare, r"(?s)\{.*\}", 0))
    data = F.when(whole.isNotNull(), whole).otherwise(inner)
    listed = F.try_variant_get(data, "$", "array<variant>")
    return F.coalesce(listed, F.try_variant_get(data, "$.results", "array<variant>"))


def to_verdict(result: Column, families: list[str], experience_chars: int | None = None, reason_chars: int | None = None) -> Column:
    """Validated struct (score, family, front_office, experience, reason) of one result; the two texts are whole, or kept to a length."""
    def kept(text: Column, chars: int | None) -> Column:
        return text if chars is None else F.substring(text, 1, chars)

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(result, path, "variant"))

    score = F.coalesce(F.try_variant_get(result, "$.score", "string").try_cast("double"), F.lit(0.0))
    family = F.when(kind("$.family") == "STRING", dig(result, "family"))
    exp, reason = dig(result, "experience"), dig(result, "reason")
    whole = F.when(score >= 0, F.floor(score)).otherwise(F.ceil(score))
    return F.struct(
        F.greatest(F.lit(0), F.least(F.lit(100), whole)).cast("int").alias("score"),
        F.when(family.isin(families), family).alias("family"),
        F.when(kind("$.front_office") == "BOOLEAN", dig(result, "front_office", "boolean")).alias("front_office"),
        F.when(~exp.isin("", "null"), kept(exp, experience_chars)).alias("experience"),
        F.when(reason != "", kept(reason, reason_chars)).alias("reason"))
