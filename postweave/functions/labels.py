"""Localised labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as V


def label(name: str, lang: str = "en") -> str:
    return V.LABELS.get(lang, V.LABELS["en"]).get(name) or V.LABELS["en"][name]


def label_of(name: Column, lang: Column) -> Column:
    """Label of a message name in a language, English where the language has none, else the name itself."""
    def table(code: str) -> Column:
        return F.create_map(*[F.lit(x) for pair in V.LABELS[code].items() for x in pair])

    chosen = F.lit(None).cast("string")
    for code in V.LABELS:
        chosen = F.when(lang == code, F.try_element_at(table(code), name)).otherwise(chosen)
    return F.coalesce(chosen, F.try_element_at(table("en"), name), name)


def status_label(status: Column, lang: str = "en") -> Column:
    return F.when(status.isin(V.STATUSES), label_of(F.concat(F.lit("st_"), status), F.lit(lang))).otherwise(status)
