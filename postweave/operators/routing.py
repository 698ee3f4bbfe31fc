"""Which route gets which postings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import normalize_text
from .keywords import normalize_word

DEFAULT = "(default)"


@dataclass(frozen=True)
class Routes:
    """Route names; None where a route is not configured (``other`` then is the default route)."""

    summary: str | None = None
    highlights: str | None = None
    other: str | None = None
    places: Mapping[str, str] = field(default_factory=dict)
    highlight_score: int = 80

    @property
    def catch_all(self) -> str:
        return self.other or DEFAULT


def place_route(target: Column, routes: Routes) -> Column:
    """Route of a place by its normalised name, else null."""
    if not routes.places:
        return F.lit(None).cast("string")
    table = F.create_map(*[F.lit(x) for place, route in routes.places.items() for x in (normalize_word(place), route)])
    return F.try_element_at(table, normalize_text(target))


def routing_plan(postings: DataFrame, routes: Routes, n_postings: str = "pos") -> DataFrame:
    """(route, kind, key, pos, route_pos): every posting in the index, its highlight route and its place or other route.

    Expects key, pos (order in the notification), grp, target, highlight.  A route never gets a key twice within a
    notification and keeps the kind of its first use: highlights come before places, places and other by position.
    One explode of an array of at most three routes per posting; no join.
    """
    def row(route: Column | str, kind: str, step: int) -> Column:
        route = F.lit(route) if isinstance(route, str) else route
        return F.struct(route.alias("route"), F.lit(kind).alias("kind"), F.lit(step).alias("step"))

    to_place = place_route(F.col("target"), routes)
    normal = F.when(to_place.isNotNull(), row(to_place, "place", 1)).otherwise(row(routes.catch_all, "other", 1))
    special = F.when(F.col("highlight"), row(routes.highlights, "highlights", 0)) if routes.highlights else None
    cards = postings.select("grp", "key", n_postings, F.inline(F.array_compact(F.array(*[c for c in (special, normal) if c is not None]))))
    order = F.struct("step", n_postings)
    once = cards.groupBy("grp", "route", "key").agg(F.min(F.struct("step", n_postings, "kind")).alias("_r"))
    once = once.select("grp", "route", "key", F.col("_r.step").alias("step"), F.col(f"_r.{n_postings}").alias(n_postings), F.col("_r.kind").alias("kind"))
    first = once.groupBy("grp", "route").agg(F.min_by("kind", order).alias("kind"))
    plan = once.drop("kind").join(first, ["grp", "route"])
    plan = plan.select("grp", "route", "kind", "key", "step", n_postings)
    if routes.summary:
        index = postings.select("grp", F.lit(routes.summary).alias("route"), F.lit("summary").alias("kind"), "key", F.lit(0).alias("step"), n_postings)
        plan = index.unionByName(plan)
    return plan


def shown_per_route(plan: DataFrame, max_items: int, n_postings: str = "pos") -> DataFrame:
    """Each route keeps its own cap; the index lists all, up to its own limit.  Limits apply before the shuffle."""
    w = Window.partitionBy("grp", "kind", "route").orderBy("step", n_postings)
    most = max(max_items, V.SUMMARY_ROUTE_JOBS)
    ranked = plan.withColumn("route_pos", F.row_number().over(w)).filter(F.col("route_pos") <= most)
    cap = F.when(F.col("kind") == "summary", V.SUMMARY_ROUTE_JOBS).otherwise(max_items)
    return ranked.filter(F.col("route_pos") <= cap)


def warning_carriers(groups: DataFrame, routes: Routes) -> DataFrame:
    """(grp, route, kind): the route that carries health warnings, reports and empty results: the index, else the
    catch-all, even when it has no posting of its own."""
    route, kind = (routes.summary, "summary") if routes.summary else (routes.catch_all, "other")
    return groups.select("grp", F.lit(route).alias("route"), F.lit(kind).alias("kind"))
