"""Search requests, stop rules, facets and configuration checks as data."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import at
from ..functions.jsons import as_list, dig, render_template
from ..functions.text import route_slug, slug


def expand_search_grid(queries: DataFrame, places: DataFrame, pages: int, coverage: DataFrame, coverage_pages: int,
                       url_template: str, limit: int = 20) -> DataFrame:
    """(query, place, page, url): every query of a source in every place of that source and page, and coverage queries
    without place and with fewer pages.

    Queries and places meet on their source (an equi-join), pages are exploded in place.
    """
    grid = queries.join(places, "source_key").select("source_key", "query", "place", F.lit(pages).alias("_n"))
    wide = coverage.select("source_key", "query", F.lit("").alias("place"), F.lit(coverage_pages).alias("_n"))
    rows = grid.unionByName(wide).withColumn("page", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    values = {"query": F.col("query"), "query_slug": slug(F.col("query")), "location": F.col("place"), "page": F.col("page"),
              "offset": (F.col("page") - 1) * limit, "limit": F.lit(limit)}
    return rows.select("source_key", "query", "place", "page", render_template(url_template, values).alias("url"))


def pages_until_cutoff(postings: DataFrame, now: datetime, max_age_days: float, page_size: int, rule: str = "any",
                       slack_days: float = 0.5, pages_read: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Pages a newest-first scan reads: up to and including the first that is short or empty, reaches the stated total, or holds old rows.

    ``pages_read``: (source_key, page_no) of all pages that were captured, so that one without any posting is known; ``totals``: (source_key, total) as
    the sources state them, null or missing where they don't.

    ``rule``: 'any' row older than the window, the 'oldest' row, or 'all' rows.  Rows are first folded to one row per
    page (map-side combined), so the running test per source is over pages, not postings.
    """
    limit = at(now - timedelta(days=max_age_days + slack_days))
    old = F.coalesce(F.col("posted_at") < limit, F.lit(False))
    tests = {"any": F.max(old), "oldest": F.coalesce(F.min("posted_at") < limit, F.lit(False)), "all": F.min(old)}
    pages = postings.groupBy("source_key", "page_no").agg(F.count("*").alias("rows"), tests[rule].alias("_old"))
    if pages_read is not None:
        pages = pages_read.select("source_key", "page_no").distinct().join(pages, ["source_key", "page_no"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    stop = (F.col("rows") < page_size) | F.coalesce("_old", F.lit(False))
    if totals is not None:
        pages = pages.join(totals.select("source_key", "total"), "source_key", "left")
        stop = stop | F.coalesce(F.col("page_no") * page_size >= F.col("total"), F.lit(False))
    pages = pages.withColumn("stop", stop.cast("int"))
    before = Window.partitionBy("source_key").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("_b", F.coalesce(F.max("stop").over(before), F.lit(0))).filter("_b = 0").select("source_key", "page_no", "rows", F.col("stop").cast("boolean").alias("last"))


def flatten_facets(captures: DataFrame) -> DataFrame:
    """(source_key, param, id, descriptor, count) of facets and of one nested level."""
    facets = captures.select("source_key", F.explode(as_list(dig(F.try_parse_json("body"), "facets", "variant"))).alias("f"))
    values = facets.select("source_key", dig(F.col("f"), "facetParameter").alias("_p"), F.explode(as_list(dig(F.col("f"), "values", "variant"))).alias("v"))
    nested = F.size(as_list(dig(F.col("v"), "values", "variant"))) > 0
    leaf = values.select("source_key", F.when(nested, F.coalesce(dig(F.col("v"), "facetParameter"), F.col("_p"))).otherwise(F.col("_p")).alias("param"),
                       F.explode(F.when(nested, as_list(dig(F.col("v"), "values", "variant"))).otherwise(F.array("v"))).alias("v"))
    v = F.col("v")
    return leaf.select("source_key", "param", dig(v, "id").alias("id"), F.coalesce(dig(v, "descriptor"), F.lit("")).alias("descriptor"),
                       F.coalesce(dig(v, "count", "bigint"), F.lit(0)).alias("count")).filter("id <> ''")


def facet_pick(facets: DataFrame, matching: DataFrame) -> DataFrame:
    """(source_key, outcome, param, ids): 'no facet' without any location facet, 'none' when no value matches a place,
    else the parameter with the largest total.  ``matching``: the descriptors that match a configured place."""
    places = facets.filter(F.col("param").rlike("(?i)location|country|region"))
    hits = places.join(matching.select("descriptor").distinct(), "descriptor", "left_semi")
    total = hits.groupBy("source_key", "param").agg(F.sum("count").alias("total"), F.array_sort(F.collect_set("id")).alias("ids"))
    best = total.groupBy("source_key").agg(F.max_by(F.struct("param", "ids"), F.struct("total", "param")).alias("_b"))
    any_place = places.select("source_key", F.lit(True).alias("_any")).distinct()
    out = facets.select("source_key").distinct().join(any_place, "source_key", "left").join(best, "source_key", "left")
    return out.select("source_key", F.when(F.col("_b").isNotNull(), F.lit("chosen")).when(F.col("_any"), F.lit("none")).otherwise(F.lit("no facet")).alias("outcome"),
                      F.col("_b.param").alias("param"), F.col("_b.ids").alias("ids"))


def validate_dimensions(sources: DataFrame, groups: DataFrame, families: DataFrame, routes: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Violations of the configuration tables as rows (rule, subject).

    sources(id, grp, favorite, url, type, families), groups(grp, times, weekdays, quiet_hours), families(family),
    routes(route, place), places(place): the configured places that a route may name; None leaves that rule out.
    """
    def rows(df: DataFrame, rule: str, subject: Column) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), subject.alias("subject"))

    hhmm = r"^([01]\d|2[0-3]):[0-5]\d$"
    window = r"^([01]\d|2[0-3]):[0-5]\d\s*-\s*([01]\d|2[0-3]):[0-5]\d$"
    twice = sources.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    known = groups.select("grp")
    favourites = known.filter("grp = 'favorites'").agg(F.count("*")).scalar()
    asked = sources.select("id", F.explode("families").alias("family"))
    slugs = routes.select("route").distinct().withColumn("slug", route_slug(F.col("route"))).groupBy("slug").agg(F.count("*").alias("n"))
    days = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
    parts = [
        rows(twice, "duplicate id", F.col("id")),
        rows(sources.join(known, "grp", "left_anti"), "unknown group", F.col("id")),
        rows(sources.filter("favorite").filter(favourites == 0), "favourite without its group", F.col("id")),
        rows(sources.filter("coalesce(url, '') = '' AND coalesce(type, '') = ''"), "needs url or type", F.col("id")),
        rows(asked.join(families, "family", "left_anti"), "unknown family", F.concat_ws(":", "id", "family")),
        rows(groups.select("grp", F.explode("times").alias("t")).filter(~F.col("t").rlike(hhmm)), "invalid time", F.concat_ws(":", "grp", "t")),
        rows(groups.select("grp", F.explode("weekdays").alias("d")).filter(~F.substring(F.lower(F.trim("d")), 1, 3).isin(days)), "invalid weekday", F.concat_ws(":", "grp", "d")),
        rows(groups.filter(F.col("quiet_hours").isNotNull() & ~F.trim("quiet_hours").rlike(window)), "invalid quiet hours", F.col("grp")),
        rows(slugs.filter("n > 1 OR slug = ''"), "route names collide", F.col("slug")),
    ]
    if places is not None:
        named = routes.filter(F.trim(F.coalesce("place", F.lit(""))) != "")
        parts.append(rows(named.join(places.select("place").distinct(), "place", "left_anti"), "unknown routing place", F.concat_ws(":", "route", "place")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
