"""Mappings of known payloads.  Each is data for :func:`normalize_json`; the paths are those of the vendors' APIs."""

from __future__ import annotations

import inspect
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.jsons import as_list, dig
from ..functions.text import html_to_text
from ..session import small_table
from .detect import detect_source_type
from .json_map import Mapping, each, first_of, join_parts, normalize_json

NONE = "array<string>"


def _plain(*paths: str):
    return lambda v: F.trim(F.concat_ws(" ", *[F.coalesce(dig(v, p), F.lit("")) for p in paths]))


def _some(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull() & (x != ""))


def _or_else(values: Column, other: Column) -> Column:
    return F.when(F.size(values) > 0, values).otherwise(F.array(other))


def _remote(v: Column) -> Column:
    place = F.coalesce(first_of(v, "location.fullLocation"), join_parts(v, "location.city", "location.region", "location.country"))
    return F.array(F.when(dig(v, "location.remote", "boolean"), F.concat(F.lit("Remote, "), place)).otherwise(place))


def _workable(v: Column) -> Column:
    listed = F.transform(as_list(dig(v, "locations", "variant")), lambda o: join_parts(o, "city", "region", "country"))
    return _or_else(listed, join_parts(v, "city", "state", "country"))


def _recruitee(v: Column) -> Column:
    listed = F.transform(as_list(dig(v, "locations", "variant")), lambda o: F.coalesce(first_of(o, "name"), join_parts(o, "city", "country")))
    return _or_else(listed, dig(v, "location"))


def workday_location(v: Column) -> Column:
    """The text, else the first bullet unless it looks like a number or label, else the third part of the path."""
    text, bullet = dig(v, "locationsText"), dig(v, "bulletFields[0]")
    path = F.split(F.coalesce(dig(v, "externalPath"), F.lit("")), "/")
    slug = F.when(F.size(path) > 3, F.replace(F.get(path, F.lit(2)), F.lit("-"), F.lit(" ")))
    return F.coalesce(F.when(text != "", text), F.when((bullet != "") & ~bullet.rlike(r"\d{4,}|:"), bullet), slug)


def workday_date(v: Column) -> Column:
    """The posting text, else what follows the colon in the first bullet about a date."""
    bullets = F.filter(as_list(dig(v, "bulletFields", "variant"), "string"), lambda b: b.rlike("(?i)post|publi|date"))
    bullet = F.get(bullets, F.lit(0))
    return F.coalesce(first_of(v, "postedOn"), F.when(F.instr(bullet, ":") > 0, F.substring(bullet, F.instr(bullet, ":") + 1, F.length(bullet))).otherwise(bullet))


def _midnight(raw: Column, precision: Column) -> Column:
    return F.when((precision == "datetime") & (raw.try_cast("bigint") % 86400 == 0), F.lit("date")).otherwise(precision)


def _answers(v: Column) -> Column:
    """An item's link and its questions by lower-case name, taken apart once."""
    asked = F.transform(as_list(dig(v, "Questions", "variant")), lambda q: F.struct(F.lower(dig(q, "QuestionName")).alias("name"), dig(q, "Value").alias("value")))
    return F.struct(dig(v, "Link").alias("link"), asked.alias("asked"))


def _ask(v: Column, name: str) -> Column:
    """Answer to a question by its lower-case name; the last question of a name counts."""
    return F.try_element_at(F.filter(v["asked"], lambda q: q["name"] == name), F.lit(-1))["value"]


def _brassring_places(fields: list[str]):
    def places(v: Column) -> Column:
        found = F.array_distinct(_some(F.array(*[F.trim(_ask(v, f)) for f in fields])))
        return F.when(F.size(found) > 0, F.array(F.array_join(found, ", "))).otherwise(F.array().cast(NONE))
    return places


def _answer(name: str):
    return lambda v: _ask(v, name)


def _adzuna_place(v: Column) -> Column:
    area = F.array_distinct(F.reverse(_some(as_list(dig(v, "location.area", "variant"), "string"))))
    text = F.array_join(area, ", ")
    return F.array(F.coalesce(F.when(text != "", text), dig(v, "location.display_name")))


def _all_present(*paths: str):
    def keep(v: Column) -> Column:
        out = F.lit(True)
        for p in paths:
            out = out & (F.coalesce(dig(v, p), F.lit("")) != "")
        return out
    return keep


def _jobcloud_link(site: str, language: str):
    def link(v: Column) -> Column:
        order = [f"_links.detail_{code}.href" for code in dict.fromkeys((language, "en", "fr", "de"))]
        return F.coalesce(first_of(v, *order), F.concat(F.lit(f"https://www.{site}/en/jobs/detail/"), dig(v, "job_id"), F.lit("/")))
    return link


GREENHOUSE = Mapping(
    "jobs", id="id", title="title", url="absolute_url", description="content", posted_at=lambda v: first_of(v, "first_published", "updated_at"),
    locations=lambda v: F.array_distinct(_some(F.concat(F.array(dig(v, "location.name")), each(v, "offices", "name")))))
LEVER = Mapping(
    "", id="id", title="text", url="hostedUrl", posted_at="createdAt", description=_plain("descriptionPlain", "additionalPlain"),
    locations=lambda v: _or_else(as_list(dig(v, "categories.allLocations", "variant"), "string"), dig(v, "categories.location")))
ASHBY = Mapping(
    "jobs", id="id", title="title", url="jobUrl", posted_at="publishedAt", description=lambda v: first_of(v, "descriptionPlain", "descriptionHtml"),
    locations=lambda v: _some(F.concat(F.array(dig(v, "location")), each(v, "secondaryLocations", "location"))))
WORKABLE = Mapping(
    "jobs", id="shortcode", title="title", url=lambda v: first_of(v, "url", "application_url"), locations=_workable,
    posted_at=lambda v: first_of(v, "published_on", "created_at"), description="description")
RECRUITEE = Mapping(
    "offers", id="id", title="title", url="careers_url", locations=_recruitee, posted_at=lambda v: first_of(v, "published_at", "created_at"),
    description="description")
EIGHTFOLD = Mapping(
    "data.positions", id="id", title=lambda v: first_of(v, "name", "posting_name"), posted_at=lambda v: first_of(v, "postedTs", "t_create", "creationTs"),
    precision=_midnight, url=lambda v: F.coalesce(first_of(v, "positionUrl"), F.concat(F.lit("/careers/job/"), dig(v, "id"))),
    locations=lambda v: _or_else(as_list(dig(v, "locations", "variant"), "string"), dig(v, "location")))
EIGHTFOLD_LEGACY = Mapping(**{**EIGHTFOLD.__dict__, "items": "positions"})
EFINANCIALCAREERS = Mapping(
    "data", id="id", title="title", keep=_all_present("id", "title", "detailsPageUrl"), posted_at="postedDate",
    url=lambda v: F.when(dig(v, "detailsPageUrl").startswith("/"), F.concat(F.lit("https://www.efinancialcareers.com"), dig(v, "detailsPageUrl")))
    .otherwise(dig(v, "detailsPageUrl")), company=lambda v: first_of(v, "companyName", "clientBrandName"),
    locations=lambda v: F.array(dig(v, "jobLocation.displayName")), description=lambda v: first_of(v, "description", "summary"))
INFOJOBS = Mapping(
    "offers", id="id", title="title", url="link", keep=_all_present("id", "title", "link"), posted_at=lambda v: first_of(v, "published", "updated"),
    company=lambda v: first_of(v, "author.name"), locations=lambda v: F.array(F.concat_ws(", ", first_of(v, "city"), first_of(v, "province.value"), F.lit("España"))),
    description=lambda v: F.concat_ws(" · ", first_of(v, "requirementMin"), first_of(v, "experienceMin.value")))
ADZUNA = Mapping(
    "results", id="id", url="redirect_url", keep=_all_present("id", "title", "redirect_url"), title=lambda v: let(dig(v, "title"), html_to_text),
    posted_at="created", company=lambda v: first_of(v, "company.display_name"), locations=_adzuna_place, description="description")


def smartrecruiters(company: str) -> Mapping:
    return Mapping("content", id="id", title="name", locations=_remote, posted_at="releasedDate",
                   url=lambda v: F.concat(F.lit(f"https://jobs.smartrecruiters.com/{company}/"), dig(v, "id")))


def workday(host: str, site: str) -> Mapping:
    return Mapping("jobPostings", id="externalPath", title="title", url=lambda v: F.concat(F.lit(f"https://{host}/{site}"), dig(v, "externalPath")),
                   posted_at=workday_date, locations=lambda v: F.array(workday_location(v)))


def oracle_hcm(host: str, site: str, lang: str = "en") -> Mapping:
    return Mapping("items[0].requisitionList", id="Id", title="Title", posted_at="PostedDate", description="ShortDescriptionStr",
                   url=lambda v: F.concat(F.lit(f"https://{host}/hcmUI/CandidateExperience/{lang}/sites/{site}/job/"), dig(v, "Id")),
                   locations=lambda v: _some(F.concat(F.array(dig(v, "PrimaryLocation")), each(v, "secondaryLocations", "Name"))))


def brassring(location_fields: list[str]) -> Mapping:
    return Mapping("Jobs.Job", id=_answer("reqid"), title=lambda v: let(_answer("jobtitle")(v), html_to_text), url=lambda v: v["link"], posted_at=_answer("lastupdated"),
                   precision=lambda raw, p: F.when(p == "unknown", p).otherwise(F.lit("date")), locations=_brassring_places(location_fields),
                   description=_answer("jobdescription"), prepare=_answers)


def jobcloud(site: str = "jobup.ch", language: str = "fr") -> Mapping:
    return Mapping("documents", id="job_id", title="title", url=_jobcloud_link(site, language), keep=_all_present("job_id", "title"),
                   company=lambda v: F.when(F.coalesce(dig(v, "company_visible", "boolean"), F.lit(True)), dig(v, "company_name")),
                   locations=lambda v: F.array(F.concat(first_of(v, "place"), F.lit(", Switzerland"))), posted_at="publication_date", description="preview")


# name -> mapping or a function that makes one from the parameters of a source
MAPPINGS = {
    "greenhouse": GREENHOUSE, "lever": LEVER, "smartrecruiters": smartrecruiters, "ashby": ASHBY, "workable": WORKABLE, "recruitee": RECRUITEE,
    "workday": workday, "oracle_hcm": oracle_hcm, "eightfold": EIGHTFOLD, "eightfold_legacy": EIGHTFOLD_LEGACY, "brassring": brassring,
    "efinancialcareers": EFINANCIALCAREERS, "jobcloud": jobcloud, "infojobs": INFOJOBS, "adzuna": ADZUNA,
}


def normalize_mixed(captures: DataFrame, sources: Sequence[tuple[str, str | None, str | None, dict]], now: datetime) -> DataFrame:
    """Postings of captures from sources of several types: each goes through the mapping of its source's type.

    ``sources``: the configuration, as (source_key, type or None, url, parameters of the mapping).  Without a type the url tells it
    (``detect_source_type``), and with it the parameters.  Sources with one mapping are read together.
    """
    spark = captures.sparkSession
    asked = small_table(spark, "i int, url string", [(i, url) for i, (_, kind, url, _) in enumerate(sources) if kind is None and url])
    found = {r.i: r.d for r in asked.select("i", detect_source_type(F.col("url")).alias("d")).collect()}  # as many rows as sources
    by_mapping: dict[tuple, list[str]] = {}
    for i, (key, kind, _, params) in enumerate(sources):
        told = found.get(i)
        kind = kind or (told.type if told else None)
        if kind not in MAPPINGS:
            raise ValueError(f"source {key!r}: no mapping for type {kind!r}")
        wanted = inspect.signature(MAPPINGS[kind]).parameters if callable(MAPPINGS[kind]) else ()
        known = {**(told.params if told else {}), **params}
        by_mapping.setdefault((kind, tuple((p, known[p]) for p in wanted if p in known)), []).append(key)
    out = None
    for (kind, params), keys in by_mapping.items():
        mapping = MAPPINGS[kind](**dict(params)) if callable(MAPPINGS[kind]) else MAPPINGS[kind]
        rows = normalize_json(captures.filter(F.col("source_key").isin(keys)), mapping, now)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no sources")
    return out


def merge_details(postings: DataFrame, details: DataFrame, description: Column, locations: Column, posted: Column | None = None) -> DataFrame:
    """Fill postings from detail captures (source_key, native_id, body): description, real locations, and the exact
    date where the estimate is missing or more than a day off."""
    d = details.withColumn("item", F.try_parse_json("body")).select(
        "source_key", "native_id", html_to_text(description).alias("_desc"), _some(locations).alias("_locs"),
        (F.lit(None).cast("timestamp") if posted is None else posted).alias("_posted"))
    j = postings.join(d, ["source_key", "native_id"], "left")
    estimate = F.col("posted_precision").isin("relative", "unknown")
    gap = F.floor((F.unix_seconds("posted_at") - F.unix_seconds("_posted")) / 86400)
    take = F.col("_posted").isNotNull() & estimate & (F.col("posted_at").isNull() | (F.abs(gap) > 1))
    return j.withColumns({
        "description": F.coalesce(F.when(F.col("_desc") != "", F.col("_desc")), "description"),
        "locations": F.when(F.size("_locs") > 0, F.col("_locs")).otherwise(F.col("locations")),
        "posted_at": F.when(take, F.col("_posted")).otherwise(F.col("posted_at")),
        "posted_precision": F.when(take, F.lit("date")).otherwise(F.col("posted_precision")),
    }).drop("_desc", "_locs", "_posted")
