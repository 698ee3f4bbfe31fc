"""2.A JSON payloads.  Payload pages are built from the postings by Spark (at most 100 per source and page); the SQL twin
states what has to come out, straight from the postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.jsons import as_list, dig
from ..sources import json_map as J
from ..sources import vendors as VD
from .registry import NOW, NOW_SQL, V, Tables, query


def pages(t: Tables, item: Column, wrap=lambda items: F.to_json(F.struct(items.alias("jobs")))) -> DataFrame:
    """Captured pages: the postings of a source whose numbers share their thousands, in order."""
    rows = t.v.select("source_key", F.floor(F.col("n") / 1000).cast("int").alias("page_no"), F.struct(F.col("n").alias("o"), item.alias("i")).alias("row"))
    grouped = rows.groupBy("source_key", "page_no").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return grouped.select("source_key", "page_no", wrap(F.transform("rows", lambda r: r["i"])).alias("body"))


def struct(**fields) -> Column:
    return F.struct(*[(F.lit(c) if not isinstance(c, Column) else c).alias(name) for name, c in fields.items()])


def shown(df: DataFrame) -> DataFrame:
    return df.select("source_key", "native_id", "title", "url", F.array_join("locations", " · ").alias("places"), "posted_at",
                     F.col("posted_precision").alias("prec"), "description", "company")


def expect(title="title", url="url", places="location", posted="posted_at", prec="CASE WHEN posted_at IS NULL THEN 'unknown' ELSE 'date' END",
           description="''", company="NULL::VARCHAR", native="native_id", where="true") -> str:
    return (f"WITH {V} SELECT source_key, {native} AS native_id, {title} AS title, {url} AS url, {places} AS places, {posted} AS posted_at, "
            f"{prec} AS prec, {description} AS description, {company} AS company FROM v WHERE {where}")


def day() -> Column:
    return F.date_format("posted_at", "yyyy-MM-dd")


N = lambda: F.col("n")  # noqa: E731 - a Column needs a running session
DT = "CASE WHEN posted_at IS NULL THEN 'unknown' ELSE 'datetime' END"


def col(name: str) -> Column:
    return F.col(name)


@query("a1_scan_captures", """SELECT event_type AS source_key, event_id % 5 <> 0 AS ok, CASE WHEN event_id % 5 = 0 THEN 'body is not JSON' END AS error, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def a1(t: Tables) -> DataFrame:
    """Every fifth payload is cut in the middle: it becomes an error row and the others go on."""
    body = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"x": '), F.substring("props", 1, 3))).otherwise(F.col("props"))
    captures = t.ev.select(F.col("event_type").alias("source_key"), F.col("event_id").alias("page_no"), body.alias("body"))
    return J.scan_errors(captures).groupBy("source_key", "ok", "error").agg(F.count("*").alias("n"))


@query("a2_normalize_json", "WITH e AS (" + expect(url="CASE WHEN n % 2 = 0 THEN url ELSE 'https://t.test/' || n || '/' || family END", native="CASE WHEN n % 3 = 0 THEN native_id WHEN n % 2 = 0 THEN url ELSE 'https://t.test/' || n || '/' || family END",
       company="company", where="n % 5 <> 0").replace("SELECT source_key,", "SELECT n, source_key,") + ") SELECT * EXCLUDE (n) FROM e QUALIFY row_number() OVER (PARTITION BY source_key, native_id ORDER BY n) = 1")
def a2(t: Tables) -> DataFrame:
    """Own fields: scalar and listed places, URL template, id falling back to the URL, items without title dropped."""
    url = F.when(N() % 2 == 0, col("url"))
    item = struct(roleId=F.when(N() % 3 == 0, col("native_id")), jobTitle=F.when(N() % 5 != 0, col("title")), link=url, number=N(), team=col("family"),
                  place=F.concat(F.lit(" "), "location", F.lit(", ")), when=F.date_format("posted_at", "dd|MM|yyyy"), org=struct(name=col("company")))
    m = J.Mapping("data.roles.items", id="roleId", title="jobTitle", url="link", url_template="https://t.test/{number}/{team}", locations="place",
                  posted_at="when", posted_at_format="dd|MM|yyyy", company="org.name")
    body = pages(t, item, lambda items: F.to_json(struct(data=struct(roles=struct(items=items)))))
    return shown(J.normalize_json(body, m, NOW))


@query("j1_mixed_sources", f"""WITH {V} SELECT source_key, native_id, title, CASE WHEN n % 10 < 4 THEN 'https://b.test/' || n WHEN n % 10 < 7 THEN 'https://l.test/' || n ELSE 'https://jobs.smartrecruiters.com/acme/' || n END AS url FROM v""")
def j1(t: Tables) -> DataFrame:
    """Captures of three types in one table: two are found by their address, one is named."""
    greenhouse = pages(t, struct(id=N(), title=col("title"), absolute_url=F.concat(F.lit("https://b.test/"), N().cast("string"))))
    lever = pages(t, struct(id=N().cast("string"), text=col("title"), hostedUrl=F.concat(F.lit("https://l.test/"), N().cast("string"))), F.to_json)
    smart = pages(t, struct(id=N().cast("string"), name=col("title")), lambda items: F.to_json(struct(content=items)))
    digit = F.substring("source_key", 2, 1).cast("int")
    captures = greenhouse.filter(digit < 4).unionByName(lever.filter(digit.between(4, 6))).unionByName(smart.filter(digit > 6))
    sources = [(f"s{i}", None, "https://boards.greenhouse.io/acme", {}) for i in range(4)] + [(f"s{i}", "lever", None, {}) for i in range(4, 7)]
    sources += [(f"s{i}", None, "https://careers.smartrecruiters.com/acme", {}) for i in range(7, 10)]
    return VD.normalize_mixed(captures, sources, NOW).select("source_key", "native_id", "title", "url")


@query("a2_first_page_wins", f"WITH {V} SELECT source_key, CAST(n % 900 AS VARCHAR) AS native_id, arg_min(title, n) AS title FROM v GROUP BY 1, 2")
def a2_pages(t: Tables) -> DataFrame:
    item = struct(id=(N() % 900).cast("string"), title=col("title"))
    return J.normalize_json(pages(t, item), J.Mapping("jobs", id="id", title="title"), NOW).select("source_key", "native_id", "title")


@query("a2a_greenhouse", expect(places="CASE WHEN n % 2 = 0 THEN location || ' · ' || target ELSE location END", description="title || ' & more'",
       prec="CASE WHEN posted_at IS NULL THEN 'datetime' ELSE 'date' END", posted="coalesce(posted_at, seen_at + INTERVAL 90 MINUTE)"))
def a2a(t: Tables) -> DataFrame:
    later = F.date_format(F.timestamp_seconds(F.unix_seconds(F.col("seen_at").cast("timestamp")) + 5400), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    offices = F.when(N() % 2 == 0, F.array(struct(name=col("target")), struct(name=col("location")))).otherwise(F.array(struct(name=col("location"))))
    item = struct(id=N(), title=col("title"), absolute_url=col("url"), updated_at=later, first_published=day(), location=struct(name=col("location")),
                  offices=offices, content=F.concat(F.lit("&lt;p&gt;"), "title", F.lit(" &amp;amp; more&lt;/p&gt;")))
    return shown(J.normalize_json(pages(t, item), VD.GREENHOUSE, NOW, "greenhouse"))


@query("a2b_lever", expect(places="CASE WHEN n % 2 = 0 THEN location || ' · ' || target ELSE target END", posted="seen_at + INTERVAL 7300 DAY", prec="'datetime'",
       description="family || ' extra'"))
def a2b(t: Tables) -> DataFrame:
    ms = (F.unix_seconds(F.col("seen_at").cast("timestamp")) + 7300 * 86400) * 1000
    cats = F.when(N() % 2 == 0, struct(allLocations=F.array("location", "target"), location=F.lit("x"))).otherwise(
        struct(allLocations=F.lit(None).cast("array<string>"), location=col("target")))
    item = struct(id=col("native_id"), text=col("title"), hostedUrl=col("url"), createdAt=ms, categories=cats, descriptionPlain=col("family"), additionalPlain="extra")
    return shown(J.normalize_json(pages(t, item, lambda i: F.to_json(i)), VD.LEVER, NOW, "lever"))


@query("a2c_smartrecruiters", expect(url="'https://jobs.smartrecruiters.com/acme/' || native_id", prec=DT, description="CASE WHEN n % 3 = 0 THEN title || ' skills' ELSE '' END",
       places="CASE WHEN n % 4 = 0 THEN 'Remote, ' ELSE '' END || CASE WHEN n % 2 = 0 THEN location ELSE target || ', XX' END"))
def a2c(t: Tables) -> DataFrame:
    loc = struct(fullLocation=F.when(N() % 2 == 0, col("location")), city=col("target"), region="", country="XX", remote=N() % 4 == 0)
    item = struct(id=col("native_id"), name=col("title"), releasedDate=F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), location=loc)
    found = J.normalize_json(pages(t, item, lambda i: F.to_json(struct(content=i))), VD.smartrecruiters("acme"), NOW, "smartrecruiters")
    sections = struct(one=struct(text=F.concat(F.lit("<p>"), "title", F.lit("</p>"))), two=struct(text="<b>skills</b>"))
    details = t.v.filter("n % 3 = 0").select("source_key", "native_id", F.to_json(struct(jobAd=struct(sections=sections))).alias("body"))
    texts = F.concat_ws(" ", dig(F.col("item"), "jobAd.sections.one.text"), dig(F.col("item"), "jobAd.sections.two.text"))
    return shown(VD.merge_details(found, details, texts, F.array().cast("array<string>")))


@query("a2d_ashby", expect(places="location || ' · ' || target", description="CASE WHEN n % 2 = 0 THEN family ELSE 'html ' || family END"))
def a2d(t: Tables) -> DataFrame:
    item = struct(id=col("native_id"), title=col("title"), jobUrl=col("url"), publishedAt=day(), location=col("location"), secondaryLocations=F.array(struct(location=col("target"))),
                  descriptionPlain=F.when(N() % 2 == 0, col("family")), descriptionHtml=F.concat(F.lit("<i>html</i> "), "family"))
    return shown(J.normalize_json(pages(t, item), VD.ASHBY, NOW, "ashby"))


@query("a2e_workable", expect(places="CASE WHEN n % 2 = 0 THEN target || ', XX' ELSE target || ', YY, ZZ' END", description="family"))
def a2e(t: Tables) -> DataFrame:
    listed = F.when(N() % 2 == 0, F.array(struct(city=col("target"), region="", country="XX"))).otherwise(F.array().cast("array<struct<city:string,region:string,country:string>>"))
    item = struct(shortcode=col("native_id"), title=col("title"), url=F.when(N() % 3 == 0, col("url")), application_url=col("url"), published_on=day(), locations=listed,
                  city=col("target"), state="YY", country="ZZ", description=F.concat(F.lit("<p>"), "family", F.lit("</p>")))
    return shown(J.normalize_json(pages(t, item), VD.WORKABLE, NOW, "workable"))


@query("a2f_recruitee", expect(places="CASE n % 3 WHEN 0 THEN location WHEN 1 THEN target || ', XX' ELSE family END"))
def a2f(t: Tables) -> DataFrame:
    place = struct(name=F.when(N() % 3 == 0, col("location")), city=col("target"), country="XX")
    listed = F.when(N() % 3 < 2, F.array(place)).otherwise(F.array().cast("array<struct<name:string,city:string,country:string>>"))
    item = struct(id=N(), title=col("title"), careers_url=col("url"), published_at=day(), locations=listed, location=col("family"))
    return shown(J.normalize_json(pages(t, item, lambda i: F.to_json(struct(offers=i))), VD.RECRUITEE, NOW, "recruitee"))


@query("a2g_workday", f"""WITH {V} SELECT source_key, '/job/' || replace(target, ' ', '-') || '/R' || native_id AS native_id, title, CASE WHEN n % 4 = 3 THEN 'main · other' WHEN n % 4 = 0 THEN location WHEN n % 4 = 1 THEN family ELSE target END AS places,
 CASE WHEN n % 4 = 3 AND n % 7 > 1 THEN {NOW_SQL} - to_days(CAST(n % 7 - 2 AS INT)) + INTERVAL 2 DAY ELSE {NOW_SQL} - to_days(CAST(n % 7 AS INT)) END AS posted_at,
 CASE WHEN n % 4 = 3 AND n % 7 > 1 THEN 'date' ELSE 'relative' END AS prec, n % 4 = 3 AS multi FROM v""")
def a2g(t: Tables) -> DataFrame:
    k = N() % 4
    path = F.concat(F.lit("/job/"), F.replace("target", F.lit(" "), F.lit("-")), F.lit("/R"), "native_id")
    ago = F.concat(F.lit("Posted "), (N() % 7).cast("string"), F.lit(" Days Ago"))
    item = struct(title=col("title"), externalPath=path, locationsText=F.when(k == 0, col("location")).when(k == 3, F.lit("3 Locations")).otherwise(F.lit("")),
                  postedOn=F.when(k != 2, ago), bulletFields=F.when(k == 1, F.array(col("family"), F.lit("x"))).otherwise(F.array(F.concat(F.lit("R: "), "native_id"), F.concat(F.lit("Date: "), ago))))
    found = J.normalize_json(pages(t, item, lambda i: F.to_json(struct(jobPostings=i))), VD.workday("acme.wd1.myworkdayjobs.com", "ext"), NOW, "workday")
    found = found.withColumn("multi_location", F.get("locations", F.lit(0)).rlike(r"^\d+ Locations$"))
    start = F.date_format(F.timestamp_seconds(F.unix_seconds(F.lit("2001-08-04").cast("timestamp")) - (N() % 7 - 2) * 86400), "yyyy-MM-dd")
    start = F.when(N() % 7 > 1, start)
    info = struct(jobPostingInfo=struct(jobDescription="<p>d</p>", location="main", additionalLocations=F.array(F.lit("other")), startDate=start))
    details = t.v.filter("n % 4 = 3").select("source_key", path.alias("native_id"), F.to_json(info).alias("body"))
    v = F.col("item")
    locs = F.concat(F.array(dig(v, "jobPostingInfo.location")), as_list(dig(v, "jobPostingInfo.additionalLocations", "variant"), "string"))
    full = VD.merge_details(found, details, dig(v, "jobPostingInfo.jobDescription"), locs, parse_date(dig(v, "jobPostingInfo.startDate"), NOW)["ts"])
    return full.select("source_key", "native_id", "title", F.array_join("locations", " · ").alias("places"), "posted_at", F.col("posted_precision").alias("prec"), F.col("multi_location").alias("multi"))


@query("a2h_oracle_hcm", expect(places="location || ' · ' || target", url="'https://x.oraclecloud.com/hcmUI/CandidateExperience/en/sites/S1/job/' || native_id", description="family"))
def a2h(t: Tables) -> DataFrame:
    item = struct(Id=col("native_id"), Title=col("title"), PostedDate=day(), PrimaryLocation=col("location"), secondaryLocations=F.array(struct(Name=col("target"))), ShortDescriptionStr=col("family"))
    body = pages(t, item, lambda i: F.to_json(struct(items=F.array(struct(TotalJobsCount=1, requisitionList=i)))))
    return shown(J.normalize_json(body, VD.oracle_hcm("x.oraclecloud.com", "S1"), NOW, "oracle_hcm"))


@query("a2i_eightfold", expect(posted="seen_at + to_seconds(CASE WHEN n % 2 = 0 THEN 0 ELSE 3600 END)", prec="CASE WHEN n % 2 = 0 THEN 'date' ELSE 'datetime' END",
       places="CASE WHEN n % 3 = 0 THEN location ELSE target END", url="CASE WHEN n % 5 = 0 THEN '/careers/job/' || native_id ELSE url END"))
def a2i(t: Tables) -> DataFrame:
    ts = F.unix_seconds(F.col("seen_at").cast("timestamp")) + F.when(N() % 2 == 0, 0).otherwise(3600)
    item = struct(id=N(), name=F.when(N() % 7 != 0, col("title")), posting_name=col("title"), locations=F.when(N() % 3 == 0, F.array("location")), location=col("target"),
                  postedTs=F.when(N() % 4 != 0, ts), t_create=ts, positionUrl=F.when(N() % 5 != 0, col("url")))
    return shown(J.normalize_json(pages(t, item, lambda i: F.to_json(struct(data=struct(positions=i)))), VD.EIGHTFOLD, NOW, "eightfold"))


@query("a2j_brassring", expect(places="target || ', ' || family", description="family"))
def a2j(t: Tables) -> DataFrame:
    def ask(name: str, value: Column) -> Column:
        return struct(QuestionName=name, Value=value)
    questions = F.array(ask("ReqId", col("native_id")), ask("JobTitle", col("title")), ask("LastUpdated", day()), ask("City", col("target")), ask("State", col("family")), ask("JobDescription", col("family")))
    body = pages(t, struct(Questions=questions, Link=col("url")), lambda i: F.to_json(struct(Jobs=struct(Job=i))))
    return shown(J.normalize_json(body, VD.brassring(["city", "state", "missing"]), NOW, "brassring"))


@query("a2k_efinancialcareers", expect(url="CASE WHEN n % 2 = 0 THEN 'https://www.efinancialcareers.com/jobs/' || native_id ELSE url END", company="company", description="family", where="n % 6 <> 0"))
def a2k(t: Tables) -> DataFrame:
    item = struct(id=col("native_id"), title=col("title"), detailsPageUrl=F.when(N() % 6 == 0, F.lit("")).when(N() % 2 == 0, F.concat(F.lit("/jobs/"), "native_id")).otherwise(col("url")),
                  jobLocation=struct(displayName=col("location")), postedDate=day(), companyName=F.when(N() % 3 == 0, col("company")), clientBrandName=col("company"), summary=col("family"))
    return shown(J.normalize_json(pages(t, item, lambda i: F.to_json(struct(data=i))), VD.EFINANCIALCAREERS, NOW, "efinancialcareers"))


@query("a2l_jobcloud", expect(url="CASE n % 3 WHEN 0 THEN url || '#fr' WHEN 1 THEN url || '#de' ELSE 'https://www.jobup.ch/en/jobs/detail/' || native_id || '/' END", places="target || ', Switzerland'",
       company="CASE WHEN n % 2 = 0 THEN company END", description="family"))
def a2l(t: Tables) -> DataFrame:
    links = F.when(N() % 3 == 0, struct(detail_fr=struct(href=F.concat("url", F.lit("#fr"))), detail_de=struct(href=F.concat("url", F.lit("#de"))))).when(
        N() % 3 == 1, struct(detail_fr=F.lit(None).cast("struct<href:string>"), detail_de=struct(href=F.concat("url", F.lit("#de")))))
    item = struct(job_id=col("native_id"), title=col("title"), _links=links, company_name=col("company"), company_visible=N() % 2 == 0, place=col("target"), publication_date=day(), preview=col("family"))
    return shown(J.normalize_json(pages(t, item, lambda i: F.to_json(struct(documents=i))), VD.jobcloud(), NOW, "jobcloud"))


@query("a2m_infojobs", expect(places="CASE WHEN n % 2 = 0 THEN target || ', ' ELSE '' END || family || ', España'", company="company", description="title || ' · 2 years'"))
def a2m(t: Tables) -> DataFrame:
    item = struct(id=col("native_id"), title=col("title"), link=col("url"), city=F.when(N() % 2 == 0, col("target")), province=struct(value=col("family")), author=struct(name=col("company")),
                  published=day(), requirementMin=col("title"), experienceMin=struct(value="2 years"))
    return shown(J.normalize_json(pages(t, item, lambda i: F.to_json(struct(offers=i))), VD.INFOJOBS, NOW, "infojobs"))


@query("a2n_adzuna", expect(places="CASE WHEN n % 2 = 0 THEN target || ', ' || family ELSE location END", company="company", description="family"))
def a2n(t: Tables) -> DataFrame:
    area = F.when(N() % 2 == 0, F.array("family", "target", "target")).otherwise(F.array().cast("array<string>"))
    item = struct(id=col("native_id"), title=F.concat(F.lit("<strong>"), "title", F.lit("</strong>")), redirect_url=col("url"), company=struct(display_name=col("company")),
                  location=struct(display_name=col("location"), area=area), created=day(), description=col("family"))
    return shown(J.normalize_json(pages(t, item, lambda i: F.to_json(struct(results=i))), VD.ADZUNA, NOW, "adzuna"))
