"""2.A XML, HTML, mail, link, paging and configuration rows.  Payloads are built by Spark from the driver tables."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_text_blocks, xml_escape
from ..sources import detect as D
from ..sources import feeds_xml as X
from ..sources import mail as M
from ..sources import pages as P
from ..sources import paging as PG
from . import duck
from .registry import NOW, NOW_SQL, V, Tables, query
from .sources_json import DT, N, col, day, expect, pages, shown, struct


def text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def tag(name: str, value: Column) -> Column:
    return text(f"<{name}>", xml_escape(F.coalesce(value, F.lit(""))), f"</{name}>")


def wrap(head: str, foot: str):
    return lambda items: F.concat(F.lit(head), F.array_join(items, ""), F.lit(foot))


def rfc(days: int = 0) -> Column:
    return text(F.date_format(F.date_add(F.col("posted_at"), days), "E, dd MMM yyyy HH:mm:ss"), " +0000")


@query("a3_rss", expect(title="title || ' & co'", native="CASE WHEN n % 3 = 0 THEN url ELSE native_id END", prec=DT, description="'Location: ' || target || ' | ' || family",
       places="CASE WHEN n % 4 = 0 THEN family || ' · ' || location ELSE target || ' · ' || location END").replace("NULL::VARCHAR AS company", "NULL::VARCHAR AS company"))
def a3(t: Tables) -> DataFrame:
    """Guid falls back to the link; a pattern reads the place from the description, a tag adds another."""
    place = F.when(N() % 4 == 0, col("family")).otherwise(col("target"))
    item = text("<item>", tag("title", text(col("title"), " & co")), tag("link", col("url")), F.when(N() % 3 == 0, F.lit("")).otherwise(tag("guid", col("native_id"))),
                text("<description><![CDATA[<p>Location: ", col("target"), " | ", col("family"), "</p><!-- at ", place, " -->]]></description>"),
                tag("pubDate", rfc()), tag("place", col("location")), "</item>")
    body = pages(t, item, wrap('<rss version="2.0"><channel>', "</channel></rss>"))
    return shown(X.normalize_rss(body, NOW, r"<!-- at ([^-]*?) -->", True).withColumn("company", F.lit(None).cast("string")))


@query("a3_atom", expect(url="url || '#alt'", native="native_id", prec="CASE WHEN posted_at IS NULL THEN 'unknown' ELSE 'datetime' END", places="''", description="family"))
def a3_atom(t: Tables) -> DataFrame:
    stamp = F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = text("<entry>", tag("id", col("native_id")), tag("title", col("title")), '<link href="', col("url"), '" rel="self"/>', '<link href="', col("url"), '#alt"/>',
                tag("updated", stamp), tag("content", text("<p>", col("family"), "</p>")), "</entry>")
    body = pages(t, item, wrap("<feed>", "</feed>"))
    return shown(X.normalize_atom(body, NOW).withColumn("company", F.lit(None).cast("string")))


@query("a3a_teamtailor", expect(prec=DT, places="CASE WHEN n % 2 = 0 THEN location || ', XX' ELSE target END", native="native_id", description="family"))
def a3a(t: Tables) -> DataFrame:
    one = F.when(N() % 2 == 0, text("<tt:location>", tag("tt:city", col("location")), tag("tt:country", F.lit("XX")), "</tt:location>")).otherwise(
        text("<tt:location>", tag("tt:city", F.lit(" ")), tag("tt:country", col("target")), "</tt:location>"))
    item = text("<item>", tag("title", col("title")), tag("link", col("url")), tag("guid", col("native_id")), tag("pubDate", rfc()), tag("description", text("<i>", col("family"), "</i>")), one, one, "</item>")
    body = pages(t, item, wrap('<rss xmlns:tt="https://teamtailor.com/locations"><channel>', "</channel></rss>"))
    return shown(X.normalize_teamtailor(body, NOW).withColumn("company", F.lit(None).cast("string")))


@query("a3b_personio", expect(url="'https://acme.jobs.personio.de/job/' || native_id", prec="CASE WHEN posted_at IS NULL THEN 'unknown' ELSE 'datetime' END", places="location || ' · ' || target", description="family || ' second'"))
def a3b(t: Tables) -> DataFrame:
    stamp = F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss+00:00")
    part = lambda v: text("<jobDescription>", tag("name", F.lit("n")), tag("value", v), "</jobDescription>")
    item = text("<position>", tag("id", col("native_id")), tag("name", col("title")), tag("createdAt", stamp), tag("office", col("location")), "<additionalOffices>", tag("office", col("target")),
                tag("office", col("location")), "</additionalOffices><jobDescriptions>", part(text("<p>", col("family"), "</p>")), part(F.lit("second")), "</jobDescriptions></position>")
    body = pages(t, item, wrap("<workzag-jobs>", "</workzag-jobs>"))
    return shown(X.normalize_personio(body, NOW, "acme.jobs.personio.de").withColumn("company", F.lit(None).cast("string")))


@query("a3c_successfactors", expect(url="'https://sf.test/?id=' || native_id", places="CASE WHEN n % 2 = 0 THEN location || ', ' || family || ', ' || target ELSE location || ', ' || target END", description="family"))
def a3c(t: Tables) -> DataFrame:
    def field(i: int, label: Column, value: Column) -> Column:
        return text(f"<filter{i}>", tag("label", label), tag("value", value), f"</filter{i}>")
    spanish = N() % 2 == 1
    item = text("<Job>", tag("JobTitle", col("title")), tag("ReqId", col("native_id")), tag("Job-Description", col("family")), tag("Posted-Date", F.date_format("posted_at", "dd/MM/yyyy")),
                field(1, F.when(spanish, F.lit("País")).otherwise(F.lit("Country")), col("target")), field(2, F.when(spanish, F.lit("Provincia")).otherwise(F.lit("State")), F.when(spanish, F.lit("")).otherwise(col("family"))),
                field(3, F.when(spanish, F.lit("Ciudad")).otherwise(F.lit("City")), col("location")), "</Job>")
    body = pages(t, item, wrap("<Job-Listing>", "</Job-Listing>"))
    return shown(X.normalize_successfactors(body, NOW, "https://sf.test/?id=").withColumn("company", F.lit(None).cast("string")))


def html_pages(t: Tables, item: Column, head: str = "<html><body><ul>", foot: str = "</ul></body></html>") -> DataFrame:
    return pages(t, item, wrap(head, foot)).withColumn("url", F.lit("https://careers.example.test/list/all"))


def listing(df: DataFrame) -> DataFrame:
    return df.select("source_key", "native_id", "title", "url", F.array_join("locations", " · ").alias("places"), "posted_at", F.col("posted_precision").alias("prec"), "company")


def expect_list(**kw) -> str:
    return expect(**kw).replace(", '' AS description", "")


LIST = P.ListMapping("li.job", "h2 a", "h2 a", "data-id", "https://t.test/job/{id}", "p.c", "span.place", r"\((.*)\)", "em", None, r"since: (\S+)")


def list_item() -> Column:
    ident = F.when(N() % 2 == 0, text('data-id="', col("native_id"), '"')).otherwise(F.lit(""))
    place = F.when(N() % 3 == 0, text("in (", col("family"), ")")).otherwise(text("Site ", col("target")))
    return text('<li class="job big" ', ident, '><h2><a href="../jobs/', col("native_id"), '">', xml_escape(col("title")), "</a></h2><p class=c>", col("company"), "</p><span class=place>", place,
                "</span><em>Online since: ", F.coalesce(day(), F.lit("soon")), "</em></li>")


LISTED = dict(title="title", native="CASE WHEN n % 2 = 0 THEN native_id ELSE 'https://careers.example.test/jobs/' || native_id END", company="company",
              url="CASE WHEN n % 2 = 0 THEN 'https://t.test/job/' || native_id ELSE 'https://careers.example.test/jobs/' || native_id END", places="CASE WHEN n % 3 = 0 THEN family ELSE 'Site ' || target END")


@query("a4_html_list", expect_list(**LISTED))
def a4(t: Tables) -> DataFrame:
    """Nodes with an id use the URL template, others their link; parts of place and date are cut out by patterns."""
    return listing(P.normalize_html_list(html_pages(t, list_item()), LIST, NOW))


@query("a4_deep_page", expect_list(**LISTED))
def a4_deep(t: Tables) -> DataFrame:
    """The same lists inside 3,000 tags that are never closed."""
    return listing(P.normalize_html_list(html_pages(t, list_item(), "<html><body>" + "<b>" * 3000 + "<ul>"), LIST, NOW))


@query("a4a_search_cards", f"""WITH {V}, r AS (SELECT source_key, 100000 + n % 900 AS id, n, title, company, location, posted_at, row_number() OVER (PARTITION BY source_key, n % 900 ORDER BY n DESC) AS rn FROM v)
SELECT source_key, CAST(id AS VARCHAR) AS native_id, title, 'https://www.linkedin.com/jobs/view/' || id || '/' AS url, location AS places, posted_at, CASE WHEN posted_at IS NULL THEN 'unknown' ELSE 'date' END AS prec, company FROM r WHERE rn = 1""")
def a4a(t: Tables) -> DataFrame:
    ident = (N() % 900 + 100000).cast("string")
    urn = F.when(N() % 2 == 0, text('data-entity-urn="urn:li:jobPosting:', ident, '"')).otherwise(F.lit(""))
    item = text('<div class="base-card" ', urn, '><a class="base-card__full-link" href="https://www.linkedin.com/jobs/view/some-title-', ident, '?x=1"></a><h3 class="base-search-card__title">', xml_escape(col("title")),
                '</h3><h4 class="base-search-card__subtitle">', col("company"), '</h4><span class="job-search-card__location">', col("location"), '</span><time datetime="', F.coalesce(day(), F.lit("")), '">x</time></div>')
    return listing(P.normalize_html_list(html_pages(t, item, "<html><body>", "</body></html>"), P.SEARCH_CARDS, NOW, last_wins=True))


@query("a4b_table_rows", expect_list(native="native_id", url="'https://careers.example.test/job/x/' || native_id || '/'", places="location"))
def a4b(t: Tables) -> DataFrame:
    item = text('<tr class="data-row"><td><a class="jobTitle-link" href="/job/x/', col("native_id"), '/">', xml_escape(col("title")), '</a></td><td><span class="jobLocation">', col("location"),
                '</span></td><td><span class="jobDate">', F.coalesce(F.date_format("posted_at", "MMM d, yyyy"), F.lit("")), "</span></td></tr>")
    found = P.normalize_html_list(html_pages(t, item, "<html><body><table>", "</table></body></html>"), P.TABLE_ROWS, NOW)
    tail = F.regexp_extract("url", r"/(\d+)/?$", 1)
    return listing(found.withColumn("native_id", F.when(tail != "", tail).otherwise(F.col("native_id"))))


def jsonld_pages(t: Tables) -> DataFrame:
    """A page per posting; JSON-LD in several shapes, some of it unreadable."""
    n = N()
    address = struct(addressLocality=col("target"), addressRegion=col("family"), addressCountry=F.lit("XX"))
    wide = struct(addressLocality=col("target"), addressRegion=F.lit(None).cast("string"), addressCountry=struct(name="Wide"))
    base = dict(title=col("title"), datePosted=day(), description=text(col("family"), "\nnext line"), url=F.when(n % 5 != 0, col("url")), hiringOrganization=struct(name=col("company")))
    a = F.to_json(struct(kind="JobPosting", identifier=struct(value=col("native_id")), jobLocation=struct(address=address), **base))
    b = F.to_json(struct(kind=F.array(F.lit("Thing"), F.lit("JobPosting")), identifier=col("native_id"), jobLocation=F.array(struct(address=wide), struct(address=wide)), jobLocationType="TELECOMMUTE",
                         applicantLocationRequirements=struct(name="Anywhere"), **base))
    posting = F.replace(F.when(n % 2 == 0, a).otherwise(text('{"@graph": [{"x": 1}, ', b, "]}")), F.lit('"kind"'), F.lit('"@type"'))
    loose = F.replace(posting, F.lit("\\n"), F.lit("\n"))  # raw newlines inside strings
    script = text("<html><head><script type='application/ld+json'>{broken</script><script type=\"application/ld+json\">", loose, "</script></head><body>x</body></html>")
    return t.v.select("source_key", F.lit(1).alias("page_no"), text("https://p.test/", col("native_id")).alias("url"), script.alias("body"))


JSONLD = expect(url="CASE WHEN n % 5 <> 0 THEN url ELSE 'https://p.test/' || native_id END", description="family || ' next line'", company="company",
                places="CASE WHEN n % 2 = 0 THEN target || ', ' || family || ', XX' ELSE target || ', Wide · ' || target || ', Wide · Remote, Anywhere' END")


@query("a5_jsonld_postings", JSONLD)
def a5(t: Tables) -> DataFrame:
    return shown(P.jsonld_to_postings(P.extract_jsonld(jsonld_pages(t)), NOW))


@query("a5_deep_jsonld", JSONLD)
def a5_deep(t: Tables) -> DataFrame:
    """Pages whose first script is nested too deeply to be read; the others are read as usual."""
    deep = F.concat(F.lit('<script type="application/ld+json">'), F.repeat(F.lit("["), 50_000), F.lit("</script>"))
    closed = F.concat(F.lit('<script type="application/ld+json">'), F.repeat(F.lit('{"a":['), 3000), F.repeat(F.lit("]}"), 3000), F.lit("</script>"))
    number = F.regexp_extract("url", r"(\d+)$", 1).cast("long")
    bodies = jsonld_pages(t).withColumn("body", F.concat(F.when(number % 100 == 0, deep).when(number % 100 == 1, closed).otherwise(F.lit("")), F.col("body")))
    return shown(P.jsonld_to_postings(P.extract_jsonld(bodies), NOW))


@query("a5a_posting_locations", f"WITH {V} SELECT source_key, native_id, n % 2 = 1 AS remote, CASE WHEN n % 2 = 0 THEN 1 ELSE 3 END::BIGINT AS places FROM v")
def a5a(t: Tables) -> DataFrame:
    found = P.jsonld_to_postings(P.extract_jsonld(jsonld_pages(t)), NOW)
    return found.select("source_key", "native_id", F.exists("locations", lambda x: x.startswith("Remote, ")).alias("remote"), F.size("locations").cast("bigint").alias("places"))


@query("a5b_merge_detail", f"""WITH {V} SELECT posting, CASE WHEN n % 2 = 0 THEN location ELSE target || ', Wide · ' || target || ', Wide · Remote, Anywhere' END AS places,
 posted_at, family || ' next line' AS description FROM v""")
def a5b(t: Tables) -> DataFrame:
    """Listing rows know their page and some of their places; the page supplies the rest."""
    found = P.jsonld_to_postings(P.extract_jsonld(jsonld_pages(t)), NOW).withColumn("page_url", text("https://p.test/", col("native_id")))
    listed = t.v.select("posting", text("https://p.test/", col("native_id")).alias("url"), F.lit("").alias("description"), F.lit(None).cast("timestamp").alias("posted_at"),
                        F.lit("unknown").alias("posted_precision"), F.when(N() % 2 == 0, F.array("location")).otherwise(F.array().cast("array<string>")).alias("locations"))
    out = P.merge_jsonld_detail(listed, found)
    return out.select("posting", F.array_join("locations", " · ").alias("places"), "posted_at", "description")


@query("a6_sitemap_frontier", f"""
WITH {V}, s AS (SELECT source_key, 'https://x.test/jobs/' || n AS url, CASE WHEN n % 3 <> 0 THEN posted_at END AS lastmod, n FROM v WHERE n % 4 <> 0),
f AS (SELECT * FROM s WHERE lastmod >= {NOW_SQL} - INTERVAL 31 DAY OR (lastmod IS NULL AND n % 5 <> 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY coalesce(lastmod, {NOW_SQL}) DESC, url) AS rank FROM f) SELECT source_key, url, rank FROM r""")
def a6(t: Tables) -> DataFrame:
    path = F.when(N() % 4 == 0, F.lit("about")).otherwise(F.lit("jobs"))
    loc = text("<url><loc><![CDATA[https://x.test/", path, "/", N().cast("string"), "]]></loc>", F.when((N() % 3 != 0) & day().isNotNull(), text("<lastmod>", day(), "</lastmod>")).otherwise(F.lit("")), "</url>")
    known = t.v.filter("n % 5 = 0").select(text(col("source_key"), ":https://x.test/jobs/", N().cast("string")).alias("key"))
    body = pages(t, loc, wrap("<urlset>", "</urlset>"))
    return X.sitemap_frontier(body, known, NOW, 30, "/jobs/").select("source_key", "url", F.col("rank").cast("bigint").alias("rank"))


LINKS_SQL = r"""
l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"[^>]*>', 1)) AS h FROM pages),
a AS (SELECT DISTINCT page_id, CASE WHEN regexp_matches(h, '^[a-z]+:') THEN h ELSE regexp_extract(url, '^[a-z]+://[^/?#]+') || h END AS href FROM l)"""


def site_pages(t: Tables) -> DataFrame:
    return t.pages.select(F.col("page_id").cast("string").alias("source_key"), "page_id", "url", F.col("html").alias("body"))


@query("a7_new_links", f"""WITH {LINKS_SQL}, m AS (SELECT *, length(href) % 3 = 0 AS known FROM a WHERE contains(href, '.example.'))
SELECT CAST(page_id AS VARCHAR) AS source_key, href FROM m WHERE NOT known AND page_id % 4 <> 0 AND page_id IN (SELECT page_id FROM m WHERE known)""")
def a7(t: Tables) -> DataFrame:
    p = site_pages(t)
    known = P.page_links(p).filter((F.length("href") % 3 == 0) & F.col("href").contains(".example.") & (F.col("source_key").cast("bigint") % 4 != 0))
    return P.new_links(p, known, known, r"\.example\.").select("source_key", "href")


@query("a7_first_observation_empty", f"""WITH {LINKS_SQL} SELECT CAST(page_id AS VARCHAR) AS source_key, href FROM a WHERE contains(href, '.example.') AND page_id % 3 = 0""")
def a7_empty(t: Tables) -> DataFrame:
    """Every third page was observed before and had no matching link then: all its links are new.  The others are seen for the first time."""
    p = site_pages(t)
    observed = p.filter(F.col("source_key").cast("bigint") % 3 == 0).select("source_key")
    known = P.page_links(p).select("source_key", "href").limit(0)
    return P.new_links(p, known, observed, r"\.example\.").select("source_key", "href")


@query("a7a_content_change", f"""SELECT CAST(page_id AS VARCHAR) AS source_key, 'page_change' AS kind, substr(sha1({duck.html_text('html')}), 1, 12) AS native_id FROM pages WHERE page_id % 3 = 1""")
def a7a(t: Tables) -> DataFrame:
    """Two snapshots: a third of the pages is new, a third changed, a third is the same."""
    p = site_pages(t)
    before = p.filter("page_id % 3 <> 0").select("source_key", F.when(F.col("page_id") % 3 == 1, F.lit("old")).otherwise(P.content_digest(F.col("body"))).alias("hash"))
    return P.content_change(p, before).select("source_key", "kind", "native_id")


def raw_mails(t: Tables) -> DataFrame:
    """An alert mail per thousand posting numbers and source, its links wrapped by a click tracker."""
    ident = (N() + 1000000).cast("string")
    direct = text("https://www.linkedin.com/comm/jobs/view/some-job-", ident, "?trk=mail")
    link = F.when(N() % 2 == 0, text("https://click.example.test/?url=", F.url_encode(direct))).otherwise(direct)
    label = F.when(N() % 3 == 0, F.lit("View job")).otherwise(xml_escape(col("title")))
    block = text("<table><tr><td><a href=\"", F.replace(link, F.lit("&"), F.lit("&amp;")), "\">", label, "</a></td></tr><tr><td>", F.when(N() % 3 == 0, xml_escape(col("title"))).otherwise(F.lit("")), "</td></tr><tr><td>", col("company"), " · ",
                 col("location"), "</td></tr></table>")
    sites = F.when(F.col("page_no") % 5 == 0, F.lit("Jobs <alerts@linkedin.com>")).when(F.col("page_no") % 5 == 1, F.lit("x@unknown.test")).otherwise(F.lit("LinkedIn <jobs-noreply@LinkedIn.com>"))
    body = pages(t, block, wrap("", '<p><a href="https://www.linkedin.com/psettings/unsubscribe">Unsubscribe</a> <a href="https://www.linkedin.com/t/opaque">A job behind a tracker</a></p>'))
    head = text("From: ", sites, "\r\nSubject: New jobs\r\nDate: Fri, 03 Aug 2001 08:00:00 ", F.when(F.col("page_no") % 2 == 0, F.lit("-0000")).otherwise(F.lit("+0200")),
                "\r\nMIME-Version: 1.0\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n<html><body>")
    uid = F.substring("source_key", 2, 9).cast("bigint") * 1000000 + F.col("page_no")
    return body.select(uid.alias("uid"), F.encode(F.concat(head, "body", F.lit("</body></html>\r\n")), "UTF-8").alias("content"))


PAGE_SQL = "SELECT DISTINCT CAST(substr(source_key, 2) AS BIGINT) * 1000000 + n // 1000 AS uid, n // 1000 AS page_no FROM v"


@query("a8_parse_alert_mails", f"""WITH {V} SELECT uid, CASE WHEN page_no % 5 = 0 THEN 'alerts@linkedin.com' WHEN page_no % 5 = 1 THEN 'x@unknown.test' ELSE 'jobs-noreply@LinkedIn.com' END AS sender, 'New jobs' AS subject,
 CASE WHEN page_no % 2 = 0 THEN TIMESTAMP '2001-08-03 08:00:00' ELSE TIMESTAMP '2001-08-03 06:00:00' END AS sent_at, NULL::VARCHAR AS error FROM ({PAGE_SQL})""")
def a8(t: Tables) -> DataFrame:
    return M.parse_messages(raw_mails(t)).select("uid", "sender", "subject", "sent_at", "error")


@query("a8a_route_by_sender", f"""SELECT doc_id, CASE source WHEN 'src0' THEN 'linkedin' WHEN 'src1' THEN 'jobup' WHEN 'src2' THEN 'ignore' WHEN 'src3' THEN 'model' ELSE 'ignore' END AS route FROM documents""")
def a8a(t: Tables) -> DataFrame:
    s = F.col("source")
    sender = (F.when(s == "src0", F.lit("Jobs@e.LinkedIn.com")).when(s == "src1", F.lit("alert@jobs.ch")).when(s == "src2", F.lit("spam@indeed.com"))
              .when(s == "src3", F.lit("news@board.test")).otherwise(F.lit("a@b.test")))
    return t.documents.select("doc_id", M.route_by_sender(sender, excluded=["spam@"], model_senders=["board.test"]).alias("route"))


@query("a8b_mail_links_to_postings", f"""WITH {V} SELECT CAST(substr(source_key, 2) AS BIGINT) * 1000000 + n // 1000 AS uid, CAST(n + 1000000 AS VARCHAR) AS native_id, title, company, location,
 'https://www.linkedin.com/jobs/view/' || (n + 1000000) || '/' AS url FROM v WHERE (n // 1000) % 5 <> 1""")
def a8b(t: Tables) -> DataFrame:
    messages = M.parse_messages(raw_mails(t)).withColumn("site", M.route_by_sender(F.col("sender")))
    links = M.mail_links(messages.filter("site <> 'ignore'"))
    found = M.links_to_postings(links.join(messages.select("uid", "site"), "uid"))
    return found.select("uid", "native_id", "title", "company", "location", "url")


@query("a8b_plain_text_mail", f"""WITH {V} SELECT CAST(substr(source_key, 2) AS BIGINT) * 1000000 + n // 1000 AS uid, CAST(n + 1000000 AS VARCHAR) AS native_id, title, company, location,
 'https://www.linkedin.com/jobs/view/' || (n + 1000000) || '/' AS url FROM v""")
def a8b_plain(t: Tables) -> DataFrame:
    """Alert mails without HTML: title, company, place, then the link of the posting."""
    ident = (N() + 1000000).cast("string")
    block = text(col("title"), "\n", col("company"), "\n", col("location"), "\nhttps://www.linkedin.com/comm/jobs/view/some-job-", ident, "?trk=mail\n\n")
    body = pages(t, block, wrap("", ""))
    uid = F.substring("source_key", 2, 9).cast("bigint") * 1000000 + F.col("page_no")
    links = M.mail_links(body.select(uid.alias("uid"), "body")).withColumn("site", F.lit("linkedin"))
    return M.links_to_postings(links).select("uid", "native_id", "title", "company", "location", "url")


@query("a8_plain_mail_to_postings", f"""WITH {V} SELECT CAST(substr(source_key, 2) AS BIGINT) * 1000000 + n // 1000 AS uid, CAST(n + 1000000 AS VARCHAR) AS native_id, title,
 company || ' <A&B>' AS company, location, 'https://www.linkedin.com/jobs/view/' || (n + 1000000) || '/' AS url FROM v""")
def a8_plain_mail(t: Tables) -> DataFrame:
    """From raw plain-text messages to postings; signs of markup in the text stay what they are."""
    ident = (N() + 1000000).cast("string")
    block = text(col("title"), "\r\n", col("company"), " <A&B>\r\n", col("location"), "\r\n<https://www.linkedin.com/comm/jobs/view/some-job-", ident, "?trk=mail>\r\n\r\n")
    head = "From: Jobs <alerts@linkedin.com>\r\nSubject: New jobs\r\nMIME-Version: 1.0\r\nContent-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"
    uid = F.substring("source_key", 2, 9).cast("bigint") * 1000000 + F.col("page_no")
    raw = pages(t, block, wrap(head, "")).select(uid.alias("uid"), F.encode(F.col("body"), "UTF-8").alias("content"))
    messages = M.parse_messages(raw).withColumn("site", M.route_by_sender(F.col("sender")))
    links = M.mail_links(messages).join(messages.select("uid", "site"), "uid")
    return M.links_to_postings(links).select("uid", "native_id", "title", "company", "location", "url")


@query("a8c_plain_text_blocks", """
WITH l AS (SELECT conv_id, turn, [trim(regexp_replace(x, '\\s+', ' ', 'g')) FOR x IN string_split(text, chr(10))] AS ls FROM conversations),
k AS (SELECT conv_id, turn, [x FOR x IN ls IF x <> ''] AS ls FROM l)
SELECT conv_id, turn, 0::BIGINT AS pos, coalesce(ls[1], '') AS title, greatest(len(ls) - 1, 0)::BIGINT AS rest, 'https://a.test/' || conv_id AS url FROM k
UNION ALL SELECT conv_id, turn, 1, coalesce(ls[1], ''), greatest(len(ls) - 1, 0), 'https://b.test/x' FROM k UNION ALL SELECT conv_id, turn, 2, 'Second', 0, 'https://c.test/' || turn FROM k""")
def a8c(t: Tables) -> DataFrame:
    """Each turn is a block closed by a line with two URLs, then a second block."""
    said = F.concat("text", F.lit("\n\nsee https://a.test/"), F.col("conv_id").cast("string"), F.lit(", https://b.test/x.\r\nSecond\nhttps://c.test/"), F.col("turn").cast("string"), F.lit("\ntrailing"))
    b = t.conversations.select("conv_id", "turn", F.posexplode(plain_text_blocks(said)).alias("pos", "b"))
    return b.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "b.title", F.size("b.rest").cast("bigint").alias("rest"), "b.url")


@query("a8d_opaque_links", f"WITH {V} SELECT uid, 'https://www.linkedin.com/t/opaque' AS href FROM ({PAGE_SQL}) WHERE page_no % 5 <> 1")
def a8d(t: Tables) -> DataFrame:
    messages = M.parse_messages(raw_mails(t)).withColumn("site", M.route_by_sender(F.col("sender"))).filter("site <> 'ignore'")
    links = M.mail_links(messages).join(messages.select("uid", "site"), "uid")
    return M.opaque_links(links).select("uid", "href")


@query("a8e_incremental_offset", """
WITH m AS (SELECT event_type AS box, max(event_id) FILTER (WHERE ts < TIMESTAMP '2024-01-29') AS last_uid FROM events GROUP BY 1),
f AS (SELECT event_type AS box, event_id AS uid FROM events JOIN m ON box = event_type WHERE event_id > last_uid OR event_type = 'view') SELECT box, uid FROM f""")
def a8e(t: Tables) -> DataFrame:
    mails = t.ev.select(F.col("event_type").alias("box"), F.lit("v2").alias("validity"), F.col("event_id").alias("uid"))
    state = t.ev.groupBy(F.col("event_type").alias("box")).agg(F.max(F.when(F.col("ts") < F.lit("2024-01-29").cast("timestamp"), F.col("event_id"))).alias("last_uid"))
    state = state.withColumn("validity", F.when(F.col("box") == "view", F.lit("v1")).otherwise(F.lit("v2")))
    return M.unread(mails, state).select("box", "uid")


@query("a8f_ground_extracted", r"""
WITH l AS (SELECT DISTINCT page_id AS uid, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"[^>]*>', 1)) AS h, url FROM pages)
SELECT DISTINCT uid, regexp_extract(url, '^[a-z]+://[^/?#]+') || regexp_extract(h, '^[^?#]*') AS url FROM l WHERE h LIKE '/%' AND uid % 3 <> 0""")
def a8f(t: Tables) -> DataFrame:
    """A model's rows: real links of the page, invented ones, and rows without title (every third page)."""
    links = P.page_links(site_pages(t)).withColumn("uid", F.col("source_key").cast("bigint"))
    root = F.regexp_extract("href", "^([^?#]*)", 1)
    same_site = links.join(t.pages.select(F.col("page_id").alias("uid"), F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0).alias("site")), "uid").filter(F.col("href").startswith(F.col("site")))
    title = F.when(F.col("uid") % 3 == 0, F.lit("  ")).otherwise(F.lit("Job"))
    real = same_site.select("uid", title.alias("title"), root.alias("url")).distinct()
    invented = real.select("uid", F.lit("Invented").alias("title"), F.concat("url", F.lit("/made-up")).alias("url"))
    tracked = same_site.withColumn("href", F.concat(root, F.lit("?utm_source=mail&trk=1")))
    return M.ground_extracted(real.unionByName(invented), tracked).select("uid", "url").distinct()


@query("a9_detect_source_type", """
SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'workday' WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'lever' WHEN 3 THEN 'oracle_hcm' WHEN 4 THEN 'eightfold' WHEN 5 THEN 'successfactors' WHEN 6 THEN 'brassring'
 WHEN 7 THEN 'personio' WHEN 8 THEN 'workable' WHEN 9 THEN 'workday' WHEN 10 THEN 'explicit' END AS type,
 CASE page_id % 12 WHEN 0 THEN 'Ext' WHEN 1 THEN 'b' || page_id WHEN 2 THEN 'api.eu.lever.co' WHEN 3 THEN 'S' || page_id WHEN 4 THEN 'd.test' WHEN 5 THEN 'c' || page_id WHEN 6 THEN '7' WHEN 9 THEN 'ten' END AS param FROM pages""")
def a9(t: Tables) -> DataFrame:
    """Own URLs of eleven kinds next to the pages' URLs, which match no rule."""
    p = F.col("page_id").cast("string")
    forms = [text("https://acme.wd3.myworkdayjobs.com/en-US/Ext/job/", p), text("https://boards.greenhouse.io/embed/job_board?for=b", p), text("https://jobs.eu.lever.co/acme/", p),
             text("https://x.fa.ocs.oraclecloud.eu/hcmUI/CandidateExperience/es/sites/S", p, "/job/1"), text("https://acme.eightfold.ai/careers?pid=", p, "&domain=d.test"),
             text("https://career5.successfactors.eu/career?company=c", p), text("https://sjobs.brassring.com/TGnewUI/Search/Home/Home?partnerid=5&SiteId=7#", p), text("https://acme.jobs.personio.de/job/", p),
             text("https://apply.workable.com/acme/j/", p), text("https://wd5.myworkdaysite.com/recruiting/ten/site/", p)]
    url = F.col("url")
    for i, form in enumerate(forms):
        url = F.when(F.col("page_id") % 12 == i, form).otherwise(url)
    found = t.pages.select("page_id", D.detect_source_type(url).alias("d"), F.when(F.col("page_id") % 12 == 10, F.lit("explicit")).alias("explicit"))
    names = {0: "site", 1: "board", 2: "api", 3: "site", 4: "domain", 5: "company", 6: "siteid", 9: "tenant"}
    param = F.lit(None).cast("string")
    for i, name in names.items():
        param = F.when(F.col("page_id") % 12 == i, F.try_element_at("d.params", F.lit(name))).otherwise(param)
    return found.select("page_id", F.coalesce("explicit", "d.type").alias("type"), param.alias("param"))


@query("a10_expand_search_grid", """
WITH q AS (SELECT CAST(c_nationkey AS VARCHAR) AS source_key, c_mktsegment || ' ' || (c_custkey % 20) AS query FROM customer GROUP BY ALL), p AS (SELECT CAST(s_nationkey AS VARCHAR) AS source_key, 'place ' || s_suppkey AS place FROM supplier)
SELECT source_key, query, place, page::BIGINT AS page, 'https://x.test/' || replace(lower(query), ' ', '-') || '?l=' || place || '&o=' || ((page - 1) * 20) AS url FROM q JOIN p USING (source_key), range(1, 4) r(page)
UNION ALL SELECT source_key, query, '', page, 'https://x.test/' || replace(lower(query), ' ', '-') || '?l=&o=' || ((page - 1) * 20) FROM q, range(1, 3) r(page)""")
def a10(t: Tables) -> DataFrame:
    q = t.customer.select(F.col("c_nationkey").cast("string").alias("source_key"), F.concat("c_mktsegment", F.lit(" "), (F.col("c_custkey") % 20).cast("string")).alias("query")).distinct()
    p = t.supplier.select(F.col("s_nationkey").cast("string").alias("source_key"), F.concat(F.lit("place "), F.col("s_suppkey").cast("string")).alias("place"))
    out = PG.expand_search_grid(q, p, 3, q, 2, "https://x.test/{query_slug}?l={location}&o={offset}")
    return out.withColumn("page", F.col("page").cast("bigint"))


def scanned(t: Tables) -> DataFrame:
    """Newest-first pages of a source: two weeks of posting dates each."""
    page = F.floor(F.datediff(F.lit("2001-08-02").cast("date"), F.col("seen_at")) / 14).cast("int")
    return t.v.select("source_key", page.alias("page_no"), F.col("posted_at").cast("timestamp").alias("posted_at"))


def cutoff_sql(test: str) -> str:
    return f"""WITH {V}, g AS (SELECT source_key, date_diff('day', seen_at, {NOW_SQL}) // 14 AS page_no, count(*) AS rows, {test} AS old FROM v GROUP BY ALL),
s AS (SELECT *, rows < 2 OR coalesce(old, false) AS last FROM g), b AS (SELECT *, coalesce(bool_or(last) OVER (PARTITION BY source_key ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM s)
SELECT source_key, page_no::BIGINT AS page_no, rows::BIGINT AS rows, last FROM b WHERE NOT done"""


for _rule, _test in (("any", f"bool_or(coalesce(posted_at < {NOW_SQL} - INTERVAL 1452 HOUR, false))"), ("oldest", f"min(posted_at) < {NOW_SQL} - INTERVAL 1452 HOUR"),
                     ("all", f"bool_and(coalesce(posted_at < {NOW_SQL} - INTERVAL 1452 HOUR, false))")):
    def _a11(t: Tables, rule: str = _rule) -> DataFrame:
        out = PG.pages_until_cutoff(scanned(t), NOW, 60, 2, rule, 0.5)
        return out.select("source_key", F.col("page_no").cast("bigint").alias("page_no"), F.col("rows").cast("bigint").alias("rows"), "last")
    query(f"a11_pages_until_cutoff_{_rule}", cutoff_sql(_test))(_a11)


@query("a12_facet_pick", """
WITH f AS (SELECT CAST(p_partkey % 40 AS VARCHAR) AS source_key, CASE WHEN p_partkey % 40 < 5 THEN 'jobFamily' WHEN p_size % 2 = 0 THEN 'locations' ELSE 'locationCountry' END AS param, p_brand AS id, p_type AS descriptor, p_size AS cnt FROM part),
h AS (SELECT source_key, param, sum(cnt)::BIGINT AS total, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM f WHERE param <> 'jobFamily' AND descriptor IN ('ECONOMY', 'SMALL') AND source_key <> '7' GROUP BY 1, 2),
b AS (SELECT source_key, arg_max(param, row(total, param)) AS param, arg_max(ids, row(total, param)) AS ids FROM h GROUP BY 1)
SELECT s.source_key, CASE WHEN b.param IS NOT NULL THEN 'chosen' WHEN CAST(s.source_key AS INT) < 5 THEN 'no facet' ELSE 'none' END AS outcome, param, ids FROM (SELECT DISTINCT source_key FROM f) s LEFT JOIN b USING (source_key)""")
def a12(t: Tables) -> DataFrame:
    """Facet payloads of 40 sites: values are nested one level; site 7 has no value in a configured place."""
    part = t.part.withColumn("source_key", (F.col("p_partkey") % 40).cast("string"))
    param = F.when(F.col("p_partkey") % 40 < 5, F.lit("jobFamily")).when(F.col("p_size") % 2 == 0, F.lit("locations")).otherwise(F.lit("locationCountry"))
    descriptor = F.when(F.col("source_key") == "7", F.concat(F.lit("no "), F.col("p_type"))).otherwise(F.col("p_type"))
    rows = part.groupBy("source_key", param.alias("p"), F.col("p_brand").alias("id"), descriptor.alias("d")).agg(F.sum("p_size").alias("c"))
    value = struct(id=col("id"), descriptor=col("d"), count=col("c"))
    nested = rows.groupBy("source_key", "p", "d").agg(F.collect_list(value).alias("values"))
    groups = nested.groupBy("source_key", "p").agg(F.collect_list(struct(descriptor=col("d"), values=col("values"))).alias("values"))
    body = groups.groupBy("source_key").agg(F.to_json(struct(facets=F.collect_list(struct(facetParameter=col("p"), values=col("values"))))).alias("body"))
    wanted = t.part.select(F.col("p_type").alias("descriptor")).distinct().filter("descriptor IN ('ECONOMY', 'SMALL')")
    out = PG.facet_pick(PG.flatten_facets(body), wanted)
    return out.select("source_key", "outcome", "param", F.array_join("ids", ",").alias("ids"))


@query("a13_validate_dimensions", """
WITH s AS (SELECT CASE WHEN s_suppkey % 10 = 3 THEN 's4' ELSE 's' || s_suppkey END AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'ghost' ELSE 'g' || (s_suppkey % 5) END AS grp, s_suppkey % 6 = 0 AS fav, s_suppkey % 8 = 1 AS bare, s_suppkey % 4 AS f FROM supplier)
SELECT 'duplicate id' AS rule, id AS subject FROM s GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'unknown group', id FROM s WHERE grp = 'ghost' UNION ALL SELECT 'favourite without its group', id FROM s WHERE fav
UNION ALL SELECT 'needs url or type', id FROM s WHERE bare UNION ALL SELECT 'unknown family', id || ':f3' FROM s WHERE f = 3
UNION ALL SELECT 'invalid time', 'g' || r_regionkey || ':25:00' FROM region WHERE r_regionkey % 2 = 0 UNION ALL SELECT 'invalid weekday', 'g' || r_regionkey || ':day' FROM region
UNION ALL SELECT 'invalid quiet hours', 'g' || r_regionkey FROM region WHERE r_regionkey = 3 UNION ALL SELECT 'route names collide', 'room'""")
def a13(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    sources = t.supplier.select(
        F.when(k % 10 == 3, F.lit("s4")).otherwise(F.concat(F.lit("s"), k.cast("string"))).alias("id"), F.when(k % 7 == 0, F.lit("ghost")).otherwise(F.concat(F.lit("g"), (k % 5).cast("string"))).alias("grp"),
        (k % 6 == 0).alias("favorite"), F.when(k % 8 == 1, F.lit("")).otherwise(F.lit("https://x")).alias("url"), F.lit(None).cast("string").alias("type"),
        F.array(F.concat(F.lit("f"), (k % 4).cast("string"))).alias("families"))
    r = F.col("r_regionkey")
    groups = t.region.select(F.concat(F.lit("g"), r.cast("string")).alias("grp"), F.array(F.lit("08:30"), F.when(r % 2 == 0, F.lit("25:00")).otherwise(F.lit("18:00"))).alias("times"),
                             F.array(F.lit("Monday"), F.lit("day")).alias("weekdays"), F.when(r == 3, F.lit("23-7")).otherwise(F.lit("23:00-07:00")).alias("quiet_hours"))
    families = t.nation.filter("n_nationkey < 3").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("family"))
    routes = t.region.filter("r_regionkey < 2").select(F.when(r == 0, F.lit("Room ")).otherwise(F.lit("room!")).alias("route"))
    return PG.validate_dimensions(sources, groups, families, routes)


