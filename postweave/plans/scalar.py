"""2.B scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as FV
from ..functions import dates, jsons, labels, status, text, urls
from . import duck
from .registry import NOW, NOW_SQL, V, Tables, query


@query("b1_normalize_text", f"SELECT doc_id, {duck.norm('text')} AS norm FROM documents")
def b1(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


@query("b2_fuzzy_company", f"""
WITH {V} SELECT posting, {duck.fuzzy_company("v.company || CASE WHEN n % 5 = 0 THEN ' J.P. y Cia S.A.' ELSE '' END")} AS company_key FROM v""")
def b2(t: Tables) -> DataFrame:
    spelled = F.concat("company", F.when(F.col("n") % 5 == 0, F.lit(" J.P. y Cia S.A.")).otherwise(F.lit("")))
    return t.v.select("posting", text.fuzzy_company(spelled).alias("company_key"))


PLACE_WORDS = ["africa", "america", "asia", "europe", "middle east", "green"]


@query("b3_fuzzy_title", f"""
WITH {V} SELECT posting, {duck.fuzzy_title("replace(lower(v.title || ' ' || v.location || ' ' || v.native_id), 'middle east', ' ')", duck.words(PLACE_WORDS))} AS title_key FROM v""")
def b3(t: Tables) -> DataFrame:
    title = F.concat_ws(" ", "title", "location", "native_id")
    return t.v.select("posting", text.fuzzy_title(title, PLACE_WORDS).alias("title_key"))


@query("b4_fingerprint", f"""
WITH {V}, w AS (SELECT *, CASE WHEN n % 11 = 0 THEN 'Ltd.' ELSE company END AS c FROM v)
SELECT posting, {duck.fingerprint('c', 'title', 'posting')} AS fp FROM w""")
def b4(t: Tables) -> DataFrame:
    company = F.when(F.col("n") % 11 == 0, F.lit("Ltd.")).otherwise(F.col("company"))
    return t.v.select("posting", text.fingerprint(company, F.col("title"), F.col("posting")).alias("fp"))


@query("b5_posting_key", f"WITH {V} SELECT source_key || ':' || native_id AS key, substr(sha1(posting), 1, 12) AS jid FROM v")
def b5(t: Tables) -> DataFrame:
    key = text.posting_key(F.col("source_key"), F.col("native_id"))
    return t.v.select(key.alias("key"), text.job_id(key).alias("jid"))


def _messy(c, n):
    """URLs with tracking, order and blank parameters, the same in both engines."""
    return F.concat(c, F.when(c.contains("#"), F.lit("")).otherwise(F.concat(
        F.when(c.contains("?"), F.lit("&")).otherwise(F.lit("?")),
        F.lit("z=a%20b&Utm_Medium=m&empty=&ref=r&id="), n.cast("string"), F.lit("#frag"))))


MESSY = ("url || CASE WHEN contains(url, '#') THEN '' ELSE CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || "
         "'z=a%20b&Utm_Medium=m&empty=&ref=r&id=' || page_id || '#frag' END")


@query("b6_canonical_url", f"WITH p AS (SELECT page_id, {MESSY} AS u FROM pages) SELECT page_id, {duck.canonical_url('u')} AS canonical FROM p")
def b6(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.canonical_url(_messy(F.col("url"), F.col("page_id"))).alias("canonical"))


@query("b7_strip_tracking", f"WITH p AS (SELECT page_id, {MESSY} AS u FROM pages) SELECT page_id, {duck.strip_tracking('u')} AS stripped FROM p")
def b7(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.strip_tracking(_messy(F.col("url"), F.col("page_id"))).alias("stripped"))


@query("b8_unwrap_redirect", "SELECT page_id, regexp_extract(url, '^[^?#]+') AS target FROM pages")
def b8(t: Tables) -> DataFrame:
    """Wrap each URL up to two times; unwrapping has to give the URL back."""
    plain = F.regexp_extract("url", "^[^?#]+", 0)
    once = F.concat(F.lit("https://click.example.test/c?u="), F.url_encode(plain))
    twice = F.concat(F.lit("https://mail.example.test/?x=1&Target="), F.url_encode(once))
    k = F.col("page_id") % 3
    pages = t.pages.select("page_id", F.when(k == 0, plain).when(k == 1, once).otherwise(twice).alias("w"))
    return pages.select("page_id", urls.unwrap_redirect(F.col("w")).alias("target"))


@query("b9_absolute_url", r"""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS href FROM pages),
a AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS origin,
 regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '[^/]*$', '') AS folder, href FROM l)
SELECT page_id, href, CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN href LIKE '/%' THEN origin || href
 ELSE origin || folder || href END AS absolute,
 origin || regexp_replace(folder, '[^/]+/$', '') || 'up/x?q=1' AS up, count(*)::BIGINT AS n FROM a GROUP BY ALL""")
def b9(t: Tables) -> DataFrame:
    links = t.pages.select("page_id", "url", F.explode(
        F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    return (links.select("page_id", "href", urls.absolute_url(F.col("url"), F.col("href")).alias("absolute"),
                         urls.absolute_url(F.col("url"), F.lit("../up/./x?q=1")).alias("up"))
            .groupBy("page_id", "href", "absolute", "up").agg(F.count("*").alias("n")))


@query("b10_html_to_text", f"SELECT page_id, {duck.html_text('html')} AS visible FROM pages")
def b10(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.html_to_text(F.col("html")).alias("visible"))


@query("b11_unwrap_cdata", """
SELECT doc_id, '<a>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</a>' || lang || 'x &amp; y' AS xml
FROM documents WHERE NOT contains(text, ']]>')""")
def b11(t: Tables) -> DataFrame:
    xml = F.concat(F.lit("<a><![CDATA["), "text", F.lit("]]></a>"), "lang", F.lit("<![CDATA[x & y]]>"))
    return t.documents.filter(~F.col("text").contains("]]>")).select("doc_id", text.unwrap_cdata(xml).alias("xml"))


@query("b12_slugs", f"""
WITH {V} SELECT posting, replace({duck.norm("title || ' Señor'")}, ' ', '-') AS slug,
 CASE WHEN trim(regexp_replace(lower(trim(title)), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'source'
  ELSE trim(regexp_replace(lower(trim(title)), '[^a-z0-9]+', '-', 'g'), '-') END AS slugify,
 substr(trim(regexp_replace(lower(trim('Ñu_' || title || ' ' || location)), '[^\\p{{L}}\\p{{N}}_-]+', '-', 'g'), '-'), 1, 100) AS route FROM v""")
def b12(t: Tables) -> DataFrame:
    return t.v.select(
        "posting", text.slug(F.concat("title", F.lit(" Señor"))).alias("slug"),
        text.slugify(F.col("title")).alias("slugify"),
        text.route_slug(F.concat(F.lit("Ñu_"), "title", F.lit(" "), "location")).alias("route"))


_REL = [("Posted {} Days Ago", 1440), ("hace {} horas", 60), ("il y a {}+ semaines", 10080), ("{}+ months ago", 43200),
        ("hace {} días", 1440), ("{} min ago", 1)]


def _relative_text():
    n = F.col("p_partkey") % 9
    out = F.when(n == 6, F.lit("Posted Today")).when(n == 7, F.lit("Ayer"))
    for i, (form, _) in enumerate(_REL):
        head, tail = form.split("{}")
        out = out.when(n == i, F.concat(F.lit(head), F.col("p_size").cast("string"), F.lit(tail)))
    return out.otherwise(F.lit("soon"))


@query("b13_parse_relative", f"""
SELECT p_partkey, CASE p_partkey % 9 {' '.join(f"WHEN {i} THEN {NOW_SQL} - to_minutes(CAST(p_size * {m} AS BIGINT))" for i, (_, m) in enumerate(_REL))}
 WHEN 6 THEN {NOW_SQL} WHEN 7 THEN {NOW_SQL} - INTERVAL 1 DAY ELSE NULL END AS ts FROM part""")
def b13(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", dates.parse_relative(_relative_text(), NOW).alias("ts"))


@query("b14_parse_date", f"""
SELECT o_orderkey, CASE WHEN k = 9 THEN NULL WHEN k = 8 THEN {NOW_SQL} - to_days(CAST(o_orderkey % 30 AS INT)) WHEN k = 3 AND day(d) > 12 THEN d
 WHEN k IN (4, 5) THEN d + INTERVAL 630723723 SECOND WHEN k = 1 THEN d + INTERVAL 3723 SECOND WHEN k = 3 THEN make_timestamp(year(d), day(d), month(d), 0, 0, 0) ELSE d END AS ts,
 CASE WHEN k = 9 THEN 'unknown' WHEN k = 8 THEN 'relative' WHEN k IN (1, 4, 5) THEN 'datetime' ELSE 'date' END AS prec
FROM (SELECT o_orderkey, o_orderdate AS d, o_orderkey % 10 AS k FROM orders)""")
def b14(t: Tables) -> DataFrame:
    d, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 10
    later = F.timestamp_seconds(F.unix_seconds(d) + 3723)
    written = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 1, F.date_format(later, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 2, F.date_format(d, "d/M/yyyy"))
        .when(k == 3, F.date_format(d, "MM/dd/yyyy"))
        .when(k == 4, (F.unix_seconds(later) + 630720000).cast("string"))
        .when(k == 5, ((F.unix_seconds(later) + 630720000) * 1000).cast("string"))
        .when(k == 6, F.date_format(d, "E, dd MMM yyyy"))
        .when(k == 7, F.date_format(d, "MMMM d, yyyy"))
        .when(k == 8, F.concat((F.col("o_orderkey") % 30).cast("string"), F.lit("+ days ago")))
        .otherwise(F.lit("as soon as possible")))
    parsed = t.orders.select("o_orderkey", dates.parse_date(written, NOW).alias("p"))
    return parsed.select("o_orderkey", "p.ts", F.col("p.precision").alias("prec"))


@query("b15_iso", f"""SELECT event_id, {duck.utc('ts')} AS iso, date_trunc('second', ts) AS back FROM events""")
def b15(t: Tables) -> DataFrame:
    text_ = dates.iso(F.col("ts"))
    return t.ev.select("event_id", text_.alias("iso"), dates.parse_iso(text_).alias("back"))


@query("b16_extract_experience", """
SELECT p_partkey, CASE WHEN k = 0 AND p_size BETWEEN 1 AND 28 THEN p_size WHEN k = 0 AND p_size + 2 <= 30 THEN p_size
 WHEN k = 0 AND p_size + 2 BETWEEN 1 AND 30 THEN p_size + 2 WHEN k IN (1, 2) AND p_size BETWEEN 1 AND 30 THEN p_size END::BIGINT AS lo,
 CASE WHEN k = 0 AND p_size BETWEEN 1 AND 28 THEN p_size + 2 END::BIGINT AS hi,
 CASE WHEN k = 0 AND p_size BETWEEN 1 AND 28 THEN p_size || '-' || (p_size + 2)
 WHEN k IN (1, 2) AND p_size BETWEEN 1 AND 30 THEN p_size || '+' END AS label
FROM (SELECT *, p_partkey % 4 AS k FROM part)""")
def b16(t: Tables) -> DataFrame:
    n, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    said = (F.when(n == 0, F.concat(F.lit("We ask for "), size, F.lit(" - "), (F.col("p_size") + 2).cast("string"),
                                    F.lit(" years of practice")))
            .when(n == 1, F.concat(F.lit("Al menos "), size, F.lit("+ años")))
            .when(n == 2, F.concat(F.lit("minimum of "), size, F.lit(" yrs")))
            .otherwise(F.concat(F.lit("founded "), size, F.lit(" days ago"))))
    e = t.part.select("p_partkey", text.extract_experience(said).alias("e"))
    return e.select("p_partkey", F.col("e.lo").cast("bigint").alias("lo"), F.col("e.hi").cast("bigint").alias("hi"),
                    "e.label")


@query("b17_location_text", f"""
WITH {V} SELECT posting, CASE WHEN n % 3 = 0 THEN location ELSE location || ' · ' || target END AS places FROM v""")
def b17(t: Tables) -> DataFrame:
    again = F.when(F.col("n") % 3 == 0, F.lit(None)).otherwise(F.col("target"))
    return t.v.select("posting", text.location_text(F.array("location", F.lit(""), again, "location")).alias("places"))


@query("b18_dig_as_list", r"""
SELECT event_id, regexp_extract(props, '"k":\s*(\d+)', 1) AS k, CAST(regexp_extract(props, '"k":\s*(\d+)', 1) AS BIGINT) % 7 AS last_item,
 CAST(NULL AS VARCHAR) AS missing, 1::BIGINT AS n_scalar, 3::BIGINT AS n_list FROM events""")
def b18(t: Tables) -> DataFrame:
    nested = F.parse_json(F.concat(F.lit('{"a": {"b": [{"c": 1}, '), "props", F.lit(", "),
                                   (F.get_json_object("props", "$.k").cast("bigint") % 7).cast("string"), F.lit("]}}")))
    e = t.ev.select("event_id", nested.alias("j"))
    return e.select(
        "event_id", jsons.dig(F.col("j"), "a.b[1].k").alias("k"),
        jsons.dig(F.col("j"), "a.b[-1]", "bigint").alias("last_item"),
        jsons.dig(F.col("j"), "a.x[3].c").alias("missing"),
        F.size(jsons.as_list(jsons.dig(F.col("j"), "a", "variant"))).cast("bigint").alias("n_scalar"),
        F.size(jsons.as_list(jsons.dig(F.col("j"), "a.b", "variant"))).cast("bigint").alias("n_list"))


@query("b19_render_template", """
SELECT n_nationkey, 'https://x.test/' || n_name || '?r=' || r_name || '&{page}' AS url, n_regionkey::BIGINT AS typed
FROM nation JOIN region ON r_regionkey = n_regionkey""")
def b19(t: Tables) -> DataFrame:
    j = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    values = {"nation": F.col("n_name"), "region": F.col("r_name"), "id": F.col("n_regionkey").cast("bigint")}
    return j.select("n_nationkey",
                    jsons.render_template("https://x.test/{nation}?r={region}&{page}", values).alias("url"),
                    jsons.render_template("{id}", values).alias("typed"))


@query("b20_text_part", r"""
WITH p AS (SELECT p_partkey, 'Online since: ' || p_type || ' ' || p_brand AS s FROM part)
SELECT p_partkey, regexp_extract(s, 'since: (\w+) Brand#(\d+)', 1) || ' ' || regexp_extract(s, 'since: (\w+) Brand#(\d+)', 2) AS groups_joined,
 regexp_extract(s, 'Brand#\d+') AS whole, regexp_extract(s, 'ECONOMY') AS maybe FROM p""")
def b20(t: Tables) -> DataFrame:
    s = F.concat(F.lit("Online since: "), "p_type", F.lit(" "), "p_brand")
    return t.part.select("p_partkey", text.text_part(s, r"since: (\w+) Brand#(\d+)").alias("groups_joined"),
                         text.text_part(s, r"Brand#\d+").alias("whole"), text.text_part(s, "ECONOMY").alias("maybe"))


@query("b21_is_title", f"""
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations)
SELECT conv_id, turn, count(*)::BIGINT AS lines,
 count(*) FILTER (WHERE length(line) BETWEEN 3 AND 150 AND NOT regexp_matches(regexp_replace(line, '^[ .:›>»]+|[ .:›>»]+$', '', 'g'), {duck.lit('(?i)' + FV.GENERIC_LINK_TEXT)}))::BIGINT AS titles
FROM l GROUP BY ALL""")
def b21(t: Tables) -> DataFrame:
    lines = t.conversations.select("conv_id", "turn", F.split("text", "\n").alias("lines"))
    return lines.select("conv_id", "turn", F.size("lines").cast("bigint").alias("lines"),
                        F.size(F.filter("lines", text.is_title)).cast("bigint").alias("titles"))


@query("b21_split_company_location", f"""
WITH {V} SELECT posting, company, CASE WHEN n % 3 = 2 THEN target ELSE location END AS place FROM v""")
def b21b(t: Tables) -> DataFrame:
    k = F.col("n") % 3
    lines = (F.when(k == 0, F.array("title", F.concat_ws(" · ", "company", "location"), F.lit("View job")))
             .when(k == 1, F.array(F.lit("View job"), F.concat_ws(" - ", "company", "location"), F.col("title")))
             .otherwise(F.array(F.lit("Apply now"), F.col("company"), F.col("target"))))
    s = t.v.select("posting", text.split_company_location(lines, F.col("title")).alias("s"))
    return s.select("posting", "s.company", F.col("s.location").alias("place"))


@query("b22_age_bucket", f"""
SELECT o_orderkey, CASE WHEN date_diff('day', o_orderdate, {NOW_SQL}) <= 1 THEN '_24_HOURS'
 WHEN date_diff('day', o_orderdate, {NOW_SQL}) <= 7 THEN '_7_DAYS' ELSE '_15_DAYS' END AS bucket FROM orders""")
def b22(t: Tables) -> DataFrame:
    age = F.datediff(dates.at(NOW), F.col("o_orderdate"))
    return t.orders.select("o_orderkey", dates.age_bucket(age).alias("bucket"))


@query("b23_display_when", f"""
WITH {V}, w AS (SELECT posting, n, CASE WHEN posted_at IS NOT NULL THEN posted_at + to_minutes(CAST(n % 1440 AS BIGINT)) END AS p, seen_at FROM v),
l AS (SELECT posting, n % 3 AS k, p IS NULL AS undated, timezone('Europe/Berlin', timezone('UTC', p)) AS lp,
 timezone('Europe/Berlin', timezone('UTC', seen_at)) AS ls, timezone('Europe/Berlin', timezone('UTC', {NOW_SQL})) AS ln FROM w)
SELECT posting, CASE WHEN undated THEN 'Detected ' || strftime(ls, '%d/%m %H:%M') WHEN k = 0 THEN 'Posted ' || strftime(lp, '%d/%m %H:%M')
 WHEN k = 1 AND CAST(lp AS DATE) = CAST(ln AS DATE) THEN 'Posted today (approx.)' WHEN k = 1 THEN 'Posted ~' || strftime(lp, '%d/%m')
 ELSE 'Posted ' || strftime(lp, '%d/%m') END AS shown FROM l""")
def b23(t: Tables) -> DataFrame:
    k = F.col("n") % 3
    posted = dates.minus_minutes(F.col("posted_at").cast("timestamp"), -(F.col("n") % 1440))
    precision = F.when(k == 0, F.lit("datetime")).when(k == 1, F.lit("relative")).otherwise(F.lit("date"))
    return t.v.select("posting", dates.display_when(
        posted, precision, F.col("seen_at").cast("timestamp"), NOW, "Europe/Berlin").alias("shown"))


@query("b24_iso_week", """SELECT event_id, isoyear(ts) || '-W' || lpad(CAST(weekofyear(ts) AS VARCHAR), 2, '0') AS week FROM events
UNION ALL SELECT o_orderkey + 100000000, isoyear(o_orderdate) || '-W' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') FROM orders""")
def b24(t: Tables) -> DataFrame:
    orders = t.orders.select((F.col("o_orderkey") + 100000000).alias("event_id"), F.col("o_orderdate").alias("ts"))
    return t.events.select("event_id", "ts").unionByName(orders).select(
        "event_id", dates.iso_week(F.col("ts")).alias("week"))


@query("b14_written_dates", f"""
WITH {V}, m AS (SELECT *, extract(month FROM seen_at)::INT AS mo, extract(day FROM seen_at)::INT AS d, extract(year FROM seen_at)::INT AS y FROM v)
SELECT posting, make_timestamp(y, mo, d, 0, 0, 0) AS ts, 'date' AS prec FROM m""")
def b14_written(t: Tables) -> DataFrame:
    """The same day written out in English, Spanish, French and German."""
    day, year = F.dayofmonth("seen_at").cast("string"), F.year("seen_at").cast("string")
    def month(lang: str) -> Column:
        return F.get(F.array(*[F.lit(m) for m in dates.MONTHS[lang].split()]), F.month("seen_at") - 1)
    written = (F.when(F.col("n") % 4 == 0, F.concat_ws(" ", day, F.initcap(month("en")), year)).when(F.col("n") % 4 == 1, F.concat(day, F.lit(" de "), month("es"), F.lit(" de "), year))
               .when(F.col("n") % 4 == 2, F.concat_ws(" ", day, month("fr"), year)).otherwise(F.concat(day, F.lit(". "), F.initcap(month("de")), F.lit(" "), year)))
    p = dates.parse_date(written, NOW)
    return t.v.select("posting", p["ts"].alias("ts"), p["precision"].alias("prec"))


@query("b25_empty_object", f"""
WITH {V} SELECT posting, '{{"title":"' || title || '"' || CASE WHEN n % 5 = 0 THEN '' ELSE ',"by":{{"name":"' || company || '"}}' END || '}}' AS js FROM v""")
def b25_empty(t: Tables) -> DataFrame:
    """An object left without fields goes, too."""
    by = jsons.object_or_null(name=F.when(F.col("n") % 5 != 0, F.col("company")), site=F.lit(None).cast("string"))
    return t.v.select("posting", jsons.prune_nulls(title=F.col("title"), by=by).alias("js"))


@query("b10_other_entities", f"""WITH {V} SELECT posting, 'München – España €' || n || ' "' || title || '" &lt;' AS visible FROM v""")
def b10_entities(t: Tables) -> DataFrame:
    """Named, decimal and hexadecimal references, and an escaped reference that stays one."""
    html = F.concat(F.lit("<p>M&uuml;nchen &#8211; Espa&ntilde;a &#x20AC;"), F.col("n").cast("string"), F.lit(" &quot;"), F.col("title"), F.lit("&#34; &amp;lt;</p>"))
    return t.v.select("posting", text.html_to_text(html).alias("visible"))


@query("b1_ligatures", f"""WITH {V} SELECT posting, 'office iv 1 2 fluss ' || n AS norm FROM v""")
def b1_ligatures(t: Tables) -> DataFrame:
    return t.v.select("posting", text.normalize_text(F.concat(F.lit("oﬃce Ⅳ ½ ﬂuſs "), F.col("n").cast("string"))).alias("norm"))


@query("b25_prune_nulls", f"""
WITH {V} SELECT posting, '{{"title":"' || title || '"' || CASE WHEN posted_at IS NULL THEN '' ELSE ',"posted":"' || strftime(posted_at, '%Y-%m-%d') || '"' END
 || CASE WHEN n % 2 = 0 THEN ',"tags":["' || family || '"]' ELSE '' END || CASE WHEN n % 5 = 0 THEN '' ELSE ',"by":{{"name":"' || company || '"}}' END || '}}' AS js FROM v""")
def b25(t: Tables) -> DataFrame:
    by = F.when(F.col("n") % 5 != 0, F.struct(F.col("company").alias("name")))
    tags = F.when(F.col("n") % 2 == 0, F.array("family")).otherwise(F.array().cast("array<string>"))
    return t.v.select("posting", jsons.prune_nulls(
        title=jsons.null_if_empty(F.col("title")), empty=jsons.null_if_empty(F.lit("")),
        posted=F.date_format("posted_at", "yyyy-MM-dd"), tags=jsons.null_if_no_items(tags), by=by).alias("js"))


STATUS_OF_EVENT = {"view": "Interesada", "click": "✅ Aplicada", "purchase": "OFERTA", "signup": "entrevistas",
                   "error": "on hold"}


@query("b26_parse_status", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'interested' WHEN 'click' THEN 'applied' WHEN 'purchase' THEN 'offer'
 WHEN 'signup' THEN 'interview' END AS status, event_type IN ('click', 'error') AS same FROM events""")
def b26(t: Tables) -> DataFrame:
    word = F.create_map(*[F.lit(x) for p in STATUS_OF_EVENT.items() for x in p])[F.col("event_type")]
    other = F.when(F.col("event_type") == "error", F.lit("On-hold!")).otherwise(F.lit("applied"))
    return t.ev.select("event_id", status.parse_status(word).alias("status"),
                       status.same_status(word, other).alias("same"))


@query("b27_split_history", """
WITH e AS (SELECT event_id, ts, event_type, user_id FROM events)
SELECT event_id, 0::BIGINT AS seq, strftime(ts, '%Y-%m-%d') AS day, event_type AS word FROM e
UNION ALL SELECT event_id, 1, NULL, '2026-09-31 ' || event_type FROM e
UNION ALL SELECT event_id, 2, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d'), 'on hold' FROM e""")
def b27(t: Tables) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    history = F.concat(day, F.lit(" "), "event_type", F.lit("; 2026-09-31 "), "event_type", F.lit(" ; ; "),
                       F.date_format(F.date_add("ts", 1), "yyyy-MM-dd"), F.lit(" on hold (manual)"))
    e = t.ev.select("event_id", F.posexplode(status.split_history(history)).alias("seq", "h"))
    return e.select("event_id", F.col("seq").cast("bigint").alias("seq"),
                    F.date_format("h.day", "yyyy-MM-dd").alias("day"), F.col("h.status").alias("word"))


CRITERIA = {"families": ["BUILDING", "MACHINERY"], "filters": {"exclude_title_any": ["ring"]}, "language": "en", "v": 1}


@query("b28_criteria_hash", f"WITH {V} SELECT posting, '{jsons.criteria_hash(CRITERIA)}' AS criteria FROM v WHERE family IN ('BUILDING', 'MACHINERY')")
def b28(t: Tables) -> DataFrame:
    return t.v.filter(F.col("family").isin(CRITERIA["families"])).select(
        "posting", F.lit(jsons.criteria_hash(CRITERIA)).alias("criteria"))


def _replies(t: Tables) -> DataFrame:
    """Model replies of every shape, made from conversation turns."""
    n = F.col("conv_id") + F.col("turn")
    item = F.to_json(F.struct(F.col("turn").alias("id"), (n * 17 % 150).alias("score"),
                              F.when(n % 3 == 0, F.lit("user")).otherwise(F.lit("ghost")).alias("family"),
                              (n % 2 == 0).alias("front_office"), F.col("text").alias("reason")))
    obj = F.concat(F.lit('{"results": ['), item, F.lit("]}"))
    return t.conversations.select("conv_id", "turn", n.alias("n"), "text", F.when(n % 5 == 0, obj)
                                  .when(n % 5 == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
                                  .when(n % 5 == 2, F.concat(F.lit("Sure! "), obj, F.lit(" Done.")))
                                  .when(n % 5 == 3, F.concat(F.lit("["), item, F.lit("]")))
                                  .otherwise(F.lit("42")).alias("reply"))


@query("b29_parse_model_reply", "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 4 THEN -1 ELSE 1 END::BIGINT AS results FROM conversations")
def b29(t: Tables) -> DataFrame:
    return _replies(t).select("conv_id", "turn", F.coalesce(
        F.size(jsons.parse_model_reply(F.col("reply"))), F.lit(-1)).cast("bigint").alias("results"))


@query("b30_to_verdict", """
SELECT conv_id, turn, least(100, n * 17 % 150)::BIGINT AS score, CASE WHEN n % 3 = 0 THEN 'user' END AS family,
 (n % 2 = 0) AS front_office, nullif(text, '') AS reason
FROM (SELECT *, conv_id + turn AS n FROM conversations) WHERE n % 5 <> 4""")
def b30(t: Tables) -> DataFrame:
    results = _replies(t).select("conv_id", "turn", F.explode(jsons.parse_model_reply(F.col("reply"))).alias("r"))
    v = results.select("conv_id", "turn", jsons.to_verdict(F.col("r"), ["user", "assistant"]).alias("v"))
    return v.select("conv_id", "turn", F.col("v.score").cast("bigint").alias("score"), "v.family", "v.front_office",
                    "v.reason")


@query("b31_label_of", """
SELECT event_id, CASE WHEN event_type = 'view' THEN CASE WHEN user_id % 2 = 0 THEN '⭐ Interesa' ELSE '⭐ Interested' END
 WHEN event_type = 'click' THEN CASE WHEN user_id % 2 = 0 THEN '✅ Aplicado' ELSE '✅ Applied' END ELSE 'st_' || event_type END AS label FROM events""")
def b31(t: Tables) -> DataFrame:
    name = F.concat(F.lit("st_"), F.when(F.col("event_type") == "view", F.lit("interested"))
                    .when(F.col("event_type") == "click", F.lit("applied")).otherwise(F.col("event_type")))
    lang = F.when(F.col("user_id") % 2 == 0, F.lit("es")).otherwise(F.lit("xx"))
    return t.ev.select("event_id", labels.label_of(name, lang).alias("label"))


@query("b32_md_and_xml", """
SELECT r_name || '|' || n_name AS nation_key, '| ' || r_name || '\\|' || n_name || ' | ' || sum(o_orderkey)::BIGINT || ' |' AS md,
 'a &amp; b &lt;' || r_name || '&gt;' AS xml FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
 JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, n_name""")
def b32(t: Tables) -> DataFrame:
    j = (t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
         .join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
         .join(t.region, F.col("r_regionkey") == F.col("n_regionkey")))
    g = j.groupBy("r_name", "n_name").agg(F.sum("o_orderkey").alias("total"))
    name = F.concat_ws("|", "r_name", "n_name")
    return g.select(name.alias("nation_key"), text.md_row(name, F.col("total")).alias("md"),
                    text.xml_escape(F.concat(F.lit("a & b <"), "r_name", F.lit(">"))).alias("xml"))
