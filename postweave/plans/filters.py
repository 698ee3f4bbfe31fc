"""2.C filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import local
from ..functions.text import normalize_text
from ..operators import keywords as K
from ..operators import places as P
from ..operators import waterfall as W
from . import duck
from .registry import NOW, NOW_SQL, V, Tables, query

# Keywords in configuration order, which is not text order.
DOC_KEYWORDS = ["the and", "für", "não", "whst*", "éo*", "of", "la"]


def has(norm: str, keyword: str) -> str:
    prefix = keyword.endswith("*")
    bare = keyword.rstrip("*").replace("é", "e").replace("ü", "u").replace("ã", "a").lower()
    return f"regexp_matches({norm}, '(^|[^\\p{{L}}\\p{{N}}_]){bare}" + ("')" if prefix else "([^\\p{L}\\p{N}_]|$)')")


def first_of(norm: str, keywords) -> str:
    return "CASE " + " ".join(f"WHEN {has(norm, k)} THEN '{k}'" for k in keywords) + " END"


@query("c1_find_keyword", f"""
WITH d AS (SELECT doc_id, {duck.norm('text')} AS norm FROM documents) SELECT doc_id, {first_of('norm', DOC_KEYWORDS)} AS keyword FROM d""")
def c1(t: Tables) -> DataFrame:
    norm = normalize_text(F.col("text"))
    d = t.documents.select("doc_id", norm.alias("norm"))
    return d.select("doc_id", K.find_keyword(F.col("norm"), DOC_KEYWORDS).alias("keyword"))


@query("c1_find_keyword_join", """
WITH kw AS (SELECT item_id AS ord, word FROM (SELECT item_id, lower(regexp_extract(text, '([A-Za-z]+ [A-Za-z]+)', 1)) AS word FROM benchmark) WHERE word <> ''),
d AS (SELECT doc_id, ' ' || """ + duck.norm('text') + """ || ' ' AS norm FROM documents)
SELECT doc_id, (SELECT min_by(word, ord) FROM kw WHERE contains(norm, ' ' || word || ' ')) AS keyword FROM d""")
def c1_join(t: Tables) -> DataFrame:
    """The first two words of every benchmark item are the keyword table."""
    word = F.lower(F.regexp_extract("text", "([A-Za-z]+ [A-Za-z]+)", 1))
    table = t.benchmark.select(F.col("item_id").alias("ord"), word.alias("keyword"), word.alias("norm")).filter("keyword <> ''")
    docs = t.documents.select("doc_id", normalize_text(F.col("text")).alias("n"))
    return K.find_keyword_join(docs, "doc_id", F.col("n"), table).select("doc_id", "keyword")


@query("c1_find_keyword_long", """
WITH b AS (SELECT item_id AS ord, """ + duck.norm('text') + """ AS n FROM benchmark),
kw AS (SELECT 2 * ord AS ord, array_to_string(string_split(n, ' ')[1:5], ' ') AS word, false AS open FROM b WHERE len(string_split(n, ' ')) >= 5
 UNION ALL SELECT 2 * ord + 1, string_split(n, ' ')[1] || ' ' || substr(string_split(n, ' ')[2], 1, 4), true FROM b WHERE length(string_split(n, ' ')[2]) > 4),
d AS (SELECT doc_id, ' ' || """ + duck.norm('text') + """ || ' ' AS norm FROM documents)
SELECT doc_id, (SELECT min_by(CASE WHEN open THEN word || '*' ELSE word END, ord) FROM kw WHERE contains(norm, ' ' || word || CASE WHEN open THEN '' ELSE ' ' END)) AS keyword FROM d""")
def c1_long(t: Tables) -> DataFrame:
    """Keywords of five words, and two-word ones that end in the middle of a word."""
    b = t.benchmark.select(F.col("item_id").alias("ord"), F.split(normalize_text(F.col("text")), " ").alias("w"))
    five = b.filter(F.size("w") >= 5).select((F.col("ord") * 2).alias("ord"), F.array_join(F.slice("w", 1, 5), " ").alias("norm"))
    second = F.try_element_at("w", F.lit(2))
    begun = b.filter(F.length(second) > 4).select((F.col("ord") * 2 + 1).alias("ord"), F.concat(F.get("w", F.lit(0)), F.lit(" "), F.substring(second, 1, 4)).alias("norm"))
    table = five.withColumn("keyword", F.col("norm")).unionByName(begun.withColumn("keyword", F.concat("norm", F.lit("*"))))
    docs = t.documents.select("doc_id", normalize_text(F.col("text")).alias("n"))
    return K.find_keyword_join(docs, "doc_id", F.col("n"), table).select("doc_id", "keyword")


@query("c2_excluded", f"""
WITH d AS (SELECT d.doc_id, d.source, {duck.norm("string_split(d.text, chr(10))[1]")} AS title, {duck.norm("d.text")} AS norm, coalesce(toxic, 0) AS toxic
 FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, coalesce('title:' || coalesce({first_of('title', ['für', 'erst*'])}, CASE WHEN source = 'src1' THEN {first_of('title', ['of', 'la*'])} END),
 'text:' || {first_of('norm', ['whst', 'les'])}) AS reason, toxic::BIGINT AS toxic FROM d""")
def c2(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels.select("doc_id", "toxic"), "doc_id", "left").select(
        "doc_id", "source", F.coalesce("toxic", F.lit(0)).cast("bigint").alias("toxic"),
        normalize_text(F.get(F.split("text", "\n"), F.lit(0))).alias("title"), normalize_text(F.col("text")).alias("norm"))
    own = F.when(F.col("source") == "src1", F.array(F.lit("of"), F.lit("la*"))).otherwise(F.array().cast("array<string>"))
    reason = K.excluded(F.col("title"), F.col("norm"), ["für", "erst*"], ["whst", "les"], own)
    return d.select("doc_id", reason.alias("reason"), "toxic")


FAMILIES = [("metal", ["steel", "anodized*"]), ("small", ["small ring", "tiny"]), ("rings", ["ring"]), ("red", ["red"])]


@query("c3_family_by_keywords", f"""
WITH {V}, w AS (SELECT posting, source_key, {duck.norm('title')} AS t FROM v),
x AS (SELECT *, CASE source_key WHEN 's1' THEN ['red', 'rings'] WHEN 's2' THEN [] END AS allowed FROM w)
SELECT posting, CASE WHEN source_key IN ('s1', 's3') AND {has('t', 'widget')} THEN CASE source_key WHEN 's1' THEN 'red' ELSE 'match' END
 {' '.join("WHEN (allowed IS NULL OR list_contains(allowed, '" + n + "')) AND (" + ' OR '.join(has('t', k) for k in ks) + ") THEN '" + n + "'" for n, ks in FAMILIES)} END AS family FROM x""")
def c3(t: Tables) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    empty = F.array().cast("array<string>")
    allowed = (F.when(F.col("source_key") == "s1", F.array(F.lit("red"), F.lit("rings")))
               .when(F.col("source_key") == "s2", empty).otherwise(none))
    own = F.when(F.col("source_key").isin("s1", "s3"), F.array(F.lit("widget"))).otherwise(empty)
    return t.v.select("posting", K.family_by_keywords(
        normalize_text(F.col("title")), FAMILIES, allowed, own).alias("family"))


@query("c4_experience_out_of_range", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN coalesce(p_size BETWEEN 1 AND 30 AND p_size > 11, false)
 WHEN 1 THEN CASE WHEN p_size BETWEEN 1 AND 28 THEN p_size > 11 OR p_size + 2 < 4 WHEN p_size + 2 BETWEEN 1 AND 30 THEN p_size + 2 > 11 ELSE false END ELSE false END AS out_of_range FROM part""")
def c4(t: Tables) -> DataFrame:
    n = F.col("p_size").cast("string")
    said = (F.when(F.col("p_partkey") % 3 == 0, F.concat(n, F.lit("+ years")))
            .when(F.col("p_partkey") % 3 == 1, F.concat(n, F.lit("-"), (F.col("p_size") + 2).cast("string"), F.lit(" años")))
            .otherwise(F.lit("no years given")))
    return t.part.select("p_partkey", W.experience_out_of_range(said, 5, 10).alias("out_of_range"))


@query("c5_is_fresh", f"""
WITH {V} SELECT posting, posted_at FROM v WHERE coalesce(posted_at, seen_at + INTERVAL 30 DAY, {NOW_SQL}) >= {NOW_SQL} - INTERVAL 400 DAY""")
def c5(t: Tables) -> DataFrame:
    v = t.v.withColumn("first_seen", F.timestamp_seconds(F.unix_seconds(F.col("seen_at").cast("timestamp")) + 30 * 86400))
    v = v.withColumn("posted_at", F.col("posted_at").cast("timestamp"))
    return v.filter(W.is_fresh(F.col("posted_at"), F.col("first_seen"), NOW, 400)).select("posting", "posted_at")


# --- places: the gazetteer is made of regions (countries) and nations (cities) ---------------------------------
def gazetteer(t: Tables) -> tuple[DataFrame, DataFrame]:
    iso2, iso3 = F.substring("r_name", 1, 2), F.substring("r_name", 1, 3)
    countries = t.region.select(iso2.alias("iso2"), iso3.alias("iso3"),
                                F.array("r_name", F.concat(F.lit("Le "), F.initcap("r_name"))).alias("names"))
    cities = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.col("n_name").alias("name"), F.array(F.concat(F.lit("Ville "), F.col("n_nationkey").cast("string")), F.lit("N1")).alias("names"),
        iso2.alias("iso2"), (F.col("n_nationkey") * 10000).alias("population"))
    return P.build_gazetteer(countries, cities), cities


PLACES = [P.Place("EU", "NATION_3"), P.Place("MI", "NATION_4", ("Harbour City",)), P.Place(None, "Nation_12", label="Twelve"),
          P.Place("EU", include_remote=False, label="Europe"), P.Place("AM", label="Americas"), P.Place("AS", label="Asia")]


def spelled(t: Tables) -> DataFrame:
    """Postings whose location is written in eight ways."""
    k = F.col("n") % 8
    city, country = F.substring_index("location", ", ", 1), F.col("target")
    number = F.regexp_extract("location", r"NATION_(\d+)", 1)
    loc = (F.when(k == 0, F.col("location")).when(k == 1, city)
           .when(k == 2, F.concat(F.substring(country, 1, 3), F.lit("-"), F.lit("Somewhere")))
           .when(k == 3, F.concat(city, F.lit(", "), F.lit("XX, "), F.substring(country, 1, 2), F.lit(", 20095")))
           .when(k == 4, F.concat(F.lit("Remote - "), F.lower(country)))
           .when(k == 5, F.lit("")).when(k == 6, F.concat(F.lit("Ville "), number)).otherwise(F.concat(F.lit("Harbour city, "), F.when(F.col("n") % 16 == 7, F.lit("MIDDLE EAST")).otherwise(F.lit("AFRICA")))))
    return t.v.select("posting", "n", loc.alias("loc"), F.when(k == 5, F.array().cast("array<string>"))
                      .otherwise(F.array(F.lit("nowhere"), loc)).alias("locations"))


# mentioned: the country named or coded; city: the nation named; major: its country when populous.
READ_SQL = f"""
{V}, s AS (SELECT posting, n, n % 8 AS k, target AS country, substr(target, 1, 2) AS iso2, regexp_extract(location, 'NATION_(\\d+)', 1)::INT AS nation,
 CASE n % 8 WHEN 0 THEN location WHEN 1 THEN split_part(location, ', ', 1) WHEN 2 THEN substr(target, 1, 3) || '-Somewhere'
 WHEN 3 THEN split_part(location, ', ', 1) || ', XX, ' || substr(target, 1, 2) || ', 20095' WHEN 4 THEN 'Remote - ' || lower(target) WHEN 5 THEN ''
 WHEN 6 THEN 'Ville ' || regexp_extract(location, 'NATION_(\\d+)', 1) ELSE 'Harbour city, ' || CASE WHEN n % 16 = 7 THEN 'MIDDLE EAST' ELSE 'AFRICA' END END AS loc FROM v),
m AS (SELECT *, CASE WHEN k IN (0, 2, 3, 4) THEN iso2 WHEN k = 7 AND n % 16 = 7 THEN 'MI' WHEN k = 7 THEN 'AF' END AS mentioned,
 CASE WHEN k IN (0, 1, 3) OR k = 6 AND nation IN (3, 4, 12) THEN nation WHEN k = 7 THEN 4 END AS city, CASE WHEN k IN (0, 1, 3, 6) AND nation >= 5 THEN iso2 END AS major FROM s)"""
# A nation's other names reach its population only through its own name, so "Ville 7" is no major city.
READ_SQL = READ_SQL.replace("WHEN k IN (0, 1, 3, 6) AND nation >= 5", "WHEN k IN (0, 1, 3) AND nation >= 5")
TARGET_SQL = """CASE WHEN city = 3 AND (mentioned IS NULL OR mentioned = 'EU') THEN 'NATION_3'
 WHEN city = 4 AND (mentioned IS NULL OR mentioned = 'MI') THEN 'NATION_4' WHEN city = 12 THEN 'Twelve'
 WHEN (mentioned = 'EU' AND k <> 4) OR (mentioned IS NULL AND major = 'EU') THEN 'Europe'
 WHEN mentioned = 'AM' OR (mentioned IS NULL AND major = 'AM') THEN 'Americas'
 WHEN mentioned = 'AS' OR (mentioned IS NULL AND major = 'AS') THEN 'Asia' END"""


@query("c6_location_match", f"WITH {READ_SQL} SELECT posting, {TARGET_SQL} AS target FROM m")
def c6(t: Tables) -> DataFrame:
    geo, cities = gazetteer(t)
    aliases = P.city_aliases(PLACES, cities, geo)
    return P.match_places(spelled(t), "posting", "locations", PLACES, geo, aliases).select("posting", "target")


@query("c6a_countries_in", f"WITH {READ_SQL} SELECT DISTINCT loc, coalesce(mentioned, '') AS countries FROM m WHERE loc <> ''")
def c6a(t: Tables) -> DataFrame:
    geo, _ = gazetteer(t)
    read = P.read_locations(spelled(t).select("loc").filter("loc <> ''").distinct(), geo)
    return read.select("loc", F.array_join(F.array_sort("mentioned"), ",").alias("countries"))


@query("c6b_resolve_country", """
SELECT posting, v AS value, CASE WHEN k < 4 THEN substr(target, 1, 2) END AS iso2 FROM (SELECT posting, target, k, CASE k WHEN 0 THEN lower(substr(target, 1, 2))
 WHEN 1 THEN substr(target, 1, 3) WHEN 2 THEN target WHEN 3 THEN ' le ' || lower(target) ELSE 'Atlantis' END AS v FROM (
 WITH """ + V + """ SELECT posting, target, n % 5 AS k FROM v))""")
def c6b(t: Tables) -> DataFrame:
    geo, _ = gazetteer(t)
    k, r = F.col("n") % 5, F.col("target")
    value = (F.when(k == 0, F.lower(F.substring(r, 1, 2))).when(k == 1, F.substring(r, 1, 3)).when(k == 2, r)
             .when(k == 3, F.concat(F.lit(" le "), F.lower(r))).otherwise(F.lit("Atlantis")))
    return P.resolve_country(t.v.select("posting", value.alias("value")), "value", geo).select("posting", "value", "iso2")


@query("c7_coverage_match", f"""
WITH d AS (SELECT doc_id, source, {duck.norm('text')} AS norm FROM documents)
SELECT doc_id, {has('norm', 'the')} OR {has('norm', 'la')} AS anywhere, ({has('norm', 'the')} OR {has('norm', 'la')}) AND source IN ('src1', 'src3') AS in_cities FROM d""")
def c7(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.array(F.concat(F.lit("Office "), "source")).alias("locs"), normalize_text(F.col("text")).alias("n"))
    return d.select("doc_id", P.match_coverage(F.col("locs"), F.col("n"), ["The", "là"]).alias("anywhere"),
                    P.match_coverage(F.col("locs"), F.col("n"), ["The", "là"], ["src1", "SRC3"]).alias("in_cities"))


@query("c7a_location_ok", f"""
WITH {V} SELECT posting, source_key = 's4' OR kind = 'page_change' OR n % 7 = 0 OR target = 'ASIA' OR n % 13 = 0 AS ok FROM v""")
def c7a(t: Tables) -> DataFrame:
    locs = F.when(F.col("n") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("location"))
    place = F.when(F.col("target") == "ASIA", F.col("target"))
    return t.v.select("posting", W.location_ok(locs, place, F.col("n") % 13 == 0, F.col("kind"),
                                               F.col("source_key") == "s4").alias("ok"))


@query("c8_in_quiet_hours", """
WITH e AS (SELECT event_id, strftime(timezone('America/New_York', timezone('UTC', ts)), '%H:%M') AS h FROM events)
SELECT event_id, h >= '23:00' OR h < '07:30' AS night, h >= '12:00' AND h < '13:00' AS noon FROM e""")
def c8(t: Tables) -> DataFrame:
    at = local(F.col("ts"), "America/New_York")
    return t.ev.select("event_id", W.in_quiet_hours(at, "23:00-07:30").alias("night"),
                       W.in_quiet_hours(at, "12:00-13:00").alias("noon"))


@query("c9_accept_verdict", f"""
WITH {V} SELECT posting, CASE WHEN score < 40 THEN 'ai_score' WHEN source_key = 's1' AND family NOT IN ('BUILDING', 'MACHINERY') THEN 'source_family' END AS refusal FROM v""")
def c9(t: Tables) -> DataFrame:
    allowed = (F.when(F.col("source_key") == "s1", F.array(F.lit("BUILDING"), F.lit("MACHINERY")))
               .when(F.col("source_key") == "s2", F.array().cast("array<string>")))
    return t.v.select("posting", W.accept_verdict(F.col("score"), F.col("family"), allowed, 40).alias("refusal"))


def notified_table(t: Tables) -> DataFrame:
    """NOTIFIED(key, grp, ts): every third posting was published in its group, every fifth among the favourites."""
    own = t.v.filter("n % 3 = 0").select(F.col("posting").alias("key"), "grp", F.col("seen_at").cast("timestamp").alias("ts"))
    fav = t.v.filter("n % 5 = 0").select(F.col("posting").alias("key"), F.lit("favorites").alias("grp"),
                                         F.col("seen_at").cast("timestamp").alias("ts"))
    return own.unionByName(fav)


@query("c10_already_notified", f"""
WITH {V} SELECT posting, n % 3 = 0 AS already, posted_at IS NULL AND kind = 'job' AND (n % 19 = 0 OR source_key = 's9') AS baseline FROM v""")
def c10(t: Tables) -> DataFrame:
    """Published in this group; undated postings remembered as baseline or met at the first run of their source."""
    here = notified_table(t).select("key", F.col("grp").alias("grp"), F.lit(True).alias("_n"))
    seen = t.v.filter("n % 19 = 0").select(F.col("posting").alias("key"), F.lit(True).alias("_b"))
    v = t.v.withColumn("key", F.col("posting")).join(here, ["key", "grp"], "left").join(seen, "key", "left")
    old = F.coalesce("_b", F.lit(False)) | (F.col("source_key") == "s9")
    return v.select("posting", F.coalesce("_n", F.lit(False)).alias("already"),
                    (F.col("posted_at").isNull() & (F.col("kind") == "job") & old).alias("baseline"))


@query("c11_is_place", f"WITH {READ_SQL} SELECT posting, loc, mentioned IS NOT NULL OR ({TARGET_SQL}) IS NOT NULL AS is_place FROM m WHERE loc <> ''")
def c11(t: Tables) -> DataFrame:
    """A guessed location stays only if it names a country or a configured place."""
    geo, cities = gazetteer(t)
    s = spelled(t).filter("loc <> ''")
    read = P.read_locations(s.select("loc").distinct(), geo, PLACES, P.city_aliases(PLACES, cities, geo))
    ok = read.select("loc", ((F.size("mentioned") > 0) | P.place_of_reading(PLACES).isNotNull()).alias("is_place"))
    return s.join(ok, "loc").select("posting", "loc", "is_place")


@query("c12_require_keyword", f"""
WITH {V} SELECT posting, CASE WHEN source_key = 's1' THEN true WHEN source_key = 's2' THEN false ELSE n % 2 = 0 END AS need FROM v""")
def c12(t: Tables) -> DataFrame:
    flag = F.when(F.col("source_key") == "s1", F.lit(True)).when(F.col("source_key") == "s2", F.lit(False))
    return t.v.select("posting", W.requires_keyword(flag, None, F.col("n") % 2 == 1).alias("need"))


TITLE_EXCLUDED = ["tiny", "plated"]
KW_FAMILIES = [("BUILDING", ["ring"]), ("MACHINERY", ["widget", "small"]), ("RED", ["red"])]
WATERFALL_AGE = 700


def waterfall_input(t: Tables) -> DataFrame:
    """Postings with everything the waterfall looks at: remembered state, place, rules, verdict."""
    title = normalize_text(F.col("title"))
    n = F.col("n")
    notified = t.v.filter("n % 23 = 0").select("posting", F.lit(True).alias("_notified"))
    verdicts = t.v.filter("n % 29 <> 0").select("posting", F.col("score").cast("int").alias("verdict_score"),
                                                F.col("family").alias("verdict_family"))
    v = t.v.drop("score", "family").join(notified, "posting", "left").join(verdicts, "posting", "left")
    scored = F.col("source_key") != "s5"
    said = F.concat(F.lit("at least "), F.col("size").cast("string"), F.lit(" years"))
    return v.select(
        "posting", "source_key", "native_id", "n", "grp", "kind", "title", "company", "url", "location", "target",
        F.col("posted_at").cast("timestamp").alias("posted_at"), F.col("seen_at").cast("timestamp").alias("first_seen"),
        F.coalesce("_notified", F.lit(False)).alias("notified"), (n % 2 == 0).alias("baseline"),
        W.location_ok(F.array("location"), F.when(F.col("target") != "EUROPE", F.col("target")), n % 31 == 0, F.col("kind"),
                      F.col("source_key") == "s4").alias("location_ok"),
        K.excluded(title, title, TITLE_EXCLUDED).alias("excluded"),
        W.experience_out_of_range(F.when(n % 5 == 0, said), None, 20).alias("out_of_range"),
        K.family_by_keywords(title, KW_FAMILIES).alias("kw_family"),
        W.requires_keyword(F.when(F.col("source_key") == "s1", F.lit(True)), None, scored).alias("need_keyword"),
        scored.alias("scored"), "verdict_score", "verdict_family",
        F.when(F.col("source_key") == "s2", F.array(F.lit("BUILDING"), F.lit("AUTOMOBILE"), F.lit("RED"))).alias("allowed_families"))


WATERFALL_SQL = f"""
{V}, w AS (SELECT v.*, {duck.norm('title')} AS t FROM v),
k AS (SELECT *, CASE WHEN {has('t', 'ring')} THEN 'BUILDING' WHEN {has('t', 'widget')} OR {has('t', 'small')} THEN 'MACHINERY' WHEN {has('t', 'red')} THEN 'RED' END AS kw,
 n % 29 <> 0 AS answered, source_key <> 's5' AS scored FROM w),
d AS (SELECT *, CASE WHEN n % 23 = 0 THEN 'already_notified' WHEN kind = 'job' AND posted_at IS NULL AND n % 2 = 0 THEN 'baseline'
 WHEN coalesce(posted_at, seen_at) < {NOW_SQL} - INTERVAL {WATERFALL_AGE} DAY THEN 'too_old'
 WHEN kind = 'job' AND source_key <> 's4' AND target = 'EUROPE' AND n % 31 <> 0 THEN 'location'
 WHEN kind = 'page_change' THEN NULL WHEN {has('t', 'tiny')} OR {has('t', 'plated')} THEN 'excluded'
 WHEN n % 5 = 0 AND size BETWEEN 22 AND 30 THEN 'experience' WHEN (source_key IN ('s1', 's5')) AND kw IS NULL THEN 'no_keyword'
 WHEN scored AND answered AND score < 35 THEN 'ai_score'
 WHEN scored AND answered AND source_key = 's2' AND family NOT IN ('BUILDING', 'AUTOMOBILE', 'RED') THEN 'source_family'
 WHEN scored AND NOT answered AND kw IS NULL THEN 'ai_unavailable' END AS decision,
 CASE WHEN kind <> 'job' THEN NULL WHEN scored AND answered THEN family ELSE kw END AS fam, CASE WHEN kind = 'job' AND scored AND answered THEN score END AS sc FROM k)"""


@query("c13_decision_waterfall", f"WITH {WATERFALL_SQL} SELECT posting, decision, fam AS family, sc::BIGINT AS score FROM d")
def c13(t: Tables) -> DataFrame:
    out = W.decide(waterfall_input(t), NOW, WATERFALL_AGE, 35)
    return out.select("posting", "decision", "family", F.col("score").cast("bigint").alias("score"))


@query("c14_already_alerted", f"WITH {V} SELECT posting, grp <> '1' AND n % 5 = 0 AS already_alerted FROM v WHERE score >= 50")
def c14(t: Tables) -> DataFrame:
    """Kept postings already published among the favourites (group 1 plays that group) are flagged, not dropped."""
    fav = notified_table(t).filter("grp = 'favorites'").select(F.col("key").alias("posting"), F.lit(True).alias("_f"))
    v = t.v.filter("score >= 50").join(fav, "posting", "left")
    return v.select("posting", ((F.col("grp") != "1") & F.coalesce("_f", F.lit(False))).alias("already_alerted"))


@query("f11_blocked_sample", f"WITH {WATERFALL_SQL} SELECT posting, sc::BIGINT AS score FROM d WHERE decision = 'source_family' ORDER BY sc DESC, posting LIMIT 25")
def f11(t: Tables) -> DataFrame:
    out = W.decide(waterfall_input(t), NOW, WATERFALL_AGE, 35).withColumn("key", F.col("posting"))
    return W.blocked_sample(out).select("posting", F.col("score").cast("bigint").alias("score"))


