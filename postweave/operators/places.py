"""Match free-text locations against configured countries and cities.

The gazetteer is an input table ``GEO(alias, iso2, kind, population)``: kind ``country`` (normalised names), ``iso2``,
``iso3`` (codes in capitals) and ``city`` (normalised names).  Texts never meet aliases by containment: each *distinct*
location text is broken into word sequences once and equi-joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import normalize_text
from ..session import small_table
from .keywords import find_keyword, longest_phrase, normalize_word, word_grams


@dataclass(frozen=True)
class Place:
    """One configured place; list order decides which one wins."""

    country: str | None = None  # ISO2
    city: str | None = None
    aliases: tuple[str, ...] = ()
    include_remote: bool = True
    label: str | None = None

    @property
    def display(self) -> str:
        return self.label or self.city or self.country or ""


def build_gazetteer(countries: DataFrame, cities: DataFrame) -> DataFrame:
    """GEO from countries(iso2, iso3, names) and cities(name, names, iso2, population)."""
    def rows(df: DataFrame, alias: Column, kind: str, population: Column) -> DataFrame:
        return df.select(alias.alias("alias"), "iso2", F.lit(kind).alias("kind"), population.cast("bigint").alias("population"))

    none = F.lit(None)
    named = countries.withColumn("_n", F.explode("names"))
    country = rows(named, normalize_text(F.col("_n")), "country", none)
    # A city also answers to its other names when they are Latin, long enough and not the name of a country.
    other = cities.withColumn("_n", F.explode(F.array_union(F.array("name"), F.coalesce("names", F.array().cast("array<string>")))))
    other = other.filter((F.col("_n") == F.col("name")) | ~F.col("_n").rlike(r"[^\x{0}-\x{24F}]"))
    city = rows(other, normalize_text(F.col("_n")), "city", F.when(F.col("_n") == F.col("name"), F.col("population")))
    city = city.filter(F.length("alias") >= V.MIN_CITY_ALIAS).join(country.select("alias").distinct(), "alias", "left_anti")
    out = country.unionByName(city).unionByName(rows(countries, F.upper("iso2"), "iso2", none))
    return out.unionByName(rows(countries, F.upper("iso3"), "iso3", none)).distinct()


def city_aliases(places: Sequence[Place], cities: DataFrame, geo: DataFrame) -> DataFrame:
    """(ord, alias) of every configured city: its own name, its configured aliases and its gazetteer names."""
    spark = geo.sparkSession
    own = [(i, normalize_word(a), p.country) for i, p in enumerate(places) if p.city for a in (p.city, *p.aliases)]
    wanted = small_table(spark, "ord int, wanted string, country string", own)
    every = F.array_union(F.array("name"), F.coalesce("names", F.array().cast("array<string>")))
    # A city is identified by its country and name; every one of its names is a row.
    names = cities.select("name", "iso2", F.explode(every).alias("raw")).withColumn("alias", normalize_text(F.col("raw")))
    hit = wanted.join(names, (F.col("alias") == F.col("wanted")) & (F.col("country").isNull() | (F.col("country") == F.col("iso2"))))
    known = hit.select("ord", "name", "iso2").distinct().join(names.select("name", "iso2", "alias", "raw"), ["name", "iso2"])
    known = known.filter((F.length("alias") >= V.MIN_CITY_ALIAS) & ~F.col("raw").rlike(r"[^\x{0}-\x{24F}]"))
    known = known.join(geo.filter("kind = 'country'").select("alias"), "alias", "left_anti")
    return (wanted.select("ord", F.col("wanted").alias("alias")).union(known.select("ord", "alias"))
            .filter("alias <> ''").distinct())


def resolve_country(df: DataFrame, value: str, geo: DataFrame) -> DataFrame:
    """Adds ``iso2`` for a column with a code or a name in any language; null when unknown."""
    v = F.trim(F.col(value))
    keyed = df.withColumn("_k", F.when(F.length(v).isin(2, 3), F.upper(v))).withColumn("_n", normalize_text(v))
    codes = geo.filter("kind IN ('iso2', 'iso3')").select(F.col("alias").alias("_k"), F.col("iso2").alias("_by_code"))
    names = geo.filter("kind = 'country'").groupBy(F.col("alias").alias("_n")).agg(F.min("iso2").alias("_by_name"))
    out = keyed.join(codes, "_k", "left").join(names, "_n", "left")
    return out.withColumn("iso2", F.coalesce("_by_code", "_by_name")).drop("_k", "_n", "_by_code", "_by_name")


def _code_tokens(loc: Column) -> Column:
    """Tagged code candidates: three capitals anywhere, two capitals as first or last part that is not a number."""
    three = F.transform(F.regexp_extract_all(loc, F.lit(r"(?<![A-Za-z])([A-Z]{3})(?![A-Za-z])"), F.lit(1)),
                        lambda c: F.concat(F.lit("iso3:"), c))
    parts = F.filter(F.transform(F.split(loc, r"[,;|/\-]"), lambda p: F.trim(p)),
                     lambda p: (p != "") & ~p.rlike(r"^\d+$"))
    edge = F.filter(F.array(F.get(parts, F.lit(0)), F.try_element_at(parts, F.lit(-1))),
                    lambda p: p.isNotNull() & p.rlike("^[A-Z]{2}$"))
    return F.concat(three, F.transform(edge, lambda c: F.concat(F.lit("iso2:"), c)))


def read_locations(texts: DataFrame, geo: DataFrame, places: Sequence[Place] = (),
                   aliases: DataFrame | None = None) -> DataFrame:
    """For distinct texts ``loc``: countries ``mentioned``, configured ``cities`` (their ord) and ``majors`` found.

    Codes only count where no country is named.
    """
    spark = geo.sparkSession
    if aliases is None:
        own = [(i, normalize_word(a)) for i, p in enumerate(places) if p.city for a in (p.city, *p.aliases)]
        aliases = small_table(spark, "ord int, alias string", own)
    tagged = (
        geo.filter("kind = 'country'").select(F.concat(F.lit("w:"), "alias").alias("token"), F.lit("named").alias("what"), F.col("iso2").alias("value"))
        .unionByName(geo.filter("kind IN ('iso2', 'iso3')").select(
            F.concat_ws(":", "kind", "alias").alias("token"), F.lit("coded").alias("what"), F.col("iso2").alias("value")))
        .unionByName(geo.filter((F.col("kind") == "city") & (F.col("population") >= V.MAJOR_CITY_POPULATION)).select(
            F.concat(F.lit("w:"), "alias").alias("token"), F.lit("major").alias("what"), F.col("iso2").alias("value")))
        .unionByName(aliases.select(F.concat(F.lit("w:"), "alias").alias("token"), F.lit("city").alias("what"),
                                    F.col("ord").cast("string").alias("value"))).distinct())
    norm = normalize_text(F.col("loc"))
    words = F.transform(word_grams(norm, longest_phrase(tagged.filter("token LIKE 'w:%'"), "token")), lambda g: F.concat(F.lit("w:"), g))
    tokens = texts.select("loc", F.explode(F.concat(words, _code_tokens(F.col("loc")))).alias("token"))
    hits = tokens.join(tagged, "token")

    def found(what: str) -> Column:
        return F.collect_set(F.when(F.col("what") == what, F.col("value")))

    per_text = hits.groupBy("loc").agg(found("named").alias("named"), found("coded").alias("coded"),
                                       found("major").alias("majors"), found("city").alias("cities"))
    none = F.array().cast("array<string>")
    read = texts.join(per_text, "loc", "left")
    named = F.coalesce("named", none)
    return read.select("loc", F.when(F.size(named) > 0, named).otherwise(F.coalesce("coded", none)).alias("mentioned"),
                       F.coalesce("majors", none).alias("majors"), F.coalesce("cities", none).alias("cities"))


def place_of_reading(places: Sequence[Place]) -> Column:
    """Number of the first configured place a read text belongs to."""
    loc, mentioned = F.col("loc"), F.col("mentioned")
    tests = []
    for i, p in enumerate(places):
        if p.city:
            here = F.array_contains("cities", str(i))
            if p.country:
                here = here & ((F.size(mentioned) == 0) | F.array_contains(mentioned, p.country))
        else:
            named = F.array_contains(mentioned, p.country)
            if not p.include_remote:
                named = named & ~loc.rlike("(?iuU)" + V.REMOTE)
            here = named | ((F.size(mentioned) == 0) & F.array_contains("majors", p.country))
        tests.append(F.when(here, F.lit(i)))
    return F.coalesce(*tests) if tests else F.lit(None).cast("int")


def match_places(df: DataFrame, key: str, locations: str, places: Sequence[Place], geo: DataFrame,
                 aliases: DataFrame | None = None) -> DataFrame:
    """Adds ``target``: the display name of the first configured place, over the location texts in order.

    Each distinct text is read once; postings join the readings by text (the side with one row per text is the one
    Spark may broadcast; a hot text is split by the adaptive skew join) and the first hit is a map-side combined min.
    """
    exploded = df.select(key, F.posexplode(locations).alias("_pos", "loc")).filter(F.col("loc") != "")
    readings = read_locations(exploded.select("loc").distinct(), geo, places, aliases)
    found = readings.select("loc", place_of_reading(places).alias("_place")).filter("_place IS NOT NULL")
    first = exploded.join(found, "loc").groupBy(key).agg(F.min(F.struct("_pos", "_place")).alias("_hit"))
    names = F.array(*[F.lit(p.display) for p in places]) if places else F.array().cast("array<string>")
    return df.join(first, key, "left").withColumn("target", F.get(names, F.col("_hit._place"))).drop("_hit")


def match_coverage(locations: Column, text_norm: Column, terms: Sequence[str], only_cities: Sequence[str] = ()) -> Column:
    """A coverage term occurs in title or description, and where cities are listed, one of them in the locations."""
    said = find_keyword(text_norm, terms).isNotNull()
    if not only_cities:
        return said
    return said & find_keyword(normalize_text(F.array_join(locations, " ")), only_cities).isNotNull()
