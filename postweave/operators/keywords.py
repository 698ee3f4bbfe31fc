"""Keyword rules on normalised text, where words are separated by exactly one space."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.text import normalize_text


def normalize_word(value: str) -> str:
    """The normal form of a configured keyword (configuration is small and lives in the driver)."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).lower()
    return re.sub(r"[^\w]+", " ", plain).strip()


def probe(keyword: str) -> str:
    """What a padded normal text must contain: the whole words, or with a trailing ``*`` their beginning."""
    kw = keyword.strip()
    return " " + normalize_word(kw.rstrip("*")) + ("" if kw.endswith("*") else " ")


def padded(norm: Column) -> Column:
    return F.concat(F.lit(" "), norm, F.lit(" "))


def find_keyword(norm: Column, keywords: Sequence[str]) -> Column:
    """First keyword *in list order* found in a normalised text; null if none.  A plain substring search, no regex."""
    hits = [F.when(padded(norm).contains(probe(k)), F.lit(k)) for k in keywords if k.strip()]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def find_keyword_of_row(norm: Column, keywords: Column) -> Column:
    """The same with the keyword list in a column, e.g. a source's own list joined from its dimension row."""
    def found(text: Column, kw: Column) -> Column:
        bare = normalize_text(F.regexp_replace(F.trim(kw), r"\*+$", ""))
        end = F.when(F.trim(kw).endswith("*"), F.lit("")).otherwise(F.lit(" "))
        return (F.trim(kw) != "") & text.contains(F.concat(F.lit(" "), bare, end))

    return F.get(let(padded(norm), lambda text: F.filter(keywords, lambda kw: found(text, kw))), F.lit(0))


def word_grams(norm: Column, longest: int) -> Column:
    """Distinct sequences of 1 to ``longest`` words.  The split is bound once: lambdas re-evaluate what they capture."""
    def build(words: Column) -> Column:
        grams = [words]
        for k in range(2, longest + 1):
            count = F.greatest(F.size(words) - F.lit(k - 1), F.lit(0))
            grams.append(F.zip_with(F.slice(grams[-1], F.lit(1), count), F.slice(words, F.lit(k), count),
                                    lambda a, b: F.concat(a, F.lit(" "), b)))
        return F.array_distinct(F.flatten(F.array(*grams)))

    return let(F.split(norm, " "), build)


def longest_phrase(table: DataFrame, column: str) -> int:
    """Words of the longest phrase of a table of aliases or keywords (one number)."""
    return table.agg(F.max(F.size(F.split(column, " ")))).first()[0] or 1


def find_keyword_join(df: DataFrame, key: str, norm: Column, keywords: DataFrame) -> DataFrame:
    """``find_keyword`` for keyword tables too long for an expression: (ord, keyword, norm) rows, where ``norm`` is the normal form
    without a trailing ``*``, which makes a keyword the beginning of words.

    Word sequences equi-join the table (Spark broadcasts it when its size allows), and the lowest ``ord`` per row wins in a
    map-side combined aggregate.  No pair of row and keyword is built unless it matches.  Sequences are as long as
    the table's keywords; a beginning is met by sequences whose last word is cut to its length, for each form (words, letters) that occurs in the table.
    """
    last = F.element_at(F.split("norm", " "), -1)
    table = keywords.select("ord", "keyword", "norm", F.trim("keyword").endswith("*").alias("_open"), F.size(F.split("norm", " ")).alias("_words"), F.length(last).alias("_letters"))
    table = table.filter("norm <> ''")
    whole = table.filter("NOT _open").select("ord", "keyword", F.concat(F.lit("w:"), "norm").alias("_gram"))
    begun = table.filter("_open").select("ord", "keyword", F.concat_ws(":", F.lit("p"), "_words", "_letters", "norm").alias("_gram"))
    forms = [(r[0], r[1]) for r in table.filter("_open").select("_words", "_letters").distinct().orderBy("_words", "_letters").collect()]  # bounded by the lengths of words
    lengths = [r[0] for r in table.filter("NOT _open").select("_words").distinct().orderBy("_words").collect()]  # bounded by the words of a keyword
    def cut_grams(words: Column, n: int, letters: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - F.lit(n - 1), F.lit(1)))
        def one(i: Column) -> Column:
            end = F.get(words, i + F.lit(n - 2))
            head = F.array_join(F.slice(words, i, F.lit(n - 1)), " ") if n > 1 else None
            cut = F.when(F.length(end) >= letters, F.substring(end, 1, letters))
            return F.concat(F.lit(f"p:{n}:{letters}:"), head, F.lit(" "), cut) if n > 1 else F.concat(F.lit(f"p:{n}:{letters}:"), cut)
        return F.array_distinct(F.array_compact(F.transform(starts, one)))

    def whole_grams(words: Column, n: int) -> Column:
        count = F.greatest(F.size(words) - F.lit(n - 1), F.lit(0))
        return F.transform(F.slice(words, F.lit(1), count), lambda w, i: F.concat(F.lit("w:"), w if n == 1 else F.array_join(F.slice(words, i + 1, F.lit(n)), " ")))

    def all_grams(words: Column) -> Column:
        return F.array_distinct(F.concat(F.array().cast("array<string>"), *[whole_grams(words, n) for n in lengths], *[cut_grams(words, n, k) for n, k in forms]))
    hits = df.select(key, F.explode(let(F.split(norm, " "), all_grams)).alias("_gram")).join(whole.unionByName(begun), "_gram")
    first = hits.groupBy(key).agg(F.min_by("keyword", "ord").alias("keyword"))
    return df.join(first, key, "left")


def excluded(title_norm: Column, text_norm: Column, title_any: Sequence[str], text_any: Sequence[str] = (),
             source_any: Column | None = None) -> Column:
    """``title:kw`` for a title keyword (global ones first, then the source's), else ``text:kw``, else null."""
    in_title = find_keyword(title_norm, title_any)
    if source_any is not None:
        in_title = F.coalesce(in_title, find_keyword_of_row(title_norm, source_any))
    return F.coalesce(F.concat(F.lit("title:"), in_title), F.concat(F.lit("text:"), find_keyword(text_norm, text_any)))


def family_by_keywords(title_norm: Column, families: Sequence[tuple[str, Sequence[str]]],
                       allowed: Column | None = None, source_any: Column | None = None) -> Column:
    """A source's own title keywords give its first family (or 'match'); else the first allowed family with a hit.

    ``allowed``: array of family names; null allows every family, an empty array allows none.
    """
    allowed = F.lit(None).cast("array<string>") if allowed is None else allowed
    hits = [F.when((allowed.isNull() | F.array_contains(allowed, name)) & find_keyword(title_norm, kws).isNotNull(),
                   F.lit(name)) for name, kws in families]
    by_family = F.coalesce(*hits) if hits else F.lit(None).cast("string")
    if source_any is None:
        return by_family
    own = find_keyword_of_row(title_norm, source_any)
    return F.when(own.isNotNull(), F.coalesce(F.get(allowed, F.lit(0)), F.lit("match"))).otherwise(by_family)


def contains_name(company_norm: Column, names: Sequence[str]) -> Column:
    """The normalised company contains one of the wanted names (configuration, so an expression and not a join)."""
    out = F.lit(False)
    for name in names:
        if normalize_word(name):
            out = out | company_norm.contains(normalize_word(name))
    return out
