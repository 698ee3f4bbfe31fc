"""SpotSigs: chains of content words behind common-word anchors, compared by pruned Jaccard.  Columns only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import table, texts_of

# Anchors: very common words of English, German, French and Spanish.
ANCHORS = """the of and to in is that it for was on with as be by this are from at
der die das und den von zu mit sich des dem nicht ein eine auf im für ist
de la le les et des en un une que qui dans du par pour sur au avec
el los las del y se con por su al es lo como para""".split()
CHAIN = (2, 3)  # content words in a chain: at least, at most


def normal(text: Column) -> Column:
    """Lower-case words of letters and digits with single blanks between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _found(words: Column, anchors: list[str], chain: tuple[int, int], stretches: bool) -> Column:
    """The spots of normal words, with ``stretches`` also the runs of three words between them."""
    stop = "(?:" + "|".join(dict.fromkeys(anchors)) + ")(?![^ ])"
    spot = rf"(?<![^ ]){stop}(?: (?!{stop})[^ ]++){{{chain[0]},{chain[1]}}}"
    if not stretches:
        return F.regexp_extract_all(words, F.lit(spot), F.lit(0))
    # A spot is taken whole; elsewhere every word begins a run, unless the run would reach a spot.
    run = rf"(?:(?!{spot})[^ ]++ ){{2}}(?!{spot})[^ ]++"
    return F.regexp_extract_all(words, F.lit(rf"(?<![^ ])(?=({spot}|{run}))(?:{spot})?+"), F.lit(1))


def _hashed(found: Column, words: Column) -> Column:
    runs = F.regexp_extract_all(words, F.lit(r"(?<![^ ])(?=([^ ]++ [^ ]++ [^ ]++))"), F.lit(1))
    whole = F.when(words != "", F.array(words)).otherwise(F.array().cast("array<string>"))
    chosen = F.when(F.size(found) > 0, found).when(words.rlike("^[^ ]+ [^ ]+ "), runs).otherwise(whole)
    return F.array_distinct(F.transform(chosen, lambda s: F.xxhash64(s).bitwiseAND((1 << 48) - 1)))


def with_signatures(df: DataFrame, text: str, name: str, anchors: list[str] = ANCHORS, chain: tuple[int, int] = CHAIN, stretches: bool = False) -> DataFrame:
    """Adds ``name``: the set of a text's spot signatures, as distinct 48-bit hashes.

    A signature is an anchor with the content words that follow it up to the next anchor (``chain``: how many at least and at most).  A text without
    any takes its runs of three words instead, a shorter one its whole text, and a text without words has none.
    With ``stretches`` this holds for every part: each three words in a row outside the spots are a signature, too, so a long text never rests on a
    few spots, and an edit changes only the signatures near it.  Words and spots are columns of their own, so each pattern runs once a text.
    """
    df = df.withColumn("words_", normal(F.col(text)))
    df = df.withColumn("found_", _found(F.col("words_"), anchors, chain, stretches))
    return df.withColumn(name, _hashed(F.col("found_"), F.col("words_"))).drop("words_", "found_")


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: tuple[int, int] = CHAIN, stretches: bool = False) -> Column:
    """The same as one Column, for single texts: a Column is evaluated wherever it stands, so tables take ``with_signatures``."""
    words = normal(text)
    return _hashed(_found(words, anchors, chain, stretches), words)


def fingerprint(found: Column) -> Column:
    """The set as text: its size, then its hashes in ascending order."""
    hashes = F.transform(F.array_sort(found), lambda h: F.lower(F.hex(h)))
    return F.concat_ws(":", F.size(found).cast("string"), F.array_join(hashes, "."))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both.cast("double") / every)


def similar_pairs(documents: DataFrame, similarity: float = 0.8, text: str = "text", key: str = "doc_id",
                  stretches: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs of similar documents: (a, b, likeness) between class representatives, and (doc_id, class) for membership.

    Documents with equal signature sets are one class, named by its smallest id.  Classes are partitioned by set length, so that
    partners lie in the same partition or the next; within, a set is posted under its rarest signatures only (enough that two sets
    of the wanted similarity share one), and pairs whose lengths differ too much are pruned before the sets are compared.  Null
    or empty texts have no signature and no partner; rows with null ids take no part; other columns are ignored.
    """
    step = math.log(1 / similarity)
    sets = with_signatures(texts_of(documents, text, key).where("doc_id is not null"), "text", "sigs", stretches=stretches).select("doc_id", F.array_sort("sigs").alias("sigs"))
    sets = sets.where(F.size("sigs") > 0)
    classes = sets.groupBy("sigs").agg(F.min("doc_id").alias("class")).withColumn("n", F.size("sigs"))
    members = sets.join(classes.select("sigs", "class"), "sigs").select("doc_id", "class")
    each = classes.select("class", "n", F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = Window.partitionBy("class")
    ranked = each.join(often, "sig").withColumn("m", F.count(F.lit(1)).over(own)).withColumn("r", F.row_number().over(own.orderBy("df", "sig")))
    # Of n signatures the first n - ceil(similarity * n) + 1 in the global order are the prefix; those of one class only come first.
    prefix = ranked.where(F.col("r") <= F.col("m") - F.ceil(F.col("n") * similarity - 1e-9) + 1)
    posted = prefix.select("sig", "class", "n", F.floor(F.log(F.col("n").cast("double")) / step).alias("length"))
    right = posted.select("sig", F.col("class").alias("b"), F.col("n").alias("n_b"), "length")
    left = posted.select("sig", F.col("class").alias("a"), F.col("n").alias("n_a"), F.explode(F.array("length", F.col("length") + 1)).alias("length"), F.col("length").alias("own"))
    pairs = left.join(right, ["sig", "length"]).where("own < length or a < b").where("a <> b")
    pairs = pairs.where((F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * (similarity - 1e-9))).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("class").alias(side), F.col("sigs").alias(f"sigs_{side}")), side)
    pairs = pairs.select("a", "b", likeness(F.col("sigs_a"), F.col("sigs_b")).alias("likeness")).where(F.col("likeness") >= similarity - 1e-9)
    return pairs, members


def _range_bounds(ids: DataFrame, number: int) -> list[int]:
    """At most ``number`` ids of the table that cut it into ranges of like size; the last is the largest."""
    shares = [i / number for i in range(1, number)] + [1.0]
    row = ids.agg(F.percentile_approx("doc_id", shares, 100 * number), F.max("doc_id")).first()
    return sorted({*(row[0] or []), row[1]}) if row[1] is not None else []


def with_next(docs: DataFrame, ranges: int | None = None, stretches: bool = False) -> DataFrame:
    """Every document with the following one in descending id (after the last: the first): adds next_text and next_sigs.

    Ids are cut into ranges at quantiles (a bounded list of bounds); a range's largest document also goes to the range above as its
    last row, and the largest of all to the lowest, so a window per range sees every neighbour and no task sees the whole table.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _range_bounds(docs.select("doc_id"), ranges or min(4 * parts, 5000))
    named, bounds = bool(bounds), bounds or [0]
    count = len(bounds)
    table_ = F.expr("array(" + ",".join(f"{b}L" if b > -(1 << 63) else "(-9223372036854775807L - 1L)" for b in bounds) + ")")
    powers = F.expr("array(" + ",".join(str(1 << i) for i in reversed(range(count.bit_length()))) + ")")
    place = F.aggregate(powers, F.lit(0), lambda low, p: F.when(
        (low + p <= count) & (F.get(table_, low + p - F.lit(1)) < F.col("doc_id")), low + p).otherwise(low))
    df = docs.withColumn("place", F.when(F.col("doc_id").isNull(), 0).otherwise(place))
    top = F.coalesce(F.get(table_, F.col("place")) == F.col("doc_id"), F.lit(False)) if named else F.lit(True)
    here = F.struct(F.col("place").alias("range"), F.lit(False).alias("guest"))
    above = F.struct(F.pmod(F.col("place") + 1, F.lit(count)).alias("range"), F.lit(True).alias("guest"))
    df = df.select("doc_id", "text", F.explode(F.when(top, F.array(here, above)).otherwise(F.array(here))).alias("to"))
    df = df.select("doc_id", "text", "to.range", "to.guest").repartition(parts, "range")
    df = with_signatures(df, "text", "sigs", stretches=stretches).withColumn("tie", F.xxhash64("text"))
    order = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), "tie")
    return df.select("doc_id", "text", "guest", "sigs", F.lead("text").over(order).alias("next_text"), F.lead("sigs").over(order).alias("next_sigs")) \
        .where("not guest").drop("guest")


def fingerprints_with_edits(documents: DataFrame, text: str = "text", key: str = "doc_id", stretches: bool = False) -> DataFrame:
    """Fingerprint every whole text and an edited form of it, whose last third comes from the next document in descending id.

    Null text is empty; equal ids are ordered by a hash of their text, null ids come last; a lone document is its own next one; an empty table gives no rows; other
    columns are ignored.  Equal texts have equal fingerprints; two texts without words are alike (1.0).
    """
    df = with_next(texts_of(documents, text, key), stretches=stretches)
    size = F.char_length("text").cast("long")
    df = df.withColumn("n_chars", size).withColumn("third", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("third")).cast("int")), F.substring(F.col("next_text"), F.lit(1), F.col("third")))
    df = df.select("doc_id", "n_chars", "sigs", "next_sigs", edited.alias("edited"))
    df = with_signatures(df, "edited", "edited_sigs", stretches=stretches)
    df = df.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sigs", "next_sigs", "edited_sigs")
    return df.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"),
                     fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
                     likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_edits(table(spark, sf_dir, "documents"), stretches=True)
