"""MinHash near-duplicates by a signature-coordinate inverted join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .families import bits_apart, chosen_sets, family_labels, posted_columns, with_components
from .shared import by_blocks, discard, hold, spread_out, table, texts_of
from .shingles import BITMAP_WORDS, full_bags, lists, set_keys, shingle_sets
from .textgrid import mix64

COORDINATES = 64
SMALL_WORDS = 8  # of the bitmaps of full sets that go with postings
_ODD = np.uint64(0x9E3779B97F4A7C15)


def match_threshold(similarity: float, coordinates: int = COORDINATES, deviations: float = 4.9) -> int:
    """Coordinates that must collide: so many standard deviations under the mean at the wanted similarity."""
    spread = (coordinates * similarity * (1 - similarity)) ** 0.5
    return max(1, int(np.floor(coordinates * similarity - deviations * spread)))


def signatures(values: np.ndarray, sizes: np.ndarray, coordinates: int) -> np.ndarray:
    """One row of minima per text; texts without shingles have a row of zeros."""
    out = np.zeros((len(sizes), coordinates), np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        begin = (np.cumsum(sizes) - sizes)[full]
        seeds = mix64(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * _ODD)
        for i in range(coordinates):
            scaled = (values * (seeds[2 * i] | np.uint64(1)) + seeds[2 * i + 1]) >> np.uint64(32)
            out[full, i] = np.minimum.reduceat(scaled.astype(np.uint32), begin)
    return out


def sketches(docs: DataFrame, words: int, coordinates: int) -> DataFrame:
    """(doc_id, n_shingles, key_a, key_b, signature): the two keys together tell equal shingle sets apart from others."""
    def make():
        def block(ids, texts):
            values, sizes = shingle_sets(texts, words)
            key_a, key_b = set_keys(values, sizes)
            minima = signatures(values, sizes, coordinates).view(np.int32).ravel()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(key_a), pa.array(key_b),
                                               lists(minima, np.full(len(sizes), coordinates), pa.int32())],
                                              ["doc_id", "n_shingles", "key_a", "key_b", "signature"])
        return block
    return docs.mapInArrow(by_blocks(make), "doc_id long, n_shingles long, key_a long, key_b long, signature array<int>")


def _tokens(classes: DataFrame) -> DataFrame:
    """(node, token): a row for each coordinate and its value."""
    return classes.select("node", F.posexplode("signature").alias("i", "value")).select(
        "node", F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(0xFFFFFFFF)).alias("token"))


def _survivors(classes: DataFrame, threshold: int) -> DataFrame:
    """(node): classes that may have a partner.

    Every class is posted under its coordinate-value pairs.  Two signatures with ``threshold`` collisions share that many posting
    lists, so a class needs ``threshold`` coordinates whose list has another member; all others are skipped for good.  Lists are counted, not
    gathered; the rows of a very long one may be split in the join, which has one row per list on its other side.
    """
    tokens = _tokens(classes)
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("token")
    met = tokens.join(shared, "token").groupBy("node").agg(F.count(F.lit(1)).alias("m"))
    return met.where(F.col("m") >= threshold).select("node")


def _postings(near: DataFrame, sets: DataFrame, coordinates: int, threshold: int) -> DataFrame:
    """The survivors under their coordinate-value pairs, the lists that any pair over the threshold must meet in.

    Coordinates have one order, the shortest lists first.  Two signatures with ``threshold`` collisions share one of the first ``coordinates - threshold + 1`` of
    each; the rest, the longest lists, are skipped.  Values of one class only come first and are not posted.  With each posting go the size of the class's full
    set, a small parity bitmap of it, and the class's coordinate values that come before, by which a pair is counted in the first list it meets in and skipped in
    the others.
    """
    tokens = _tokens(near)
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often >= 2")
    own = Window.partitionBy("node")  # one row for each coordinate
    ranked = tokens.join(often, "token").withColumn("m", F.count(F.lit(1)).over(own))
    order = own.orderBy("often", "token")
    ranked = ranked.withColumn("at", coordinates - F.col("m") + F.row_number().over(order) - 1)
    ranked = ranked.withColumn("before", F.collect_list("token").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    folded = [F.expr(" ^ ".join(f"bits[{j}]" for j in range(i, BITMAP_WORDS, SMALL_WORDS))).alias(f"b{i}") for i in range(SMALL_WORDS)]
    kept = ranked.where(F.col("at") <= coordinates - threshold).join(sets.select("node", "n", *folded), "node")
    return kept.select(F.col("token").alias("key"), *posted_columns(SMALL_WORDS), "before")


def _in_reach(percent: int, coordinates: int, threshold: int) -> Column:
    """Whether two classes that meet in a list can have enough collisions, and sets similar enough, by what the index says of them.

    Before the shared coordinate they can collide in those that other classes have, too, and from it on in all; the sizes fit; and the full sets differ in at least as
    many shingles as their bitmaps in bits.
    """
    def before(side: str) -> Column:
        return F.col(f"at_{side}") - (coordinates - F.col(f"m_{side}"))
    most = F.least(before("x"), before("y")) + F.least(coordinates - F.col("at_x"), coordinates - F.col("at_y"))
    both = F.col("n_x") + F.col("n_y")
    return ((most >= threshold) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
            & ((100 + percent) * (both - bits_apart(SMALL_WORDS)) >= 2 * percent * both))


def _colliding(pairs: DataFrame, near: DataFrame, threshold: int) -> DataFrame:
    """Of the pairs (a, b) those whose signatures collide in at least ``threshold`` coordinates."""
    hit = pairs
    for key in ("a", "b"):
        hit = hit.join(near.select(F.col("node").alias(key), F.col("signature").alias(f"signature_{key}")), key)
    equal = F.aggregate(F.zip_with("signature_a", "signature_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return hit.where(equal >= threshold).select("a", "b")


def near_duplicates(documents: DataFrame, words: int = 5, similarity: float = 0.8, coordinates: int = COORDINATES,
                    text: str = "text", key: str = "doc_id") -> DataFrame:
    """Classes of near-duplicates: (doc_id, n_shingles, component_id, kept) for every row.

    Texts are lower-cased (A-Z), cut into words at blanks, and become sets of word shingles (a shorter text: one shingle; no word:
    empty, linked with nothing).  Rows with equal sets are one class.  Classes are posted under the coordinate-value pairs of their MinHash signatures; those
    whose lists can't give ``match_threshold`` collisions are skipped (``_survivors``), the others meet in the lists of their prefixes (``_postings``), pairs with
    that many collisions are retained, and a link needs the similarity on the full sets.
    At 64 coordinates a pair of exactly 0.8 falls short of the threshold with a chance of about three in a million, more similar pairs with less.

    A list of many similar texts is not paired out: its members are first compared with the one that has most in common with others, linked classes take one
    label, and lastly all pairs whose labels still differ and whose sizes and bitmaps allow a link are compared.  So no link between components is lost, and a
    family of copies around an original costs a multiple of its size.  Null text counts as empty; rows with a null id get the class of their text, else a null one, and
    are never kept; rows with an equal id stay separate rows with their own texts; extra columns are ignored.
    """
    percent, threshold = round(100 * similarity), match_threshold(similarity, coordinates)
    docs = texts_of(documents, text, key)
    sketch = hold(sketches(spread_out(docs), words, coordinates), "sketch")
    classes = sketch.where("n_shingles > 0").groupBy("key_a", "key_b", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature"))
    classes = hold(classes.where("doc_id is not null").withColumn("node", F.monotonically_increasing_id()), "classes")
    sketch, wide = hold(sketch.drop("signature"), "sketch"), sketch
    discard(wide)
    survivors = hold(_survivors(classes, threshold), "survivors")
    names, labels = classes.drop("signature"), None
    if survivors.limit(1).count():
        sets = chosen_sets(names.join(survivors, "node").select("node", "doc_id", "key_a", "key_b"), docs, lambda rows: full_bags(rows, words))
        near = hold(classes.join(survivors, "node", "left_semi").select("node", "signature"), "near")
        posted = hold(_postings(near, sets, coordinates, threshold), "postings")
        labels = family_labels(posted, _in_reach(percent, coordinates, threshold), sets, percent, lambda pairs: _colliding(pairs, near, threshold), "before")
        discard(posted, sets, near, survivors)
    out = with_components(sketch, names, labels)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, similarity=0.8)
