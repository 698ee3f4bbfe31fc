"""Links within families of similar sets: leaders first, then whatever still differs in label; full sets decide."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, hold


def posted_columns(words: int) -> list[str]:
    """What an index knows of a set besides the key it is posted under: its size n, how many of its index tokens other sets hold, too (m), the token's
    place, and a small bitmap of ``words`` 64-bit words."""
    return ["node", "n", "m", "at", *[f"b{i}" for i in range(words)]]


def bits_apart(words: int) -> Column:
    """In how many bits the small bitmaps of x and y differ: at most as many as tokens lie in only one of the sets."""
    out = F.lit(0)
    for i in range(words):
        out = out + F.bit_count(F.col(f"b{i}_x").bitwiseXOR(F.col(f"b{i}_y")))
    return out


def _side(df: DataFrame, name: str, *more: str) -> DataFrame:
    return df.select("key", *[F.col(c).alias(f"{c}_{name}") for c in df.columns if c not in ("key", *more)], *more)


def candidates(posted: DataFrame, reach: Column, everyone: bool) -> DataFrame:
    """Pairs (a, b) of differently labelled sets that meet in a list and are in ``reach``, a condition on the columns of x and y.

    First (``everyone`` false) each member of a list meets its leader only, the member that has most in common with other sets.  What got one label
    then needs no more comparing: lastly the members outside a list's most frequent label meet all that are labelled otherwise.
    """
    known = [c for c in posted.columns if c not in ("key", "label")]
    each = posted.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct((F.col("m") / F.col("n")).alias("common"), *known, "label")).alias("leader"))
    lists = each.groupBy("key").agg(F.max(F.struct("k", "label")).alias("top"), F.max("leader").alias("leader"), F.count(F.lit(1)).alias("labels"))
    lists = lists.where("labels > 1")
    if everyone:
        own = posted.join(lists.select("key", F.col("top.label").alias("main")), "key")
        other = _side(own.where("label <> main").drop("main"), "x")
        met = other.join(_side(own.withColumn("is_main", F.col("label") == F.col("main")).drop("main"), "y", "is_main"), "key").where(F.col("is_main") | (F.col("node_x") < F.col("node_y")))
    else:
        met = _side(posted, "x").join(lists.select("key", *[F.col(f"leader.{c}").alias(f"{c}_y") for c in (*known, "label")]), "key")
    met = met.where((F.col("label_x") != F.col("label_y")) & reach)
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs those that are similar enough: bitmaps rule most others out, full sets decide."""
    def side(key: str, *columns: str) -> DataFrame:
        return sets.select(F.col("node").alias(key), *[F.col(c).alias(f"{c}_{key}") for c in columns])
    near = pairs.join(side("a", "n", "bits"), "a").join(side("b", "n", "bits"), "b")
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = F.col("n_a") + F.col("n_b")
    near = hold(near.where((100 + percent) * (both - apart) >= 2 * percent * both).select("a", "b", "n_a", "n_b"), "near")
    full = near.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b")
    full = full.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long").alias("common"))
    links = hold(full.where(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b"), "links")
    discard(near)
    return links


def family_labels(posted: DataFrame, reach: Column, sets: DataFrame, percent: int, also: Callable[[DataFrame], DataFrame] | None = None,
                  before: str | None = None) -> DataFrame:
    """(node, label) of all nodes with a link: the smallest node that links reach.  ``also`` filters pairs before their sets are compared.

    ``before`` names a column with the keys of a set that come before a posting's own in the order of all keys: when all differently labelled members of a list
    meet, a pair that met in an earlier list is skipped."""
    labels = None
    for everyone in (False, True):
        own = posted.withColumn("label", F.col("node")) if labels is None else posted.join(labels, "node", "left").withColumn(
            "label", F.coalesce("label", "node"))
        if before is None:
            pairs = candidates(own, reach, everyone)
        elif everyone:
            pairs = candidates(own, reach & ~F.arrays_overlap(f"{before}_x", f"{before}_y"), True)
        else:
            pairs = candidates(own.drop(before), reach, False)
        found = verified(pairs if also is None else also(pairs), sets, percent)
        links = found if labels is None else labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(found)
        labels = components(links)
        discard(found)
    return labels


def with_components(bag: DataFrame, names: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``bag``; ``names``: the node and smallest id of each distinct set."""
    if labels is not None:
        names = names.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        names = names.join(names.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label")
    else:
        names = names.withColumn("component_id", F.col("doc_id"))
    keys = ["key_a", "key_b", "n_shingles"]
    named = bag.where("n_shingles > 0").select("doc_id", *keys).join(names.select(*keys, "component_id"), keys, "left")
    alone = bag.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.select("doc_id", "n_shingles", "component_id").union(alone)


def chosen_sets(nodes: DataFrame, docs: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The full sets of ``nodes`` (node, doc_id, key_a, key_b), from the texts that their ids have; one row a node.

    The nodes grow with the input, so the join is a sorted one at every size, not a broadcast where a table happens to be small."""
    sets = hold(make(nodes.join(docs.hint("merge"), "doc_id")), "sets")
    if sets.groupBy("node").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count():
        sets = sets.dropDuplicates(["node"])  # the same text twice under one id
    return sets
