"""Jaccard join of word n-gram sets by prefixes of token combinations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .families import bits_apart, chosen_sets, family_labels, posted_columns, with_components
from .shared import by_blocks, discard, hold, spread_out, table, texts_of
from .shingles import full_bags, lists, parity, set_keys, shingle_sets
from .textgrid import mix64

RARE = 16  # tokens in at most so many sets are indexed singly, others two by two
SMALL_WORDS = 4  # of the bitmaps that the index carries
EXTRA_PERCENT = 10  # by so much of a set the prefix of the first look is longer than a single common token needs
_ODD = np.uint64(0x9E3779B97F4A7C15)


def least_common(n, percent: int):
    """The common tokens that a set of size n and any linked partner have at least."""
    return -(-n * percent // 100)


def extra_of(n):
    return np.maximum(1, n * EXTRA_PERCENT // 100)


def bags(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, key_a, key_b, low): ``low`` has the first tokens of the set in hash order, the extended prefix."""
    def make():
        def block(ids, texts):
            values, sizes = shingle_sets(texts, words)  # each set is sorted by its tokens, which are hashes
            number = np.where(sizes > 0, np.minimum(sizes, sizes - least_common(sizes, percent) + extra_of(sizes)), 0)
            begin = np.cumsum(sizes) - sizes
            at = np.arange(int(number.sum())) + np.repeat(begin - (np.cumsum(number) - number), number)
            key_a, key_b = set_keys(values, sizes)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(key_a), pa.array(key_b), lists(values[at].view(np.int64), number)],
                                              ["doc_id", "n_shingles", "key_a", "key_b", "low"])
        return block
    return docs.mapInArrow(by_blocks(make), "doc_id long, n_shingles long, key_a long, key_b long, low array<long>")


def survivors(classes: DataFrame, percent: int) -> DataFrame:
    """(node): sets that may have a partner.

    If two sets share o tokens, their prefixes of n - o + e tokens in one order share e of them.  So a set whose prefix holds fewer than e tokens that any
    other set's prefix holds has no partner.  Only counts are joined, a token with very many sets stays one row on its side.
    """
    tokens = classes.select("node", "n_shingles", F.explode("low").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("token")
    smaller = F.expr(f"(n_shingles * {percent} + 99) div 100")
    need = F.greatest(F.lit(1), F.expr("s * %d div 100" % EXTRA_PERCENT))
    met = tokens.join(shared, "token").groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.first("n_shingles").alias("n_shingles"))
    return met.withColumn("s", smaller).where(F.col("m") >= need).select("node")


def size_groups(n: int, percent: int) -> list[int]:
    """Groups (each spans a factor of four) in which a set of size n can meet partners."""
    return sorted({(max(1, size).bit_length() - 1) // 2 for size in (least_common(n, percent), n, n * 100 // percent)})


def subclasses(group: int, percent: int) -> int:
    """Into how many classes frequent tokens are dealt: few enough that a whole set always has combinations to spare."""
    return max(1, 4 ** group * percent * percent // 40_000)


def combinations(tokens: np.ndarray, often: np.ndarray, n: int, percent: int, rare: int = RARE) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places) that a set of size n is indexed under; ``tokens`` are those that other sets hold, too, ``often`` in how many sets.

    Tokens have one order: rare ones first.  A linked partner lacks at most ``d = n - least_common`` tokens.  The prefix is extended until taking away any d tokens leaves
    a combination whole: a token indexed singly takes one removal, and a class of k frequent tokens, indexed two by two, takes k - 1.  Whichever
    of two linked sets has the earlier prefix end, such a combination lies in both prefixes.  Tokens that no other set holds come first and are removals already made.
    ``places`` counts the tokens of the set before a combination's last one.
    """
    lacking = n - least_common(n, percent)
    alone = n - len(tokens)
    if alone > lacking:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    order = np.lexsort((tokens, often))
    tokens, often = tokens[order].view(np.uint64), often[order]
    scrambled = mix64(tokens)
    keys, places = [], []
    for group in size_groups(n, percent):
        single = (often <= rare) | (group < 2)
        number = subclasses(group, percent)
        part = np.where(single, -1 - np.arange(len(tokens)), (scrambled >> np.uint64(33)).astype(np.int64) % number)
        gain = np.ones(len(tokens), np.int64)
        pairwise = np.flatnonzero(~single)
        gain[pairwise[np.unique(part[pairwise], return_index=True)[1]]] = 0
        end = int(np.searchsorted(np.cumsum(gain), lacking + 1 - alone)) + 1
        if end > len(tokens):
            raise AssertionError("a set has too few combinations")
        salt = np.uint64((group + 1) * int(_ODD) % (1 << 64))
        ones = np.flatnonzero(single[:end])
        keys.append(mix64(scrambled[ones] + salt))
        places.append(alone + ones)
        twos = pairwise[pairwise < end]
        twos = twos[np.argsort(part[twos], kind="stable")]
        own = part[twos]
        step = 1
        while True:
            first = np.flatnonzero(own[step:] == own[:-step])
            if not len(first):
                break
            a, b = twos[first], twos[first + step]
            keys.append(mix64(scrambled[a] * np.uint64(3) + mix64(scrambled[b] + salt)))
            places.append(alone + b)
            step += 1
    return np.concatenate(keys), np.concatenate(places)


def postings(sets: DataFrame, percent: int, rare: int) -> DataFrame:
    """The survivors' combinations: key, node, n, the number m of the set's tokens that other sets hold, too, the place ``at``, and a parity bitmap
    of those m tokens."""
    each = sets.select("node", "n", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often >= 2")
    known = each.join(often, "token").groupBy("node", "n").agg(F.collect_list(F.struct("token", "often")).alias("t"))  # as long as one text
    known = known.select("node", "n", F.col("t.token").alias("token"), F.col("t.often").alias("often"))

    def posted(nodes: pa.Array, sizes: list[int], sets_: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        found = [combinations(token, often_, n, percent, rare) for n, (token, often_) in zip(sizes, sets_, strict=True)]
        held = np.array([len(token) for token, _ in sets_], np.int64)
        bits = parity(np.concatenate([token for token, _ in sets_]).view(np.uint64), np.repeat(np.arange(len(sizes)), held), len(sizes), SMALL_WORDS)
        row = np.repeat(np.arange(len(sizes)), [len(keys) for keys, _ in found])
        columns = [np.concatenate([keys for keys, _ in found]).view(np.int64), np.array(sizes, np.int64)[row], held[row],
                   np.concatenate([at for _, at in found]).astype(np.int64), *[bits[row, i] for i in range(SMALL_WORDS)]]
        arrays = [pa.array(c) for c in columns]
        return pa.RecordBatch.from_arrays([arrays[0], nodes.take(pa.array(row)), *arrays[1:]], ["key", *posted_columns(SMALL_WORDS)])

    def run(batches):
        for batch in batches:
            nodes, sizes, token, often_ = batch.column(0), batch.column(1).to_pylist(), batch.column(2), batch.column(3)
            bounds = token.offsets.to_numpy()
            token, often_ = token.values.to_numpy(), often_.values.to_numpy()
            start = 0
            for i in range(len(sizes)):
                if i + 1 == len(sizes) or bounds[i + 2] - bounds[start] > 1 << 16 or i - start >= 1024:
                    inside = range(start, i + 1)
                    yield posted(nodes.slice(start, i + 1 - start), sizes[start:i + 1], [(token[bounds[j]:bounds[j + 1]], often_[bounds[j]:bounds[j + 1]]) for j in inside])
                    start = i + 1
    return known.mapInArrow(run, "key long, " + ", ".join(f"{c} long" for c in posted_columns(SMALL_WORDS)))


def _in_reach(percent: int) -> Column:
    """Whether two sets that meet may be linked, by what the index says of them.

    Sizes fit; before the shared place and from it on there are enough tokens that both can hold; and the tokens that only one of them holds, those of no other set
    and at least as many as bits differ, are few enough.
    """
    both = F.col("n_x") + F.col("n_y")

    def alone(side: str) -> Column:
        return F.col(f"n_{side}") - F.col(f"m_{side}")
    most = F.least(F.col("at_x") - alone("x"), F.col("at_y") - alone("y")) + F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    apart = alone("x") + alone("y") + bits_apart(SMALL_WORDS)
    return ((100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")) & ((100 + percent) * most >= percent * both)
            & ((100 + percent) * (both - apart) >= 2 * percent * both))


def jaccard_components(documents: DataFrame, words: int = 5, similarity: float = 0.8, rare: int = RARE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents linked by the Jaccard similarity of their word n-gram sets: (doc_id, n_shingles, component_id) for every row.

    Texts are lower-cased (A-Z) and cut into words at blanks; a set holds the distinct runs of ``words`` words (a shorter text: one run of all its words; no
    word: empty, linked with nothing).  ``component_id`` is the smallest id that links reach.

    Rows with equal sets are one node.  A first look at extended prefixes in hash order sets aside all nodes that can't have a partner (``survivors``).  The others
    are indexed under token combinations of their extended prefixes (``combinations``): single tokens where these are rare, pairs within classes where they are frequent.
    Nodes that meet are compared by parity bitmaps and then by their full sets, first every list's members with its leader, then whatever still differs in label, so
    a large family of copies costs a multiple of its size and no link between components is lost (a family whose members are alike but not linked is compared pair
    by pair where combinations meet, as exactness demands).  Tokens are 64-bit hashes.

    Null text counts as empty; rows with a null id get the component of equal texts, else null, and link nothing; rows with an equal id stay
    separate rows with their own texts; extra columns are ignored; no rows give no rows.  ``similarity`` is at least 0.5.
    """
    percent = round(100 * similarity)
    if not 50 <= percent <= 100:
        raise ValueError("similarity must lie between 0.5 and 1")
    docs = texts_of(documents, text, key)
    bag = hold(bags(spread_out(docs), words, percent), "bags")
    classes = bag.where("n_shingles > 0").groupBy("key_a", "key_b", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.first("low").alias("low"))
    classes = hold(classes.where("doc_id is not null").withColumn("node", F.monotonically_increasing_id()), "classes")
    bag, wide = hold(bag.drop("low"), "bags"), bag
    discard(wide)
    likely = hold(survivors(classes, percent), "survivors")
    names, labels = hold(classes.drop("low"), "names"), None
    discard(classes)
    if likely.limit(1).count():
        sets = chosen_sets(names.join(likely, "node").select("node", "doc_id", "key_a", "key_b"), docs, lambda rows: full_bags(rows, words))
        posted = hold(postings(sets, percent, rare), "postings")
        labels = family_labels(posted, _in_reach(percent), sets, percent)
        discard(posted, sets, likely)
    return with_components(bag, names, labels)


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, similarity=0.85)


def components_sql(percent: int, words: int, kept: bool) -> str:
    """The same rows in DuckDB's SQL: all pairs that share a run, exact counts, links followed to the end."""
    return f"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
    SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
    SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, reached) AS (SELECT a, b FROM both_ways UNION SELECT r.doc_id, both_ways.b FROM r JOIN both_ways ON both_ways.a = r.reached),
c AS (SELECT doc_id, min(reached) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id{
    ", d.doc_id = least(d.doc_id, coalesce(c.least, d.doc_id)) AS kept" if kept else ""}
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""
