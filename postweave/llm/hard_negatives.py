"""Hard negatives by exact search of score windows in a cover tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cover_tree import CoverTree
from .shared import hold, spread_out, table

SAMPLE_ROWS = 4_096  # the tree is built over at most so many rows; all rows are indexed
LEAF_ROWS = 64
PART_ENTRIES = 1 << 22  # vector entries on either side of one block of the search
SLICE_ENTRIES = 1 << 21
BUCKET_LEAVES = 62  # the leaves that a query wants of a bucket are bits of one number
_EXACT = 1 << 53
_LARGEST = (1 << 63) - 1
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def labelled_vectors(vectors: DataFrame, key: str, column: str, label: str, scale: float) -> DataFrame:
    """(id, label, x) of the rows that take part, x = floor(scale * c) as doubles; equal rows once."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & F.coalesce(finite, F.lit(False)))
    return rows.select("id", "label", F.transform("vector", lambda c: F.floor(c * F.lit(scale)).cast("double")).alias("x")).distinct()


def inner_products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """All inner products as 64-bit numbers; ``exact`` says that doubles hold them, otherwise Python numbers are used."""
    if exact:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a) @ whole(b).T, -_LARGEST, _LARGEST).astype(np.int64)


class _Index:
    """The classes of equal rows by leaf, held in the shared folder, and the tree with its measured radii."""

    def __init__(self, classes: DataFrame, rows: int, square: float, width: int, sample_rows: int, leaf_rows: int):
        self.spark, self.exact = classes.sparkSession, square < _EXACT
        few = classes.orderBy(F.xxhash64("x", "label"), "first").limit(min(sample_rows, max(64, rows // leaf_rows))).select("x", "label").toArrow()
        tree = CoverTree(_matrix(few.column("x")), square ** 0.5)
        self.labels = few.column("label").to_pylist()

        def routed(batches):
            for batch in batches:
                if batch.num_rows:
                    leaf = pa.array(tree.route(_matrix(batch.column(3))), pa.int32())
                    yield pa.RecordBatch.from_arrays([leaf, *batch.columns], ["leaf", *batch.schema.names])
        kinds = "leaf int, first long, ids array<long>, label long, x array<double>"
        self.rows = hold(classes.select("first", "ids", "label", "x").mapInArrow(routed, kinds), "index")

        def measured(batches):
            far: dict[int, float] = {}
            number: dict[int, int] = {}
            for batch in batches:
                if batch.num_rows:
                    more, rows_ = tree.distances(_matrix(batch.column(1)), batch.column(0).to_numpy())
                    for node, d in more.items():
                        far[node] = max(far.get(node, 0.0), d)
                    for leaf, n in rows_.items():
                        number[leaf] = number.get(leaf, 0) + n
            nodes = list(far)
            leaf_of = {int(tree.leaf_node[leaf]): n for leaf, n in number.items()}
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int32()), pa.array([far[n] for n in nodes], pa.float64()),
                                              pa.array([leaf_of.get(n, 0) for n in nodes], pa.int64())], ["node", "radius", "n"])
        found = self.rows.select("leaf", "x").mapInArrow(measured, "node int, radius double, n long").groupBy("node").agg(
            F.max("radius").alias("radius"), F.sum("n").alias("n")).collect()  # at most two rows for each row of the sample
        tree.measure({r.node: r.radius for r in found})
        held = {int(tree.leaf_number[r.node]): r.n for r in found if r.n}
        self.tree, self.block = tree, max(1, PART_ENTRIES // width)
        self.places, bucket, bit, total = [], 0, 0, 0  # (leaf, bucket, bit, parts of the bucket)
        for leaf in range(len(tree.leaf_node)):
            n = held.get(leaf, 0)
            if bit and (bit == BUCKET_LEAVES or total + n > self.block):
                bucket, bit, total = bucket + 1, 0, 0
            self.places.append([leaf, bucket, bit, 1])
            bit, total = bit + 1, total + n
            self.places[-1][3] = -(-total // self.block) or 1
        widest: dict[int, int] = {}
        for _, b, _, p in self.places:
            widest[b] = max(widest.get(b, 1), p)
        self.places = [(leaf, b, i, widest[b]) for leaf, b, i, _ in self.places]

    def search(self, asked: DataFrame, same_label: bool, k: int) -> DataFrame:
        """(query, high, first, ids, score): for each query and window [low, high] its k best classes in it.

        ``asked`` has (query, label, x, lows, highs).  Every query descends the tree by itself and is sent to the buckets whose leaves it wants; a block holds
        a bounded part of a bucket and a bounded number of queries, and looks at all scores of these leaves.
        """
        tree, labels, exact, places = self.tree, self.labels, self.exact, self.places
        blocks = -(-asked.count() // self.block) or 1

        def sent(batches):
            for batch in batches:
                step = max(1, SLICE_ENTRIES // (len(tree.centre) + len(labels)))
                for a in range(0, batch.num_rows, step):
                    part = batch.slice(a, step)
                    x, own = _matrix(part.column(2)), part.column(1).to_pylist()
                    lows, highs = part.column(3).to_pylist(), part.column(4).to_pylist()
                    scores, least, most = tree.bounds(x)
                    at, buckets, parts, masks, raised = [], [], [], [], []
                    for i in range(len(x)):
                        fits = [(label == own[i]) == same_label for label in labels]
                        leaves, low = tree.descend(scores[i].tolist(), least[i].tolist(), most[i].tolist(), list(zip(lows[i], highs[i], strict=True)), fits, k)
                        mask: dict[tuple[int, int], int] = {}
                        for leaf in leaves:
                            _, b, bit, number = places[leaf]
                            mask[b, number] = mask.get((b, number), 0) | (1 << bit)
                        for (b, number), bits in mask.items():
                            for p in range(number):
                                at.append(i)
                                buckets.append(b)
                                parts.append(p)
                                masks.append(bits)
                                raised.append([int(v) for v in low] if exact else lows[i])
                    rows = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(buckets, pa.int32()), pa.array(parts, pa.int32()), pa.array(masks, pa.int64()), pa.array(raised, pa.list_(pa.int64())),
                         *[part.column(c).take(rows) for c in (0, 1, 2, 4)]], ["bucket", "part", "mask", "lows", "query", "label", "x", "highs"])
        wanted = asked.select("query", "label", "x", "lows", "highs").mapInArrow(
            sent, "bucket int, part int, mask long, lows array<long>, query long, label long, x array<double>, highs array<long>")
        wanted = hold(wanted.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")), "wanted")
        cells = wanted.select(*[F.col(c).alias(c) for c in ("bucket", "part", "block")]).distinct()
        leaf_table = self.spark.createDataFrame(pa.table(  # one row for each leaf of the tree
            {name: pa.array(column, pa.int32()) for name, column in zip(("leaf", "bucket", "bit", "parts"), zip(*places, strict=True), strict=True)}))
        index = self.rows.join(leaf_table, "leaf").withColumn("part", F.pmod(F.xxhash64("first", "label"), F.col("parts")).cast("int"))
        index = index.select("bucket", "part", "bit", "first", "ids", "label", "x").join(cells, ["bucket", "part"])

        def verified(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[list] = [[], [], [], []]
            ids = left.column("ids").combine_chunks()
            if left.num_rows and right.num_rows:
                order = np.argsort(left.column("first").to_numpy(), kind="stable")
                inside, flags = _matrix(left.column("x"))[order], np.left_shift(np.int64(1), left.column("bit").to_numpy().astype(np.int64))[order]
                kind = left.column("label").to_numpy()[order]
                x, masks, own, names = _matrix(right.column("x")), right.column("mask").to_numpy(), right.column("label").to_numpy(), right.column("query").to_numpy()
                lows, highs = right.column("lows").to_pylist(), right.column("highs").to_pylist()
                windows = max(len(h) for h in highs)
                low = np.array([v + [_LARGEST] * (windows - len(v)) for v in lows], np.int64)  # a window that a query doesn't have is empty
                high = np.array([v + [-_LARGEST] * (windows - len(v)) for v in highs], np.int64)
                step = max(1, SLICE_ENTRIES // len(inside))
                for a in range(0, len(x), step):
                    part = slice(a, a + step)
                    score = inner_products(x[part], inside, exact)
                    good = ((masks[part, None] & flags[None, :]) != 0) & ((own[part, None] == kind[None, :]) == same_label)
                    for w in range(windows):
                        q, c = np.nonzero(good & (score >= low[part, w, None]) & (score <= high[part, w, None]))
                        s = score[q, c]
                        by = np.lexsort((c, -s, q))  # of equal scores the one with the smaller first id, whose rows come first
                        q, c, s = q[by], c[by], s[by]
                        begin = np.flatnonzero(np.diff(q, prepend=-1))
                        place = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
                        q, c, s = q[place < k], c[place < k], s[place < k]
                        for values, more in zip(out, (names[part][q], high[part, w][q], order[c], s), strict=True):
                            values.append(more)
            flat = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in out]
            at = pa.array(flat[2], pa.int64())
            return pa.table({"query": pa.array(flat[0], pa.int64()), "high": pa.array(flat[1], pa.int64()), "first": left.column("first").combine_chunks().take(at),
                             "ids": ids.take(at), "score": pa.array(flat[3], pa.int64())})
        keys = ["bucket", "part", "block"]
        found = index.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(verified, "query long, high long, first long, ids array<long>, score long")
        best = Window.partitionBy("query", "high").orderBy(F.desc("score"), "first")
        return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100,
                   key: str = "vec_id", column: str = "embedding", label: Column | str = "label", scale: float = 256.0, sample_rows: int = SAMPLE_ROWS,
                   leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Hard negatives of every anchor: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` turns the id column into a condition.  Vectors become whole numbers floor(scale * c), scores are their inner products, and of equal scores the
    smaller id comes first.  An anchor's positives are its best rows of the same label (ids other than its own); for each of them the negatives
    are the best rows of other labels whose score lies between ``low_percent`` and ``high_percent`` of the positive's.

    The search is exact.  A cover tree is built over at most ``sample_rows`` rows and holds every row; each node's covering radius, measured over all its rows,
    bounds the scores below it; anchors descend best first, pass by nodes outside their score windows, and the rows of the leaves that are left are scored one
    by one, in blocks of bounded size.  Positives are the window without ends, so both searches are one.  Where vectors have no structure (isotropic ones) few nodes lie
    outside, and the work is anchors times rows, in blocks.

    Rows of one label and vector are indexed once, with as many ids as can matter.  Rows whose label, vector or an entry is null, with a non-finite entry or
    another dimension than most, and null ids take no part; equal rows count once; zero vectors score 0; a negative positive score has an empty
    window; scores beyond 64 bits stop at the largest number; extra columns are ignored; no rows give no rows.
    """
    spark = vectors.sparkSession
    source = spread_out(vectors)
    source = source.select(F.col(key).alias("id_"), F.col(column).alias("vector_"), (F.col(label) if isinstance(label, str) else label).alias("label_"))
    rows = labelled_vectors(source, "id_", "vector_", "label_", scale)
    shapes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not shapes:
        return spark.createDataFrame([], SCHEMA)
    width, keep = shapes[0].d, max(positives, negatives) + 1
    rows = rows.where(F.size("x") == width).withColumn("anchor", F.coalesce(is_anchor(F.col("id")), F.lit(False)))
    same = Window.partitionBy("label", "x").orderBy("id")
    rows = hold(rows.withColumn("r", F.row_number().over(same)).where(F.col("anchor") | (F.col("r") <= keep)), "rows")
    classes = rows.groupBy("label", "x").agg(F.array_sort(F.collect_list(F.when(F.col("r") <= keep, F.col("id")))).alias("ids"), F.max("anchor").alias("asked"))
    classes = classes.select("label", "x", "ids", "asked", F.col("ids")[0].alias("first"), F.monotonically_increasing_id().alias("query"))
    classes = hold(classes, "classes")
    facts = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c)).alias("square")).first()
    index = _Index(classes, facts.n, float(facts.square), width, sample_rows, leaf_rows)

    asked = classes.where("asked").select("query", "label", "x")
    whole = [F.array(F.lit(-_LARGEST).cast("long")).alias("lows"), F.array(F.lit(_LARGEST).cast("long")).alias("highs")]
    near = index.search(asked.select("*", *whole), True, positives + 1).select("query", "score", F.explode("ids").alias("positive_id"))
    anchors = rows.where("anchor").join(classes.select("label", "x", "query"), ["label", "x"]).select(F.col("id").alias("anchor_id"), "query")
    chosen = Window.partitionBy("anchor_id", "query").orderBy(F.desc("score"), "positive_id")
    near = anchors.join(near, "query").where("positive_id <> anchor_id").withColumn("r", F.row_number().over(chosen)).where(F.col("r") <= positives)
    near = hold(near.select("query", "anchor_id", "positive_id", F.col("score").alias("positive_score")), "positives")

    high = F.floor(F.col("positive_score").cast("decimal(19,0)") * high_percent / 100).cast("long")
    low = F.ceil(F.col("positive_score").cast("decimal(19,0)") * low_percent / 100).cast("long")
    scored = near.select("query", low.alias("low"), high.alias("high")).where("low <= high").distinct()
    spans = scored.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("high", "low"))).alias("w"))
    spans = spans.select("query", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    hard = index.search(asked.join(spans, "query"), False, negatives).select("query", "high", F.col("score").alias("negative_score"), F.explode("ids").alias("negative_id"))
    order = Window.partitionBy("query", "high").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return near.withColumn("high", high).join(hard, ["query", "high"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(100)) == 0, label=wrong)


OP12_SQL = """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
    FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""
