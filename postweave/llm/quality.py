"""Quality classifier: heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer trained on the posterior."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprints import ANCHORS
from .shared import blocks, spread_out, table
from .textgrid import LETTER, NUMBER, OTHER, blank_words, classes, code_points, mix64, run_hashes

LABELLERS = ["symbols", "capitals", "repeats", "wordless", "sentences", "shouts", "common_words", "variety"]
BUCKETS = 1024
FEW_WORDS = 5
MOST_FALSE_ALARMS, LEAST_FINDS = 0.015, 0.1  # see estimate
SAMPLE = 4000  # documents on which the linear scorer is fitted, by hash of the text: a bound on what reaches the driver
_ODD = np.uint64(0x9E3779B97F4A7C15)


@cache
def _capitals() -> np.ndarray:
    return np.array([chr(c).isupper() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


@cache
def _common() -> np.ndarray:
    _, points, bounds = code_points(ANCHORS)
    return np.sort(run_hashes(points, bounds[:-1], bounds[1:]))


class Grid:
    """What the labellers and the scorer look at, for a block of texts: words, and sums per text."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        _, self.points, bounds = code_points(texts)
        self.starts, self.ends, self.owner = blank_words(self.points, bounds)
        self.size = np.diff(bounds)
        self.words = np.bincount(self.owner, minlength=self.n) if len(self.owner) else np.zeros(self.n, np.int64)
        self.bounds = bounds
        if not len(self.starts):
            return
        kind = classes()[self.points]
        self.upper = _capitals()[self.points]
        self.letter = kind == LETTER
        self.letters_in = self._in_words(self.letter)
        self.upper_in = self._in_words(self.upper)
        plain = np.isin(self.points, [ord(c) for c in ".,;:!?'\"()-"])
        self.odd_in = self._in_words((kind == OTHER) & ~plain)
        self.known_in = self._in_words(self.letter | (kind == NUMBER))
        self.hashes = run_hashes(self.points, self.starts, self.ends)
        self.again = np.zeros(len(self.starts), bool)
        self.again[1:] = (self.hashes[1:] == self.hashes[:-1]) & (self.owner[1:] == self.owner[:-1])
        self.first, self.last = self.points[self.starts], self.points[self.ends - 1]

    def _in_words(self, flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags))
        return total[self.ends] - total[self.starts]

    def per_text(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, values, self.n)

    def votes(self) -> np.ndarray:
        """(text, labeller): 1 good, 0 bad, 2 abstains.  A text without words is bad by all that can tell."""
        out = np.full((self.n, len(LABELLERS)), 2, np.int8)
        empty = self.words == 0
        if len(self.starts):
            words = np.maximum(self.words, 1)
            ends = np.isin(self.last, [33, 46, 63]) & (self.known_in > 0)
            lowered = np.isin(self.lower_hashes(), _common())
            shares = [
                (self.per_text(self.odd_in) / np.maximum(self.size, 1), 0.015, 0.04),
                (self.per_text(self.upper_in) / np.maximum(self.per_text(self.letters_in), 1), 0.2, 0.5),
                (self.per_text(self.again) / words, 0.05, 0.2),
                (self.per_text(self.known_in == 0) / words, 0.03, 0.15),
                (np.abs(np.log((words + 1) / (self.per_text(ends) + 1) / 9)), 1.2, 2.2),
                (self.per_text(self.last == 33) / words, 0.05, 0.3),
                (-self.per_text(lowered) / words, -0.08, -0.03),
                (-self.distinct() / np.sqrt(words), -4.0, -2.5),
            ]
            for j, (share, good, bad) in enumerate(shares):
                out[:, j] = np.where(share <= good, 1, np.where(share >= bad, 0, 2))
            out[self.words < FEW_WORDS] = 2  # too little to tell
            for j in (4, 6, 7):
                out[self.words < 4 * FEW_WORDS, j] = 2
        out[empty] = 0
        return out

    def distinct(self) -> np.ndarray:
        """Number of different words of each text."""
        keys, first = np.unique(mix64(self.hashes ^ mix64(self.owner.astype(np.uint64) + _ODD)), return_index=True)
        return np.bincount(self.owner[first], minlength=self.n)

    def lower_hashes(self) -> np.ndarray:
        low = self.points.copy()
        at = (low >= 65) & (low <= 90)
        low[at] += 32
        return run_hashes(low, self.starts, self.ends)

    def buckets(self) -> np.ndarray:
        """(word, feature) hashed features of every word: its form, its ends, its repetition, and its end with the next one's."""
        plain = lambda c: np.where(np.isin(classes()[c], [LETTER, NUMBER]), np.uint64(1), c.astype(np.uint64))
        length = np.minimum(self.ends - self.starts, 20).astype(np.uint64)
        case = np.where(self.upper_in == 0, 0, np.where(self.upper_in == self.letters_in, 2, 1)).astype(np.uint64)
        case = case * np.uint64(4) + np.where(self.letters_in == 0, 0, np.where(self.letters_in == self.ends - self.starts, 2, 1)).astype(np.uint64)
        before = self.points[np.maximum(self.ends - 2, self.starts)]
        tail = plain(self.last) * np.uint64(1 << 21) + plain(before)
        nearby = np.append(tail[1:], np.uint64(0))
        columns = [case + np.uint64(16) * np.minimum(length, np.uint64(2)), tail, plain(self.first), self.again.astype(np.uint64), length, tail * np.uint64(31) + nearby]
        return np.stack([mix64(c * np.uint64(8) + np.uint64(j) + _ODD) % np.uint64(BUCKETS) for j, c in enumerate(columns)], axis=1).astype(np.int64)


def pattern_of(votes: np.ndarray) -> np.ndarray:
    """All votes of a text as one number."""
    return (votes.astype(np.int64) * 3 ** np.arange(len(LABELLERS))).sum(axis=1)


def votes_of(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns: (posterior of good per pattern, P(vote | class) per labeller, share of good).

    Labellers are independent given the class; they start as better than chance, which fixes which class is which.  Bad texts are of
    several kinds, and each labeller knows one or two of them, so a plain maximum of the likelihood would take one kind for the whole class.  Two
    things known of such heuristics are held on to: at most ``MOST_FALSE_ALARMS`` of good texts get a bad vote from any of them, and at least
    ``LEAST_FINDS`` of bad texts do."""
    votes = votes_of(patterns)
    said = votes != 2  # who abstains says nothing
    table_ = np.zeros((2, len(LABELLERS), 3))
    table_[0] = [0.5, 0.5, 1.0]
    table_[1] = [0.01, 0.99, 1.0]
    share = 0.8
    good = np.full(len(patterns), share)
    at = np.arange(len(LABELLERS))
    for _ in range(rounds):
        logs = np.log(table_[:, at, votes]).sum(axis=2)
        good = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - share) / share), -500, 500)))
        for y, p in ((0, 1 - good), (1, good)):
            weight = p * counts
            bad_votes, all_votes = ((votes == 0) * weight[:, None]).sum(axis=0), (said * weight[:, None]).sum(axis=0)
            alarm = (bad_votes + 0.1) / (all_votes + 0.2)
            alarm = np.clip(alarm, 1e-5, MOST_FALSE_ALARMS) if y else np.clip(alarm, LEAST_FINDS, 1 - 1e-3)
            table_[y, :, 0], table_[y, :, 1] = alarm, 1 - alarm
        share = float(np.clip((good * counts).sum() / counts.sum(), 0.01, 0.99))
    return good, table_, share


def mean_features(texts: list[str]) -> np.ndarray:
    """(text, bucket): share of each hashed feature among a text's words."""
    grid = Grid(texts)
    out = np.zeros((len(texts), BUCKETS), np.float32)
    if len(grid.starts):
        for column in grid.buckets().T:
            np.add.at(out, (grid.owner, column), 1)
        out /= np.maximum(grid.words, 1)[:, None]
    return out


def fit_scorer(x: np.ndarray, target: np.ndarray, rounds: int = 250, rate: float = 0.3, shrink: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft targets (Adam); the last weight is the bias.  Both classes weigh the same, so neither drowns."""
    x = x.astype(np.float32)
    w, m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    if not len(x):
        return w
    mass = np.array([max((1 - target).sum(), 1e-9), max(target.sum(), 1e-9)])
    weight = ((1 - target) / mass[0] + target / mass[1]) / 2
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(np.float32) + w[-1], -50, 50)))
        error = ((p - target) * weight).astype(np.float32)
        g = np.append(x.T @ error + shrink * w[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return w


class Model:
    def __init__(self, posterior: dict[int, float], accuracies: dict[str, float], weights: np.ndarray, share: float, usual: float = 0.0):
        self.posterior, self.accuracies, self.weights, self.share, self.usual = posterior, accuracies, weights, share, usual

    def apply(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vote pattern, posterior of good, and score (above 0: kept) of every text; no words: minus infinity."""
        grid = Grid(texts)
        patterns = pattern_of(grid.votes())
        score = np.full(len(texts), self.weights[-1])
        if len(grid.starts):
            total = grid.per_text(self.weights[:-1][grid.buckets()].sum(axis=1))
            score = score + (total + FEW_WORDS * self.usual) / (grid.words + FEW_WORDS)  # a short text is drawn towards the usual good one
        score[grid.words == 0] = -np.inf
        return patterns, np.array([self.posterior.get(int(p), self.share) for p in patterns]), score


def _in_blocks(texts: list[str]):
    for a, b in blocks([len(t) for t in texts]):
        yield texts[a:b]


def fit(documents: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Votes of all documents are counted by pattern (at most 3 to the number of labellers rows); expectation-maximisation
    runs on these counts; the scorer is fitted on about ``sample`` documents, chosen by a hash of the text, with posterior labels."""
    texts = spread_out(documents.select(F.coalesce(F.col(text), F.lit("")).alias("text")))

    @F.pandas_udf("int")
    def pattern(column: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([pattern_of(Grid(t).votes()) for t in _in_blocks(column.tolist())] or [np.zeros(0)]).astype(np.int32))

    rows = texts.select(pattern("text").alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    if not rows:
        return Model({}, {}, np.zeros(BUCKETS + 1), 0.5)
    patterns, counts = np.array([r.p for r in rows], np.int64), np.array([r.n for r in rows], np.float64)
    good, table_, share = estimate(patterns, counts)
    posterior = dict(zip(patterns.tolist(), good.tolist(), strict=True))
    accuracies = {name: float(share * table_[1, j, 1] + (1 - share) * table_[0, j, 0]) for j, name in enumerate(LABELLERS)}
    # The hash of the text decides, so equal texts are drawn together; distinct texts keep copies from filling the sample.
    cut_at = min(1.0, sample / counts.sum())
    drawn = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(cut_at * (1 << 30)) + 1).distinct()

    def learn(batches):
        import pyarrow as pa
        for batch in batches:
            for part in _in_blocks(batch.column(0).to_pylist()):
                x = mean_features(part)
                yield pa.RecordBatch.from_arrays([pa.array(pattern_of(Grid(part).votes()), pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())], ["p", "x"])
    got = drawn.mapInArrow(learn, "p long, x binary").collect()
    x = np.array([np.frombuffer(r.x, np.float32) for r in got]).reshape(len(got), BUCKETS)
    order = np.lexsort(x[:, :8].T) if len(got) else np.zeros(0, np.int64)
    target = np.array([posterior[r.p] for r in got])
    weights = fit_scorer(x[order], target[order])
    usual = float((x @ weights[:-1] * target).sum() / max(target.sum(), 1e-9)) if len(got) else 0.0
    return Model(posterior, accuracies, weights, share, usual)


def judged(documents: DataFrame, model: Model | None = None, text: str = "text", result: str = "quality_result") -> DataFrame:
    """All columns of the documents and one more, named by ``result``: struct of pattern, posterior, score, keep.

    A document is kept if the linear scorer, trained on the posterior labels, gives it more than even odds; null, empty and wordless texts are
    not.  Equal texts get equal results; rows stay one to one; an empty table stays empty.
    """
    model = model or fit(documents, text)

    @F.pandas_udf("pattern int, posterior double, score double, keep boolean")
    def apply(column: pd.Series) -> pd.DataFrame:
        parts = [model.apply(t) for t in _in_blocks([t if t is not None else "" for t in column.tolist()])]
        patterns, posterior, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0),) * 3
        return pd.DataFrame({"pattern": patterns.astype(np.int32), "posterior": posterior, "score": score, "keep": score > 0})
    return spread_out(documents).withColumn(result, apply(F.col(text)))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(documents).select("doc_id", "quality_result.posterior", "quality_result.score", "quality_result.keep")


def kept(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the classifier keeps, with their own columns only."""
    result = "quality_result"
    while result in documents.columns:
        result += "_"
    return judged(documents, text=text, result=result).where(F.col(result)["keep"]).select(documents.columns)
