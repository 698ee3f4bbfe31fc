"""Score postings in batches with a callable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[list[dict]], dict[int, dict]]


def _clean(answer: dict) -> tuple[int, str | None, str | None]:
    """One answer as a verdict: the score is a whole number from 0 to 100 (0 if it is none), family and reason are texts or null."""
    try:
        score = float(answer.get("score"))
    except (TypeError, ValueError):
        score = 0.0
    family, reason = answer.get("family"), answer.get("reason")
    whole = 0 if score != score else int(max(0.0, min(100.0, score)))
    return whole, family if isinstance(family, str) else None, str(reason) if reason not in (None, "") else None


def score_batches(unscored: DataFrame, scorer: Scorer, batch_size: int = 10, description_chars: int | None = None,
                  max_calls: int | None = None) -> DataFrame:
    """(key, score, family, reason) for the postings the scorer answered.

    ``scorer`` gets a list of dicts and returns answers by position; missing answers give no row and nothing is cached for them.
    Answers are validated (see ``_clean``), so a text or an impossible number breaks nothing.  ``description_chars`` cuts what the scorer sees; by
    default it sees all.  ``max_calls`` is the budget of a run: its first ``max_calls * batch_size`` postings by key are scored, whatever the partitions.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size]
                for i, answer in scorer(part.to_dict("records")).items():
                    if 0 <= i < len(part):
                        out.append((part["key"].iloc[i], *_clean(answer)))
            yield pd.DataFrame(out, columns=["key", "score", "family", "reason"])

    text = F.col("description") if description_chars is None else F.substring("description", 1, description_chars)
    shown = unscored.select("key", "title", text.alias("description"))
    if max_calls is not None:
        shown = shown.orderBy("key").limit(max_calls * batch_size)
    return shown.mapInPandas(run, "key string, score int, family string, reason string")


def apply_scores(postings: DataFrame, verdicts: DataFrame, min_score: int) -> DataFrame:
    """Keep answered postings above the minimum; unanswered ones by their keyword family, else ``ai_unavailable``."""
    j = postings.join(verdicts.withColumnRenamed("family", "_vf"), "key", "left")
    decision = (F.when(F.col("score").isNull() & F.col("kw_family").isNull(), F.lit("ai_unavailable"))
                .when(F.col("score") < min_score, F.lit("ai_score")))
    return j.withColumn("decision", decision).withColumn("family", F.coalesce("_vf", "kw_family")).drop("_vf")
