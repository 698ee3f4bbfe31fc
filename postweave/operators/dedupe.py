"""Duplicates: explicit winners, rank-greedy merge across sources, names of the other sources."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..session import cut_lineage, written
from .components import connected

ROUNDS_FIRST = 4  # rounds over all rows before what is left is taken component by component
SMALL_COMPONENT = 20_000  # rows that one task walks through


def distinct_first_wins(df: DataFrame, keys: list[str], *position: str, last: bool = False) -> DataFrame:
    """One row per key with an explicit winner, as a map-side combined ``min_by``/``max_by`` (never a window)."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    won = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*position)).alias("_row"))
    return won.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def distinct_last_wins(df: DataFrame, keys: list[str], *position: str) -> DataFrame:
    return distinct_first_wins(df, keys, *position, last=True)


def rank_order(score: str, *ties: str) -> Column:
    """Total order, smallest first: score descending with null as 0, then the ties."""
    return F.struct((-F.coalesce(F.col(score), F.lit(0))).alias("neg"), *[F.col(c) for c in ties])


def _token_at(ids: str, position: int) -> Column:
    return F.get(F.filter(ids, lambda x: x.startswith(str(position))), F.lit(0))


def _in_order(value):
    """A key that orders Python values as Spark orders them: nulls first, structs field by field."""
    if isinstance(value, dict):
        value = tuple(value.values())
    if isinstance(value, (tuple, list)):
        return tuple(_in_order(v) for v in value)
    return (value is not None, value if value is not None else 0)


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The definition itself, for whole components in sorted frames: the kept rows (_rid)."""
    def kept(rows: list[tuple]) -> list[int]:
        held: set[str] = set()
        out = []
        for rid, _, ids in sorted(rows, key=lambda r: _in_order(r[1])):
            if held.isdisjoint(ids):
                held.update(ids)
                out.append(rid)
        return out
    label, rows = None, []
    for frame in frames:
        out: list[int] = []
        for rid, own, best, ids in zip(frame["_rid"], frame["_label"], frame["_best"], frame["_ids"], strict=True):
            if own != label:
                out += kept(rows)
                label, rows = own, []
            rows.append((rid, best.asDict(True) if hasattr(best, "asDict") else best, list(ids)))
        yield pd.DataFrame({"_rid": pd.Series(out, dtype="int64")})
    yield pd.DataFrame({"_rid": pd.Series(kept(rows), dtype="int64")})


def _by_component(still: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(owners, rest): components of open rows that share tokens, up to ``most`` rows each solved whole in one task; larger ones stay open."""
    rows = written(still.withColumn("_rid", F.monotonically_increasing_id()), "open")
    tokens = rows.select("_rid", F.explode("_ids").alias("_t"))
    leaders = tokens.groupBy("_t").agg(F.min("_rid").alias("_low"))
    labels = connected(tokens.join(leaders, "_t").select(F.col("_rid").alias("a"), F.col("_low").alias("b")))
    named = rows.join(labels.withColumnRenamed("node", "_rid"), "_rid", "left").withColumn("_label", F.coalesce("label", "_rid")).drop("label")
    large = named.groupBy("_label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select("_label")
    small = named.join(large, "_label", "left_anti").select("_rid", "_label", "_best", "_ids")
    kept = small.repartition("_label").sortWithinPartitions("_label").mapInPandas(_walk, "_rid bigint")
    owners = small.join(kept, "_rid", "left_semi").select(F.explode("_ids").alias("_t"), F.col("_best").alias("_owner"))
    return written(owners, "owners"), written(named.join(large, "_label", "left_semi").select("_best", "_ids"), "rest")


def rank_greedy_dedupe(df: DataFrame, key: str, tokens: list[str], rank: Column, eligible: Column | None = None,
                       rounds_first: int = ROUNDS_FIRST, small: int = SMALL_COMPONENT) -> tuple[DataFrame, DataFrame]:
    """Keep, in rank order, every eligible row none of whose tokens belongs to an already kept row.

    Returns ``(rows, keepers)``: the rows with ``kept`` and ``dup_of`` (the kept row of the first token hit), and the
    token owners.  Dropped rows register nothing, so this is the lexicographically first maximal independent set, not
    connected components.  It is computed in rounds:

    * Rows with the same tokens are first folded into their best one (the others can never be kept), so a group of
      copies is one row after a map-side combined aggregate, however large it is.
    * Each round the best open row per token is a map-side combined ``min``.  A row that is best in all its tokens is
      kept; every open row that shares a token with a kept one is closed.  Nothing is paired within a group.
    * Each round ends in one reliable checkpoint; at least the best open row of every group closes, so it terminates.
    * What ``rounds_first`` rounds leave open, long chains of rows that wait for each other, is cut into components of shared tokens; those of at most
      ``small`` rows are walked in rank order, each in one task, and only larger ones take further rounds.
    """
    base = df.select(F.col(key).alias("_key"), rank.alias("_rank"), *tokens,
                     (F.lit(True) if eligible is None else eligible).alias("_ok"))
    best = F.min(F.struct("_rank", "_key")).alias("_best")
    still = cut_lineage(base.filter("_ok").groupBy(*tokens).agg(best))
    ids = F.array_compact(F.array(*[F.when(F.col(t).isNotNull(), F.concat(F.lit(f"{i}"), F.col(t)))
                                    for i, t in enumerate(tokens)]))
    still = still.select("_best", ids.alias("_ids")).filter(F.size("_ids") > 0)
    rounds: list[DataFrame] = []
    done = 0
    while not still.isEmpty():
        if done == rounds_first:
            solved, still = _by_component(still, small)
            rounds.append(solved)
            done += 1
            continue
        done += 1
        row = F.struct(F.col("_best"), F.col("_ids"))
        leaders = still.select(F.explode("_ids").alias("_t"), row.alias("_row")).groupBy("_t").agg(F.min("_row").alias("_row"))
        kept = leaders.groupBy("_row").agg(F.count("*").alias("_n")).filter(F.col("_n") == F.size("_row._ids"))
        owners = kept.select(F.explode("_row._ids").alias("_t"), F.col("_row._best").alias("_best"))
        taken = owners.select("_t")
        for i in range(len(tokens)):
            # Tokens carry their position, so each of them is found by one equi-join.
            still = still.withColumn("_one", _token_at("_ids", i)).join(taken, F.col("_one") == F.col("_t"), "left_anti").drop("_one")
        # Open rows and owners of a round are one table, so a round is cut once.
        state = cut_lineage(still.select("_best", "_ids", F.lit(None).cast("string").alias("_t")).unionByName(owners.withColumn("_ids", F.lit(None).cast("array<string>"))))
        owners = state.filter("_t IS NOT NULL").select("_t", F.col("_best").alias("_owner"))
        if owners.isEmpty():
            raise RuntimeError("no row is best in all its tokens: the rank is not a total order")
        rounds.append(owners)
        still = state.filter("_t IS NULL").select("_best", "_ids")
    empty = df.sparkSession.createDataFrame([], still.select(F.explode("_ids").alias("_t"), F.col("_best").alias("_owner")).schema)
    owners = reduce(DataFrame.unionByName, rounds, empty)
    out = df.withColumn("_rank", rank).withColumn("_eligible", F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False)))
    hits: list[Column] = []
    for i, t in enumerate(tokens):
        mine = owners.filter(F.col("_t").startswith(f"{i}")).select(F.col("_t").alias(f"_k{i}"), F.col("_owner").alias(f"_o{i}"))
        # A row without this token looks for its own key, which no owner has: such rows stay spread over all tasks.
        out = out.withColumn(f"_k{i}", F.coalesce(F.concat(F.lit(f"{i}"), F.col(t)), F.concat(F.lit("-"), F.col(key).cast("string")))).join(mine, f"_k{i}", "left")
        hits.append(F.when((F.col(f"_o{i}._rank") < F.col("_rank")), F.col(f"_o{i}._key")))
        is_owner = F.col(f"_o{i}._key") == F.col(key)
        out = out.withColumn(f"_own{i}", F.coalesce(is_owner, F.lit(False)))
    # A row without any token shares nothing and is kept.
    bare = reduce(Column.__and__, [F.col(t).isNull() for t in tokens])
    own = reduce(Column.__or__, [F.col(f"_own{i}") for i in range(len(tokens))], bare & F.col("_eligible"))
    out = out.withColumn("kept", own).withColumn("dup_of", F.when(~own, F.coalesce(*hits)))
    drop = ["_rank", "_eligible", *[f"_k{i}" for i in range(len(tokens))], *[f"_o{i}" for i in range(len(tokens))], *[f"_own{i}" for i in range(len(tokens))]]
    return out.drop(*drop), owners


def decide_duplicates(df: DataFrame, key: str, tokens: list[str], rank: Column, polling: Column | bool = False,
                      ) -> DataFrame:
    """Adds ``decision``: null for kept rows, else duplicate, duplicate_previous or duplicate_other_group.

    Expects ``prev_here`` and ``prev_elsewhere``: the same offer was published before in this / in another group.
    """
    polling = F.lit(polling) if isinstance(polling, bool) else polling
    blocked_elsewhere = F.col("prev_elsewhere") & ~polling
    rows, _ = rank_greedy_dedupe(df, key, tokens, rank, ~F.col("prev_here") & ~blocked_elsewhere)
    return rows.withColumn("decision", F.when(F.col("dup_of").isNotNull(), F.lit("duplicate"))
                           .when(F.col("prev_here"), F.lit("duplicate_previous"))
                           .when(blocked_elsewhere, F.lit("duplicate_other_group")))


def merge_also_on(duplicates: DataFrame, keepers: DataFrame, key: str, rank: Column) -> DataFrame:
    """(key, also_on) per kept row: distinct names of the sources of its duplicates, best duplicate first.

    Duplicates are first folded to one row per (kept row, name), so a hot offer is bounded by the number of sources.
    """
    names = duplicates.groupBy("dup_of", "source_name").agg(F.min(rank).alias("_r"))
    named = names.join(keepers.select(F.col(key).alias("dup_of"), "company"), "dup_of")
    named = named.filter(normalize_text(F.col("source_name")) != normalize_text(F.col("company")))
    ordered = F.array_sort(F.collect_list(F.struct("_r", "source_name")))
    return named.groupBy(F.col("dup_of").alias(key)).agg(F.transform(ordered, lambda x: x["source_name"]).alias("also_on"))
