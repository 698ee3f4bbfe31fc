"""A training corpus from raw documents: quality filter, near-duplicate removal, masking of personal data, packing into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.llm.near_dedup import near_duplicates
from postweave.llm.packing import pack
from postweave.llm.private_data import masked
from postweave.llm.quality import kept
from postweave.llm.shared import hold, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on this table, accepts."""
    return kept(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity 0.8): the one with the smallest id.

    Of rows with an equal id and text one stays; of rows with an equal id and different texts all stay if one of them is kept.  Rows without an id can't be named in a
    group; of those with equal texts one stays.  The kept ids grow with the input, so the texts are joined in sorted order at every size, not a broadcast where a table
    happens to be small."""
    found = near_duplicates(docs.where("doc_id is not null")).where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"))
    found = hold(found, "kept")
    named = docs.join(found.select("doc_id").hint("merge"), "doc_id", "left_semi").select(docs.columns)
    if found.where("copies > 1").limit(1).count():
        named = named.dropDuplicates(["doc_id", "text"])
    return named.union(docs.where("doc_id is null").dropDuplicates(["text"]))


def mask_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; ``n_chars`` follows the text."""
    out = masked(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and offset."""
    return pack(docs)


STAGES = [("quality_classifier", quality_filter), ("minhash_near_dedup", drop_near_duplicates), ("private_data", mask_private_data), ("best_fit_packing", pack_sequences)]
ORACLE_SQL = None  # a trained classifier and a trained tagger can't be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = hold(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
