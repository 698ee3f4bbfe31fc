"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_arrays import encoder
from .shared import by_blocks, spread_out, table, texts_of

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(documents: DataFrame, limit: int = 512, vocabulary: str = "byte_bpe_50k.json", text: str = "text",
                 key: str = "doc_id") -> DataFrame:
    """Count the tokens of whole texts: (doc_id, n_bytes, n_tokens, over_limit).

    Texts are split into pre-tokens held as ragged arrays; each distinct pre-token that a worker has not met is encoded by merging
    the lowest-rank pair of all sequences at once, and the surviving symbols are counted.  No shuffle; memory is bounded by a
    block of texts and the table of known pre-tokens.  Null text counts as empty (0 tokens); null or repeated keys are kept row by
    row; other columns are ignored; an empty table gives an empty table.
    """
    def make():
        counter = encoder(vocabulary)

        def block(ids, texts):
            counts = counter.counts(texts)
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts), pa.array(counts > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        return block

    return spread_out(texts_of(documents, text, key)).mapInArrow(by_blocks(make), SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).select(F.col("doc_id"), "n_bytes", "n_tokens", "over_limit")
