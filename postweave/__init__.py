"""Postweave: incremental posting intelligence on Spark.

Landed payloads become one canonical posting table; runs and stream batches are incremental against remembered state;
postings are filtered with a reason, merged across sources, ranked, routed, published and tracked.  Everything is
written with the DataFrame, SQL and Structured Streaming APIs.
"""

__version__ = "0.1.0"
