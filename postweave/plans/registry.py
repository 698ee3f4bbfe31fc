"""Where queries and their SQL twins are kept."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..session import spread, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_TEXTS = ("documents", "pages", "conversations")  # much work per row

NOW = datetime(2001, 8, 2)  # clock of the posting view: the last order date
EVENTS_NOW = datetime(2024, 1, 31)  # clock of the event table

# Postings derived from the driver tables.  Only 200 parts are ever referenced, so the part scan is filtered to them.
POSTINGS_SQL = """
SELECT concat('s', CAST(o.o_orderkey % 10 AS VARCHAR(20))) AS source_key,
       CAST(o.o_orderkey AS VARCHAR(20)) AS native_id,
       concat('s', CAST(o.o_orderkey % 10 AS VARCHAR(20)), ':', CAST(o.o_orderkey AS VARCHAR(20))) AS posting,
       concat(p.p_name, ' ', lower(p.p_type), CASE WHEN o.o_orderkey % 4 = 0 THEN ' (m/f/d)' ELSE '' END) AS title,
       concat('Customer ', CAST(o.o_custkey % 50 AS VARCHAR(20)),
              CASE WHEN o.o_orderkey % 2 = 0 THEN ' Ltd.' ELSE '' END) AS company,
       concat('https://', CASE WHEN o.o_orderkey % 3 = 0 THEN 'www.' ELSE '' END, 'jobs.example.test/',
              CAST(o.o_orderkey % 900 AS VARCHAR(20)), '/?utm_source=x') AS url,
       concat(n.n_name, ', ', r.r_name) AS location, r.r_name AS target,
       CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE o.o_orderdate END AS posted_at,
       CAST(floor(o.o_totalprice) AS BIGINT) % 101 AS score,
       c.c_mktsegment AS family, substr(o.o_orderpriority, 1, 1) AS grp,
       CASE WHEN o.o_orderkey % 97 = 0 THEN 'page_change' ELSE 'job' END AS kind,
       o.o_orderkey AS n, o.o_orderdate AS seen_at, p.p_size AS size
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey
JOIN {region} r ON r.r_regionkey = n.n_regionkey
JOIN {part} p ON p.p_partkey = o.o_orderkey % 200 AND p.p_partkey BETWEEN 0 AND 199
"""
_NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
V = "v AS (" + POSTINGS_SQL.format(**{n: n for n in _NAMES}) + ")"
NOW_SQL = "TIMESTAMP '2001-08-02 00:00:00'"
EVENTS_NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


class Tables:
    """The driver tables of one scale, read lazily; column pruning and filters reach the Parquet scan.

    ``once``: the posting view is written before its first use, for queries that would otherwise join it anew in many branches."""

    def __init__(self, spark: SparkSession, sf_dir: str, once: bool = False):
        self.spark, self.dir, self.once = spark, sf_dir, once

    def __getattr__(self, name: str) -> DataFrame:
        if name not in _NAMES:
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return spread(df) if name in _TEXTS else df

    @cached_property
    def v(self) -> DataFrame:
        view = self.spark.sql(POSTINGS_SQL, orders=spread(self.orders), customer=self.customer, nation=self.nation,
                              region=self.region, part=self.part)
        return spread(written(view, "postings")) if self.once else view

    @cached_property
    def ev(self) -> DataFrame:
        """Events with a proper timestamp."""
        events = self.events
        return events.withColumn("ts", events.ts.cast("timestamp"))


def query(name: str, sql: str | None = None, once: bool = False):
    """Register ``fn(Tables) -> DataFrame`` under ``name``, with its SQL twin if it has one; ``once`` as for ``Tables``."""
    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir, once))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return wrap
