"""Session helpers: settings that suit the jobs, and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "postweave", cores: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the session comes from spark-submit."""
    cores = cores or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only where it is unset and Spark runs in one process (tests) a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        folder = named
    else:
        folder = spark.sparkContext.getCheckpointDir()
        if not folder and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = folder or tempfile.mkdtemp(prefix="postweave-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def spread(df: DataFrame) -> DataFrame:
    """Use every core when the input has fewer splits than cores (one small file); otherwise the plan is unchanged.

    At scale a scan has far more splits than cores, so no shuffle is added.  Counting splits only plans the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, unlike a local one."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Write to the shared folder and read again: what several branches of a plan need is computed once, read by column, and survives lost executors."""
    checkpoint_dir(df.sparkSession)
    folder = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_sql_literal(v) for v in value) + ")"
    if isinstance(value, (bool, int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def small_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A configuration table as a local relation.  Its size is known, so Spark itself decides to broadcast it."""
    fields = [tuple(f.strip().split(" ", 1)) for f in schema.split(", ")]
    names = ", ".join(n for n, _ in fields)
    casts = ", ".join(f"CAST({n} AS {kind}) AS {n}" for n, kind in fields)
    values = rows or [tuple(None for _ in fields)]
    body = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in values)
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({names})" + ("" if rows else " WHERE false"))
