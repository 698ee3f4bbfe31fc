"""State kept as a table in hash buckets of its key: an upsert rewrites the buckets it touches, all others keep their files.

Version ``n`` writes its buckets under ``v<n>`` and then a manifest that says which version each bucket has; the manifest is what commits it.  A batch
that is repeated after a failure reads the newest manifest below its own version and overwrites its own half-written files, so nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class BucketStore:
    """``buckets`` is chosen so that one bucket's rows suit one task; ``keep`` manifests and the files they name stay."""

    def __init__(self, path: str, schema: str, key: str | list[str] = "key", buckets: int = 64, keep: int = 3):
        self.path, self.schema, self.buckets, self.keep = path.rstrip("/"), schema, buckets, max(keep, 2)
        self.keys = [key] if isinstance(key, str) else key

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _fs(self, spark: SparkSession):
        make = spark._jvm.org.apache.hadoop.fs.Path
        return make(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), make

    def _names(self, spark: SparkSession, folder: str) -> list[str]:
        fs, make = self._fs(spark)
        return [s.getPath().getName() for s in fs.listStatus(make(folder))] if fs.exists(make(folder)) else []

    def versions(self, spark: SparkSession) -> list[int]:
        return sorted(int(n[1:]) for n in self._names(spark, f"{self.path}/manifests") if n[0] == "m" and n[1:].isdigit())

    def manifest(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """Bucket to version, of the newest version (below ``before``)."""
        done = [v for v in self.versions(spark) if before is None or v < before]
        if not done:
            return {}
        fs, make = self._fs(spark)
        stream = fs.open(make(f"{self.path}/manifests/m{done[-1]:012d}"))
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return {int(b): int(v) for b, v in (line.split() for line in text.splitlines())}

    def read(self, spark: SparkSession, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        found = self.manifest(spark, before)
        paths = [f"{self.path}/v{v:012d}/bucket={b}" for b, v in sorted(found.items()) if only is None or b in only]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def upsert(self, changes: DataFrame, version: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """``merge(old, changes)`` gives the new rows of the touched buckets (their numbers are returned).  Other buckets are neither read nor written.

        ``changes`` is read twice; the caller persists or writes it if that costs."""
        spark = changes.sparkSession
        touched = [r[0] for r in changes.select(self.bucket()).distinct().collect()]  # at most as many as there are buckets
        before = self.manifest(spark, version)
        folder = f"{self.path}/v{version:012d}"
        if touched:
            new = merge(self.read(spark, version, touched), changes).withColumn("bucket", self.bucket())
            new.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = {int(n.split("=")[1]) for n in self._names(spark, folder) if n.startswith("bucket=")} if touched else set()
        after = {b: v for b, v in before.items() if b not in touched} | {b: version for b in written}
        self._commit(spark, version, after)
        return sorted(touched)

    def _commit(self, spark: SparkSession, version: int, manifest: dict[int, int]) -> None:
        fs, make = self._fs(spark)
        draft, final = make(f"{self.path}/manifests/draft{version:012d}"), make(f"{self.path}/manifests/m{version:012d}")
        out = fs.create(draft, True)
        out.write(bytearray("".join(f"{b} {v}\n" for b, v in sorted(manifest.items())), "utf-8"))
        out.close()
        fs.delete(final, False)
        fs.rename(draft, final)
        done = [v for v in self.versions(spark) if v <= version]
        for old in done[:-self.keep]:
            fs.delete(make(f"{self.path}/manifests/m{old:012d}"), False)
        named = {(v, b) for kept in done[-self.keep:] for b, v in self.manifest(spark, kept + 1).items()}
        for name in self._names(spark, self.path):
            if name[0] == "v" and name[1:].isdigit() and int(name[1:]) < version:
                used = {b for v, b in named if v == int(name[1:])}
                if not used:
                    fs.delete(make(f"{self.path}/{name}"), True)
                    continue
                for part in self._names(spark, f"{self.path}/{name}"):
                    if part.startswith("bucket=") and int(part.split("=")[1]) not in used:
                        fs.delete(make(f"{self.path}/{name}/{part}"), True)


def add_names(seen: DataFrame, names: DataFrame) -> DataFrame:
    """Stored rows with the names (key, names) appended to ``also_on`` that are not in it yet; unknown keys are left out."""
    more = names.select("key", F.col("names").alias("_more"))
    none = F.array().cast("array<string>")
    grown = F.array_distinct(F.concat(F.coalesce("also_on", none), F.coalesce("_more", none)))
    return seen.join(more, "key", "left").withColumn("also_on", F.when(F.col("_more").isNull(), F.col("also_on")).otherwise(grown)).select(seen.columns)
