"""A table in hash buckets of its key that changes by buckets: a version writes the buckets that it touches and no others.

Under the root lie `data/v=<n>/_bucket=<b>` and `manifests/v=<n>`, which says for each bucket the version that holds it. A
version is there when its manifest is whole (`_SUCCESS`), and takes effect in that one step. Version n is built on the
manifest of n - 1 alone, so building it again after a failure, over whatever the failure left, gives the same state. What
neither of the last two versions holds is deleted.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "_bucket"


def folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = folder(spark, path)
    return store.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, store = folder(spark, path)
    store.delete(at, True)


def numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers n of the folders `prefix`n under `path` that are written to the end."""
    at, store = folder(spark, path)
    names = [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and exists(spark, f"{path}/{n}/_SUCCESS"))


@dataclass(frozen=True)
class BucketStore:
    spark: SparkSession
    root: str
    key: str
    schema: str
    buckets: int = 256

    def bucket(self, key: str | Column | None = None) -> Column:
        return F.pmod(F.xxhash64(key if key is not None else self.key), F.lit(self.buckets)).cast("int")

    def touched(self, batch: DataFrame, key: str | None = None) -> list[int]:
        """The buckets of a batch's keys: a list no longer than there are buckets."""
        return sorted(r[0] for r in batch.select(self.bucket(key).alias("b")).distinct().collect())

    def manifest(self, version: int) -> dict[int, int]:
        if version < 0:
            return {}
        path = f"{self.root}/manifests/v={version}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            raise FileNotFoundError(f"version {version} of {self.root} is not there")
        return {r.bucket: r.version for r in self.spark.read.schema("bucket int, version int").parquet(path).collect()}

    def last(self) -> int:
        """The newest whole version, -1 if there is none."""
        return max(numbered(self.spark, f"{self.root}/manifests", "v="), default=-1)

    def read(self, version: int, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        held = self.manifest(version)
        paths = [f"{self.root}/data/v={v}/{BUCKET}={b}" for b, v in held.items() if buckets is None or b in set(buckets)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, version: int, rows: DataFrame, touched: Iterable[int]) -> None:
        """Version `version`: the one before with the buckets `touched` replaced by `rows`, which are all of their rows."""
        data, touched = f"{self.root}/data/v={version}", set(touched)
        spread = rows.withColumn(BUCKET, self.bucket()).repartition(max(1, len(touched)), BUCKET)
        spread.write.mode("overwrite").partitionBy(BUCKET).parquet(data)
        at, store = folder(self.spark, data)
        full = {int(f.getPath().getName().removeprefix(f"{BUCKET}=")) for f in store.listStatus(at) if f.getPath().getName().startswith(BUCKET)}
        if not full <= touched:
            raise ValueError(f"rows of buckets that were not named: {sorted(full - touched)[:5]}")
        before = self.manifest(version - 1)
        now = {b: v for b, v in before.items() if b not in touched} | dict.fromkeys(full, version)
        self.spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifests/v={version}")
        if version >= 2:
            kept = {*before.items(), *now.items()}
            for b, v in self.manifest(version - 2).items() if exists(self.spark, f"{self.root}/manifests/v={version - 2}/_SUCCESS") else ():
                if (b, v) not in kept:
                    delete(self.spark, f"{self.root}/data/v={v}/{BUCKET}={b}")
            delete(self.spark, f"{self.root}/manifests/v={version - 2}")
