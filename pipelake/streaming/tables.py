"""A keyed table that streaming batches are merged into: hash buckets, versions, and a commit per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "batch long, bucket int, version long"


def newest(keys: list[str], order: list[str] | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that keeps one row per key: a batch's over a stored one, and inside a batch the one that is last by ``order`` (by default by all columns)."""

    def merge(stored: DataFrame, batch: DataFrame) -> DataFrame:
        columns = batch.columns
        both = stored.select(*columns, F.lit(0).alias("_new")).union(batch.select(*columns, F.lit(1).alias("_new")))
        kept = F.max_by(F.struct(*columns), F.struct("_new", *(order or []))).alias("r")
        return both.groupBy(*[F.col(k) for k in keys]).agg(kept).select("r.*")

    return merge


class UpsertTable:
    """Rows by key in ``buckets`` hash buckets below ``path``.

    A batch rewrites the buckets it touches and no others, so reading costs what the live rows cost, however many batches there were. Each
    version of a bucket is a folder named by the batch that wrote it; a batch ends by writing one file with the version of every bucket, its
    commit. Readers take the last commit. A batch that is killed before leaves no commit, and one that is replayed starts from the last commit
    before its own number, so it changes nothing. Choose ``buckets`` so that one holds what a task can rewrite; it is fixed by the first batch.

    merge(stored, batch) gives the new rows of the touched buckets; it sees all rows of a bucket key.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_by: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = 16):
        self.spark, self.path, self.bucket_by, self.merge, self.buckets = spark, path.rstrip("/"), bucket_by, merge, buckets

    def _files(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def versions(self, before: int | None = None) -> dict[int, int]:
        """The version of each bucket in the last commit (of a batch below ``before``); as many entries as there are buckets."""
        fs, place = self._files(f"{self.path}/commits")
        if not fs.exists(place):
            return {}
        found = [int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(place) if s.isDirectory() and fs.exists(self._files(f"{s.getPath()}/_SUCCESS")[1])]
        found = [n for n in found if before is None or n < before]
        if not found:
            return {}
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/commits/batch={max(found)}").collect()
        return {r.bucket: r.version for r in rows}

    def _read(self, versions: dict[int, int], schema) -> DataFrame:
        paths = [f"{self.path}/rows/batch={v}/bucket={b}" for b, v in versions.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, schema) -> DataFrame:
        return self._read(self.versions(), schema)

    def upsert(self, batch: DataFrame, number: int) -> None:
        bucket = F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")
        batch = batch.persist()
        try:
            touched = [r[0] for r in batch.select(bucket.alias("b")).distinct().collect()]
            before = self.versions(number)
            stored = self._read({b: before[b] for b in touched if b in before}, batch.schema)
            merged = self.merge(stored, batch).withColumn("bucket", bucket)
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={number}")
        finally:
            batch.unpersist()
        fs, _ = self._files(self.path)
        # A merge may leave a bucket without rows.
        kept = [b for b in touched if fs.exists(self._files(f"{self.path}/rows/batch={number}/bucket={b}")[1])]
        after = {b: v for b, v in before.items() if b not in touched} | dict.fromkeys(kept, number)
        commit = self.spark.createDataFrame(list(after.items()), "bucket int, version long")
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={number}")

    def vacuum(self, keep: int = 2) -> int:
        """Delete the commits but the last ``keep`` and the versions that none of those names; the number of folders deleted."""
        fs, place = self._files(f"{self.path}/commits")
        numbers = sorted(int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(place)) if fs.exists(place) else []
        named = {(b, v) for n in numbers[-keep:] for b, v in self.versions(n + 1).items()}
        gone = [f"{self.path}/commits/batch={n}" for n in numbers[:-keep]]
        rows = self._files(f"{self.path}/rows")[1]
        for version in fs.listStatus(rows) if fs.exists(rows) else []:
            v = int(version.getPath().getName().removeprefix("batch="))
            if v > max(numbers, default=-1):
                continue  # of a batch under way
            for s in fs.listStatus(version.getPath()):
                name = s.getPath().getName()
                if name.startswith("bucket=") and (int(name.removeprefix("bucket=")), v) not in named:
                    gone.append(str(s.getPath()))
        for path in gone:
            fs.delete(self._files(path)[1], True)
        return len(gone)
