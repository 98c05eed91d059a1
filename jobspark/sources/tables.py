"""Tables read by explicit columns, and state tables that are updated by bucket.

Plain Parquet has no in-place update. A state table is parted by a hash of its key; an
update writes only the buckets it touches, into a folder of its own, and counts once
its job has committed (``_SUCCESS``). Readers never meet half an update, and a lost job
leaves the former state as it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


FEW_SPLITS = 32


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores, when the files at hand have only a few splits.

    For costly work per row on small or unsplittable files. Inputs of more splits (of
    128 MB as a rule) stay as they are: moving them would cost more than it gives.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df if splits >= min(cores, FEW_SPLITS) else df.repartition(cores, key)


TASK_ROWS = 250_000


def dealt(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """Rows by their keys over as many tasks as hold about ``rows`` each.

    For groups and joins by keys that hardly repeat: a table read in large splits would
    fill the memory of a task, as nothing is merged before the shuffle. A number given
    here is one that AQE leaves alone.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, ceil(df.count() / rows)), *keys)


def bucket_of(keys: Iterable[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def touched_buckets(rows: DataFrame, keys: Iterable[str], buckets: int) -> list[int]:
    """The buckets some keys fall into: at most ``buckets`` numbers."""
    return sorted(r[0] for r in rows.select(
        bucket_of(keys, buckets).alias("b")).distinct().collect())


def write_buckets(df: DataFrame, keys: Iterable[str], buckets: int, path: str) -> None:
    """One folder per bucket. Large buckets are spread over several files and tasks."""
    (
        df.withColumn("bucket", bucket_of(keys, buckets)).hint("rebalance", "bucket")
        .write.mode("overwrite").partitionBy("bucket").parquet(path, compression="zstd")
    )


class StateTable:
    """A keyed state table below one shared path.

    ``buckets`` should grow with the table: an update rewrites whole buckets. One writer
    at a time; any number of readers.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str],
                 buckets: int = BUCKETS):
        self.spark, self.schema, self.keys, self.buckets = spark, schema, keys, buckets
        self.path = f"{path.rstrip('/')}/buckets={buckets}"

    def _glob(self, pattern: str) -> list:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.path}/{pattern}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath() for f in (fs.globStatus(path) or [])]

    def versions(self) -> list[int]:
        """Committed updates: the index of an update is written last."""
        return sorted(int(p.getParent().getName().split("=")[1])
                      for p in self._glob("index=*/_SUCCESS"))

    def _index(self, before: int | None = None) -> dict[int, int]:
        """Bucket -> update that wrote it last, for buckets that hold rows."""
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return {}
        newest = self.spark.read.schema("bucket INT, version INT").parquet(
            f"{self.path}/index={known[-1]}")
        return {r["bucket"]: r["version"] for r in newest.collect()}

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The present state, or the one before an update; of some buckets if named."""
        folders = [f"{self.path}/version={v}/bucket={b}"
                   for b, v in sorted(self._index(before).items()) if only is None or b in only]
        if not folders:
            # Known to be empty when a query is planned: joins with it move nothing.
            return self.spark.range(1).select(*[
                F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]).filter(F.lit(False))
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _commit(self, df: DataFrame, touched: list[int], version: int) -> int:
        folder = f"version={version}"
        write_buckets(df.select(*self.schema.fieldNames()), self.keys, self.buckets,
                      f"{self.path}/{folder}")
        index = {b: v for b, v in self._index(version).items() if b not in touched}
        for path in self._glob(f"{folder}/bucket=*"):
            index[int(path.getName().split("=")[1])] = version
        table = pd.DataFrame(
            sorted(index.items()), columns=["bucket", "version"], dtype="int32")
        self.spark.createDataFrame(table, "bucket INT, version INT").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index={version}")
        return version

    def vacuum(self, keep: int = 7) -> int:
        """Deletes folders that none of the last ``keep`` states needs; how many."""
        known = self.versions()
        if len(known) <= keep:
            return 0
        needed = {(v, b) for old in known[-keep:] for b, v in self._index(old + 1).items()}
        gone = [p for p in self._glob("version=*/bucket=*") if (
            int(p.getParent().getName().split("=")[1]),
            int(p.getName().split("=")[1])) not in needed
            and int(p.getParent().getName().split("=")[1]) <= known[-1]]
        gone += [p for p in self._glob("index=*")
                 if int(p.getName().split("=")[1]) < known[-keep]]
        for path in gone:
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(gone)

    def next_version(self) -> int:
        return max(self.versions(), default=0) + 1

    def write(self, df: DataFrame, version: int | None = None) -> int:
        """Replaces the whole state."""
        return self._commit(df, list(range(self.buckets)), version or self.next_version())

    def update(self, touched: DataFrame, change: Callable[[DataFrame], DataFrame],
               version: int | None = None) -> int:
        """Rewrites the buckets of the touched keys to ``change(their old rows)``.

        ``change`` must leave rows of other keys as they are. The same version written
        again starts from the same old state and replaces itself.
        """
        version = version or self.next_version()
        some = touched_buckets(touched, self.keys, self.buckets)
        return self._commit(change(self.read(version, some)), some, version)


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str) -> DataFrame:
    """A catalog table bucketed and sorted by ``key``.

    Two tables bucketed alike join on the key without moving either: worth it for
    postings and their vectors, which meet in every search.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option(
        "path", path).saveAsTable(name)
    return df.sparkSession.table(name)
