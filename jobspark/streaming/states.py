"""Streams of actions into states that merge (see :mod:`jobspark.operators.states`).

A micro-batch appends the partial states of its own actions and reads nothing else: what it
writes grows with the batch, whatever came before. Readers merge what there is; now and then
a plain job merges it on disk. A batch that is run again replaces its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.states import Mergeable


def fold_stream(spark: SparkSession, landing: str, action_schema: str, path: str,
                fold: Mergeable, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Landed actions (JSON lines) into partial states below ``path``."""
    landed = spark.readStream.schema(action_schema).option(
        "maxFilesPerTrigger", files_per_batch).json(landing)

    def batch(df: DataFrame, number: int) -> None:
        fold.part(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        landed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def committed(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the folders ``kind=number`` whose job has ended."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(f"{path}/{kind}=*/_SUCCESS")
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getParent().getName().split("=")[1])
                  for f in (fs.globStatus(pattern) or []))


def _folders(spark: SparkSession, path: str) -> list[str]:
    """The newest merged folder, and the batches after it."""
    merged = committed(spark, path, "merged")[-1:]
    later = [b for b in committed(spark, path, "batch") if not merged or b > merged[0]]
    return [f"{path}/merged={n}" for n in merged] + [f"{path}/batch={b}" for b in later]


def merged(spark: SparkSession, path: str, fold: Mergeable, action_schema: str) -> DataFrame:
    """The present states, one fold's worth, whatever batches they came in."""
    nothing = fold.part(spark.createDataFrame([], action_schema))
    folders = _folders(spark, path)
    if not folders:
        return nothing
    return fold.merge(spark.read.schema(nothing.schema).parquet(*folders))


def compact(spark: SparkSession, path: str, fold: Mergeable, action_schema: str) -> int | None:
    """Merges all committed batches into one folder, which later readers start from.

    Gives the number of the last batch in it, NULL if there was nothing to merge. What it
    replaces stays on disk for readers that have begun; batches may land meanwhile.
    """
    done, before = committed(spark, path, "batch"), committed(spark, path, "merged")
    if not done or (before and before[-1] >= done[-1]):
        return None
    merged(spark, path, fold, action_schema).write.mode("overwrite").parquet(
        f"{path}/merged={done[-1]}")
    return done[-1]
