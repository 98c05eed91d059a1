"""The batch jobs, run on what has newly arrived.

Every micro-batch writes the update that carries its batch number, made from the state
before it: a batch that is run again gives the same state.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import embedding, merge, prepare
from ..plans import refresh
from ..sources.tables import BUCKETS, StateTable, touched_buckets, write_buckets


def postings_stream(spark: SparkSession, landing: str, store_path: str, checkpoint: str,
                    embedder: embedding.Embedder, model: str, as_of: datetime,
                    buckets: int = BUCKETS, files_per_batch: int = 1000) -> StreamingQuery:
    """Landed postings (JSON lines of the common fields) into postings and vectors."""
    store = refresh.Store(spark, store_path, buckets)
    schema = schemas.POSTING + ", ingest_seq BIGINT"
    landed = spark.readStream.schema(schema).option(
        "maxFilesPerTrigger", files_per_batch).json(landing)

    def batch(df: DataFrame, number: int) -> None:
        version = number + 1
        ready = store.staged("batch", prepare.prepare(df, ["ingest_seq"]))
        refresh.sync_postings(store, ready, as_of, version)
        store.drop_staged("batch")
        refresh.embed_pending(store, embedder, model, as_of, version=version)
        store.drop_staged()

    return (
        landed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def actions_stream(spark: SparkSession, landing: str, action_schema: str, log_path: str,
                   state: StateTable, fold: Callable[[DataFrame], DataFrame],
                   checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Landed actions into a folded state table.

    Only keys with new actions are folded again, over their whole history, so late
    actions count as if they had come in time. Log and state are parted alike: a batch
    reads and rewrites only the buckets its keys fall into.
    """
    landed = spark.readStream.schema(action_schema).option(
        "maxFilesPerTrigger", files_per_batch).json(landing)
    keys, buckets = state.keys, state.buckets

    def batch(df: DataFrame, number: int) -> None:
        write_buckets(df, keys, buckets, f"{log_path}/batch={number}")
        log = spark.read.schema(f"{action_schema}, batch INT, bucket INT").parquet(
            log_path).filter(F.col("batch") <= number)
        new = log.filter(F.col("batch") == number).select(*keys).distinct()
        history = log.filter(F.col("bucket").isin(touched_buckets(new, keys, buckets)))
        folded = fold(history.drop("batch", "bucket").join(new, keys, "left_semi"))
        whole = _with_all_columns(folded, state)
        state.update(new, lambda old: merge.replace_groups(old, whole, keys, new), number + 1)

    return (
        landed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _with_all_columns(folded: DataFrame, state: StateTable) -> DataFrame:
    return folded.select(*[
        (F.col(f.name) if f.name in folded.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in state.schema])
