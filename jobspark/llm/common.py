"""Helpers that the operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import session


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors share."""
    return session.working_dir(spark, name)


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder and cut off from its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Written to a fresh shared folder and read back: computed once, cut off from its lineage."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {x.lower() for x in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of every node that has a link; a component is named by its
    smallest node.

    Each round takes the smallest label among a node's neighbours and then the label of
    that label, so that distances halve. Links to itself and with NULL are ignored.
    """
    one = links.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node <> other")
    both = checkpoint(one.union(one.select("other", "node")).distinct())
    labels = checkpoint(both.groupBy("node").agg(F.min("other").alias("m")).select(
        "node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy(
            "node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        lower = checkpoint(lower)
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        labels = checkpoint(lower.join(jump, "label").select("node", "was", F.col("beyond").alias("label")))
        if labels.filter("label <> was").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")
