"""First row and first n rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Up to this n Spark itself keeps only n rows per key and task before it shuffles
# (WindowGroupLimit); above it the first pass below does.
GROUP_LIMIT_CONF = "spark.sql.optimizer.windowGroupLimitThreshold"


def ranked(df: DataFrame, keys: list, order: list[Column], n: int,
           rank: str = "rank", salts: int = 64) -> DataFrame:
    """The first ``n`` rows of every key, with their rank.

    ``order`` must be total within a key. A key that holds a large share of all
    rows never meets in one task: rows are cut to ``n`` per key before the shuffle,
    or, for large ``n``, per key and hash slice first.
    """
    limit = int(df.sparkSession.conf.get(GROUP_LIMIT_CONF, "1000"))
    if n > limit:
        slice_ = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
        part = Window.partitionBy(*keys, slice_).orderBy(*order)
        df = df.withColumn(rank, F.row_number().over(part)).filter(F.col(rank) <= n)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= n)


def first_per_key(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    return ranked(df, keys, order, 1, "_rank").drop("_rank")
