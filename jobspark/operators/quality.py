"""Checks over state tables. An empty result means no violation."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions import vectors


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows that name a parent which does not exist."""
    known = parent.select(F.col(key).alias(column))
    return child.filter(F.col(column).isNotNull()).join(known, column, "left_anti")


def orphan_counts(tables: Mapping[str, DataFrame], references: list[tuple]) -> DataFrame:
    """(child, child_column, parent, orphans) for every reference between given tables.

    Every table is read once for all its references. Child rows are counted per value
    first; only the distinct values meet the parents' keys.
    """
    known = [r for r in references if r[0] in tables and r[2] in tables]
    targets = sorted({(parent, key) for _, _, parent, key in known})
    values = []
    for child in sorted({r[0] for r in known}):
        pairs = F.array(*[
            F.struct(F.lit(i).alias("ref"), F.lit(targets.index((parent, key))).alias("target"),
                     F.col(column).cast("string").alias("value"))
            for i, (name, column, parent, key) in enumerate(known) if name == child])
        values.append(tables[child].select(F.explode(pairs).alias("p")).select("p.*"))
    counted = reduce(DataFrame.unionAll, values).filter("value IS NOT NULL").groupBy(
        "ref", "target", "value").agg(F.count("*").alias("n"))
    keys = reduce(DataFrame.unionAll, [
        tables[parent].select(F.lit(i).alias("target"), F.col(key).cast("string").alias("value"))
        for i, (parent, key) in enumerate(targets)])
    lost = counted.join(keys, ["target", "value"], "left_anti").groupBy("ref").agg(
        F.sum("n").alias("n"))
    listed = next(iter(tables.values())).sparkSession.createDataFrame(pd.DataFrame(
        [(i, *r[:3]) for i, r in enumerate(known)],
        columns=["ref", "child", "child_column", "parent"]))
    return listed.join(lost, "ref", "left").select(
        "child", "child_column", "parent", F.coalesce("n", F.lit(0)).alias("orphans"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def domain_violations(df: DataFrame, allowed: Mapping[str, tuple]) -> DataFrame:
    """(column_name, bad_value, bad_rows) of values outside their domain; NULL is none."""
    parts = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("bad_value"),
                 F.col(c).isin(*values).alias("_known"))
        for c, values in allowed.items()
    ])
    return (
        df.select(F.explode(parts).alias("p")).select("p.*")
        .filter(F.col("_known") == F.lit(False))
        .groupBy("column_name", "bad_value").agg(F.count("*").alias("bad_rows"))
    )


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, missing_rows) of columns that must be filled, in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "missing_rows")


def schema_differences(df: DataFrame, expected: StructType) -> DataFrame:
    """(column_name, expected_type, actual_type) where the two schemas differ."""
    want = {f.name: f.dataType.simpleString() for f in expected}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = [(c, want.get(c), have.get(c)) for c in sorted(want | have)
            if want.get(c) != have.get(c)]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, expected_type string, actual_type string")


def conformance(df: DataFrame, expected: StructType) -> DataFrame:
    """(column_name, expected_type, actual_type, missing_rows) of every expected column,
    in one pass; an absent column misses in every row."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    names = expected.fieldNames()
    one = df.agg(*[
        (F.count_if(F.col(c).isNull()) if c in have else F.count("*")).alias(c) for c in names])
    types = df.sparkSession.createDataFrame(pd.DataFrame(
        [(f.name, f.dataType.simpleString(), have.get(f.name, "absent")) for f in expected],
        columns=["column_name", "expected_type", "actual_type"]))
    return types.join(one.unpivot([], names, "column_name", "missing_rows"), "column_name")


def inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of every table."""
    rows = [df.agg(F.count("*").alias("row_count"))
            .select(F.lit(name).alias("table_name"), "row_count")
            for name, df in tables.items()]
    return reduce(DataFrame.unionAll, rows)


def bad_vectors(df: DataFrame, column: str, dimension: int) -> DataFrame:
    return df.filter(~vectors.has_dimension(column, dimension))


def by_rule(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, broken_rows) of named conditions that every row should meet."""
    one = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name)
                   for name, ok in rules.items()])
    return one.unpivot([], list(rules), "rule", "broken_rows")
