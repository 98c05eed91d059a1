"""Row rules: each rule yields a message when broken; rows part into valid and rejected."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from . import text


def required(column: str) -> Column:
    value = text.strip(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return F.when(value == "", F.lit(f"{column} is required."))


def at_most(column: str, maximum: int) -> Column:
    value = text.strip(F.col(column))
    return F.when(
        F.length(value) > maximum,
        F.lit(f"{column} must be {maximum:,} characters or fewer."),
    )


def one_of(column: str, allowed: Iterable[str], *, optional: bool = False) -> Column:
    allowed = list(allowed)
    bad = ~F.col(column).isin(allowed)
    missing = F.coalesce(F.col(column), F.lit("")) == ""
    broken = (~missing & bad) if optional else (missing | bad)
    return F.when(broken, F.lit(f"{column} must be one of: " + ", ".join(allowed)))


def email(column: str) -> Column:
    value = F.lower(text.strip(F.coalesce(F.col(column), F.lit(""))))
    fine = (
        F.contains(value, F.lit("@"))
        & ~F.startswith(value, F.lit("@"))
        & ~F.endswith(value, F.lit("@"))
    )
    return F.when(~fine, F.lit("Enter a valid email address."))


def not_negative(column: str) -> Column:
    return F.when(F.col(column) < 0, F.lit(f"{column} cannot be negative."))


def iso_day(column: str) -> Column:
    given = F.coalesce(F.col(column), F.lit("")) != ""
    return F.when(
        given & text.parse_day(F.col(column)).isNull(),
        F.lit(f"{column} must use YYYY-MM-DD."),
    )


def tidy(column: str) -> Column:
    """Stripped value; NULL when nothing is left."""
    return text.none_if_empty(text.strip(F.col(column))).alias(column)


def check(df: DataFrame, rules: Iterable[Column]) -> DataFrame:
    """Adds ``errors``, the messages of the broken rules in rule order."""
    return df.withColumn("errors", text.filled(*rules))


def valid(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") == 0).drop("errors")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("errors") > 0)


def append(checked: DataFrame, accepted: str, refused: str) -> None:
    """Appends valid rows to one Parquet table, rejected ones with their reasons to another."""
    valid(checked).write.mode("append").parquet(accepted)
    rejected(checked).write.mode("append").parquet(refused)
