"""Folds of action logs as states that merge.

A partial state is made from any part of a log. Partial states of one key merge by minimum,
maximum or union, so parts may overlap, come twice, late or in any order: what the merged
state gives is the fold of the whole log (see :mod:`folds`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import domains
from ..functions import text
from .folds import WHEN, row_id

PAIR = ["user_id", "job_posting_id"]


@dataclass(frozen=True)
class Mergeable:
    """``part``: actions -> partial states, ``merge``: partial states -> fewer of them that
    say the same, ``finish``: merged states -> rows of the folded table."""

    part: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    finish: Callable[[DataFrame], DataFrame]


def _with(*value: str) -> Column:
    """An action's place in the order with some of its values; places are unique."""
    return F.struct(*WHEN, *value)


# ---- applications: first action, last profile, last stage, first time of `applied` ----


def _application_part(actions: DataFrame) -> DataFrame:
    staged = F.col("stage").isNotNull()
    log = actions.withColumn("profile_id", text.none_if_empty("profile_id"))
    return log.groupBy(*PAIR).agg(
        F.min(_with("profile_id")).alias("opened"),
        F.max(F.when(~staged & F.col("profile_id").isNotNull(), _with("profile_id")))
        .alias("tracked"),
        F.max(F.when(staged, _with("stage"))).alias("moved"),
        F.min(F.when(F.col("stage") == "applied", F.col("ts"))).alias("applied_at"))


def _application_merge(states: DataFrame) -> DataFrame:
    return states.groupBy(*PAIR).agg(
        F.min("opened").alias("opened"), F.max("tracked").alias("tracked"),
        F.max("moved").alias("moved"), F.min("applied_at").alias("applied_at"))


def _application_finish(states: DataFrame) -> DataFrame:
    return states.select(
        row_id(*PAIR).alias("id"), *PAIR,
        F.coalesce("tracked.profile_id", "opened.profile_id").alias("profile_id"),
        F.coalesce("moved.stage", F.lit(domains.STAGES[0])).alias("stage"),
        F.coalesce("moved.ts", "opened.ts").alias("stage_updated_at"), "applied_at",
        F.col("opened.ts").alias("created_at"))


# ---- bookmarks: the last deletion, and every save after it ----------------------------
# A deletion that comes late may fall between two saves, so all live saves are kept, one
# row each: a key with very many of them is spread over tasks.


def _bookmark_part(actions: DataFrame) -> DataFrame:
    return _bookmark_merge(actions.select(
        *PAIR, (F.col("action") == "delete").alias("gone"),
        text.none_if_empty(text.strip("note")).alias("note"), *WHEN).filter(
        F.col("action").isin("save", "delete")))


def _bookmark_merge(states: DataFrame) -> DataFrame:
    last = states.filter("gone").groupBy(*PAIR).agg(F.max(F.struct(*WHEN)).alias("_last"))
    # Equal rows are one action that came twice.
    saves = states.filter("NOT gone").distinct().join(last, PAIR, "left").filter(
        F.col("_last").isNull() | (F.struct(*WHEN) > F.col("_last"))).drop("_last")
    return saves.unionByName(last.select(
        *PAIR, F.lit(True).alias("gone"), F.lit(None).cast("string").alias("note"),
        *[F.col(f"_last.{c}").alias(c) for c in WHEN]))


def _bookmark_finish(states: DataFrame) -> DataFrame:
    noted = F.when(F.col("note").isNotNull(), F.struct(*WHEN))
    return states.filter("NOT gone").groupBy(*PAIR).agg(
        F.max_by("note", noted).alias("note"), F.min("ts").alias("saved_at")
    ).select(row_id(*PAIR).alias("id"), *PAIR, "note", "saved_at")


# ---- feedback: the last signal ---------------------------------------------------------


def _feedback_part(actions: DataFrame) -> DataFrame:
    return actions.groupBy(*PAIR).agg(
        F.max(_with("feedback", "reason")).alias("latest"), F.min("ts").alias("created_at"))


def _feedback_merge(states: DataFrame) -> DataFrame:
    return states.groupBy(*PAIR).agg(
        F.max("latest").alias("latest"), F.min("created_at").alias("created_at"))


def _feedback_finish(states: DataFrame) -> DataFrame:
    return states.select(row_id(*PAIR).alias("id"), *PAIR, "latest.feedback", "latest.reason",
                         "created_at", F.col("latest.ts").alias("updated_at"))


# ---- users: the last name given, the first time seen ------------------------------------


def _user_part(actions: DataFrame) -> DataFrame:
    log = actions.select(
        F.lower(text.strip("email")).alias("email"),
        text.none_if_empty(text.strip("display_name")).alias("display_name"), *WHEN)
    return log.groupBy("email").agg(
        F.max(F.when(F.col("display_name").isNotNull(), _with("display_name"))).alias("named"),
        F.min("ts").alias("created_at"))


def _user_merge(states: DataFrame) -> DataFrame:
    return states.groupBy("email").agg(
        F.max("named").alias("named"), F.min("created_at").alias("created_at"))


def _user_finish(states: DataFrame) -> DataFrame:
    return states.select(row_id("email").alias("id"), "email", "named.display_name",
                         "created_at")


APPLICATIONS = Mergeable(_application_part, _application_merge, _application_finish)
BOOKMARKS = Mergeable(_bookmark_part, _bookmark_merge, _bookmark_finish)
FEEDBACK = Mergeable(_feedback_part, _feedback_merge, _feedback_finish)
USERS = Mergeable(_user_part, _user_merge, _user_finish)
