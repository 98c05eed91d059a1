"""State tables from append-only action logs.

Every action carries ``ts`` and a unique ``seq``; (ts, seq) is the order in which
actions took effect. All folds are grouped aggregates, so a key with very many
actions is reduced inside each task before rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import domains
from ..functions import text

WHEN = ("ts", "seq")


def _at() -> Column:
    return F.struct(*WHEN)


def row_id(*columns: str) -> Column:
    """A stable id from key columns: the same on every run."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)


def last(value: str, where: Column | None = None) -> Column:
    """Value of the last action; with ``where``, of the last one that meets it."""
    at = _at() if where is None else F.when(where, _at())
    return F.max_by(value, at)


def last_given(value: str) -> Column:
    """Last value that is neither NULL nor empty."""
    given = F.coalesce(F.col(value).cast("string"), F.lit("")) != ""
    return last(value, given)


def users(actions: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """One user per lower-cased email; a later name replaces, a missing one does not.

    ``actions``: email, display_name, ts, seq. ``state``: id, email, display_name,
    created_at.
    """
    log = actions.select(
        F.lower(text.strip("email")).alias("email"),
        text.strip("display_name").alias("display_name"), *WHEN)
    folded = log.groupBy("email").agg(
        last_given("display_name").alias("new_name"), F.min("ts").alias("first_ts"))
    if state is None:
        return folded.select(row_id("email").alias("id"), "email",
                             F.col("new_name").alias("display_name"),
                             F.col("first_ts").alias("created_at"))
    return state.join(folded, "email", "full_outer").select(
        F.coalesce("id", row_id("email")).alias("id"), "email",
        F.coalesce("new_name", "display_name").alias("display_name"),
        F.coalesce("created_at", "first_ts").alias("created_at"))


def bookmarks(actions: DataFrame, slice_: str = "hour") -> DataFrame:
    """Bookmarks that remain after saves and deletions.

    ``actions``: user_id, job_posting_id, action (save, delete), note, ts, seq. A
    deletion forgets what came before it; a save without note keeps the former note.

    The log of one bookmark may be long: deletions are first applied within slices of
    time, then the slices before the last deletion fall away.
    """
    key = ["user_id", "job_posting_id"]
    inside = Window.partitionBy(*key, "_slice")
    gone = F.max(F.when(F.col("action") == "delete", _at())).over(inside)
    log = actions.withColumns({
        "note": text.none_if_empty(text.strip("note")),
        "_slice": F.date_trunc(slice_, "ts")}).withColumn("_gone", gone)
    live = (F.col("action") == "save") & (F.col("_gone").isNull() | (_at() > F.col("_gone")))
    noted = live & F.col("note").isNotNull()
    slices = log.groupBy(*key, "_slice").agg(
        F.max("_gone").alias("_gone"), F.count_if(live).alias("_saves"),
        last("note", noted).alias("note"), F.min(F.when(live, F.col("ts"))).alias("saved_at"))
    cut = F.max(F.when(F.col("_gone").isNotNull(), F.col("_slice"))).over(
        Window.partitionBy(*key))
    kept = slices.withColumn("_cut", cut).filter(
        (F.col("_saves") > 0) & (F.col("_cut").isNull() | (F.col("_slice") >= F.col("_cut"))))
    return kept.groupBy(*key).agg(
        F.max_by("note", F.when(F.col("note").isNotNull(), F.col("_slice"))).alias("note"),
        F.min("saved_at").alias("saved_at"),
    ).select(row_id(*key).alias("id"), *key, "note", "saved_at")


def applications(actions: DataFrame) -> DataFrame:
    """Applications from track and stage actions.

    ``actions``: user_id, job_posting_id, stage, profile_id, ts, seq; a NULL stage is
    a plain track. The first action starts at its stage, or at ``saved``; later a track
    changes only the profile and a stage action leaves it; ``applied_at`` is the first
    time of ``applied``.
    """
    key = ["user_id", "job_posting_id"]
    staged = F.col("stage").isNotNull()
    tracked_for = ~staged & F.col("profile_id").isNotNull()
    first_ts = F.min("ts")
    log = actions.withColumn("profile_id", text.none_if_empty("profile_id"))
    return log.groupBy(*key).agg(
        F.coalesce(last("profile_id", tracked_for), F.min_by("profile_id", _at()))
        .alias("profile_id"),
        F.coalesce(last("stage", staged), F.lit(domains.STAGES[0])).alias("stage"),
        F.coalesce(F.max(F.when(staged, F.col("ts"))), first_ts).alias("stage_updated_at"),
        F.min(F.when(F.col("stage") == "applied", F.col("ts"))).alias("applied_at"),
        first_ts.alias("created_at"),
    ).select(row_id(*key).alias("id"), *key, "profile_id", "stage", "stage_updated_at",
             "applied_at", "created_at")


def feedback(actions: DataFrame) -> DataFrame:
    """The last signal per (user, posting); its reason replaces even by NULL."""
    key = ["user_id", "job_posting_id"]
    return actions.groupBy(*key).agg(
        F.max_by(F.struct("feedback", "reason"), _at()).alias("_last"),
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
    ).select(row_id(*key).alias("id"), *key, "_last.feedback", "_last.reason",
             "created_at", "updated_at")


def stale(as_of: Column, days: int = domains.STALE_DAYS) -> Column:
    """Applied, and without an update for more than ``days`` days."""
    cutoff = as_of - F.make_dt_interval(days=F.lit(max(1, int(days))))
    return (F.col("stage") == "applied") & (F.col("stage_updated_at") < cutoff)


def refresh_stale(apps: DataFrame, as_of: Column, days: int = domains.STALE_DAYS) -> DataFrame:
    """Flags set and cleared as of a time; a standing flag keeps its time."""
    now = stale(as_of, days)
    return apps.withColumns({
        "is_stale": F.coalesce(now, F.lit(False)),
        "stale_flagged_at": F.when(now, F.coalesce("stale_flagged_at", as_of)),
    })


def single_default(profiles: DataFrame) -> DataFrame:
    """Profiles of which the last one created as default is the only one per user.

    ``profiles``: user_id, is_default, ts, seq and more columns.
    """
    newest = profiles.filter("is_default").groupBy("user_id").agg(
        F.max(_at()).alias("_newest"))
    return (
        profiles.join(newest, "user_id", "left")
        .withColumn("is_default", F.coalesce(_at() == F.col("_newest"), F.lit(False)))
        .drop("_newest")
    )


def stage_transitions(actions: DataFrame, slice_: str = "hour") -> DataFrame:
    """Every stage action with the stage before it, and whether users are offered
    that move. The first action of an application has no former stage.

    The log of one application may be long, so the previous stage is looked up by
    slices of time: inside a slice by a window, across slices from a slice's last stage.
    """
    key = ["user_id", "job_posting_id"]
    log = actions.filter(F.col("stage").isNotNull()).withColumn(
        "_slice", F.date_trunc(slice_, "ts"))
    inside = Window.partitionBy(*key, "_slice").orderBy(*WHEN)
    across = Window.partitionBy(*key).orderBy("_slice")
    ends = log.groupBy(*key, "_slice").agg(last("stage").alias("_end"))
    before = ends.select(*key, "_slice", F.lag("_end").over(across).alias("_before"))
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in domains.STAGE_MOVES])
    return (
        log.withColumn("_prev", F.lag("stage").over(inside))
        .join(before, [*key, "_slice"])
        .withColumn("previous_stage", F.coalesce("_prev", "_before"))
        .withColumn("allowed", F.when(
            F.col("previous_stage").isNotNull(),
            F.array_contains(allowed, F.concat_ws(">", "previous_stage", "stage"))))
        .drop("_slice", "_prev", "_before")
    )


def transition_counts(actions: DataFrame) -> DataFrame:
    return (
        stage_transitions(actions).filter(F.col("previous_stage").isNotNull())
        .groupBy("previous_stage", "stage", "allowed").agg(F.count("*").alias("moves"))
    )
