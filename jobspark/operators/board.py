"""The application board: stages, notes, bookmarks, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import domains
from . import folds
from .topn import ranked

POSTING_FACTS = ["title", "company", "location", "remote", "apply_url"]


def posting_facts(postings: DataFrame, columns: list[str] = POSTING_FACTS) -> DataFrame:
    return postings.select(F.col("id").alias("job_posting_id"), *columns)


def _known(rows: DataFrame, users: DataFrame, postings: DataFrame) -> DataFrame:
    """Rows whose user and posting exist, so that a limit can come before the joins."""
    return rows.join(
        users.select(F.col("id").alias("user_id")), "user_id", "left_semi"
    ).join(postings.select(F.col("id").alias("job_posting_id")), "job_posting_id", "left_semi")


def stage_rank(column: str = "stage") -> Column:
    order = F.array(*[F.lit(s) for s in domains.STAGES])
    return F.array_position(order, F.col(column)).cast("int")


def note_counts(notes: DataFrame, as_of: Column) -> DataFrame:
    """Notes per application and the next follow-up on or after a day."""
    return notes.groupBy("application_id").agg(
        F.count("*").alias("note_count"),
        F.min(F.when(F.col("follow_up_date") >= as_of, F.col("follow_up_date")))
        .alias("next_follow_up"),
    )


def board(apps: DataFrame, postings: DataFrame, notes: DataFrame, as_of: Column) -> DataFrame:
    """One row per application with posting facts and note counts.

    Notes are counted before the join. Order by stage_rank and stage_updated_at for
    display; rows are not packed into lists, which may grow without bound.
    """
    return (
        apps.join(posting_facts(postings), "job_posting_id")
        .join(note_counts(notes, as_of).withColumnRenamed("application_id", "id"), "id", "left")
        .withColumn("note_count", F.coalesce("note_count", F.lit(0)))
        .withColumn("stage_rank", stage_rank())
    )


def board_counts(apps: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """One row per user: applications in each of the five stages, and totals."""
    tracked = apps.groupBy("user_id").agg(
        *[F.count_if(F.col("stage") == s).alias(s + "_stage") for s in domains.STAGES],
        F.count("*").alias("application_count"))
    saved = bookmarks.groupBy("user_id").agg(F.count("*").alias("saved_count"))
    counts = [s + "_stage" for s in domains.STAGES] + ["application_count", "saved_count"]
    return tracked.join(saved, "user_id", "full_outer").select(
        "user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def saved_with_posting(bookmarks: DataFrame, postings: DataFrame) -> DataFrame:
    return bookmarks.join(posting_facts(postings), "job_posting_id")


def recent_activity(apps: DataFrame, users: DataFrame, postings: DataFrame,
                    notes: DataFrame, limit: int = 25) -> DataFrame:
    """The applications updated last, with user, posting and number of notes."""
    owner = users.select(F.col("id").alias("user_id"), "email")
    last = (
        _known(apps, users, postings).orderBy(F.desc("stage_updated_at"), "id").limit(limit))
    counts = notes.groupBy("application_id").agg(F.count("*").alias("interview_notes"))
    return (
        last.join(owner, "user_id")
        .join(posting_facts(postings, ["title", "company"]), "job_posting_id")
        .join(counts.withColumnRenamed("application_id", "id"), "id", "left")
        .select("id", "email", "title", "company", "stage", "stage_updated_at",
                F.coalesce("interview_notes", F.lit(0)).alias("interview_notes"))
    )


def stale_report(apps: DataFrame, users: DataFrame, postings: DataFrame, as_of: Column,
                 days: int = domains.STALE_DAYS) -> DataFrame:
    """Stale applications with the days since their last update."""
    owner = users.select(F.col("id").alias("user_id"), "email")
    n = max(1, int(days))
    return (
        apps.filter(folds.stale(as_of, n)).join(owner, "user_id")
        .join(posting_facts(postings, ["title", "company"]), "job_posting_id")
        .select("id", "email", "job_posting_id", "title", "company", "stage_updated_at",
                F.datediff(as_of.cast("date"), F.to_date("stage_updated_at"))
                .alias("days_without_update"))
    )


def oldest_stale(report: DataFrame, n: int) -> DataFrame:
    """Each user's ``n`` stale applications that wait longest, with their rank."""
    return ranked(report, ["email"], [F.col("stage_updated_at"), F.col("id")], n)


def stage_funnel(apps: DataFrame) -> DataFrame:
    return apps.groupBy("stage").agg(F.count("*").alias("applications")).withColumn(
        "stage_rank", stage_rank())


def feedback_mix(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("feedback").agg(F.count("*").alias("responses"))


def recent_feedback(feedback: DataFrame, users: DataFrame, postings: DataFrame,
                    limit: int = 30) -> DataFrame:
    owner = users.select(F.col("id").alias("user_id"), "email")
    last = (
        _known(feedback, users, postings).orderBy(F.desc("updated_at"), "id").limit(limit))
    return (
        last.join(owner, "user_id")
        .join(posting_facts(postings, ["title", "company"]), "job_posting_id")
        .select("id", "email", "title", "company", "feedback", "reason", "updated_at")
    )


def own_notes(notes: DataFrame, apps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) notes: a note needs an application of the same user."""
    own = apps.select(F.col("id").alias("application_id"), "user_id")
    key = ["application_id", "user_id"]
    return notes.join(own, key, "left_semi"), notes.join(own, key, "left_anti")


def posting_stats(postings: DataFrame) -> DataFrame:
    """Counts by source and, with ``is_total`` 1, over all sources."""
    return postings.rollup("source").agg(
        F.grouping("source").cast("int").alias("is_total"),
        F.count("*").alias("postings"),
        F.count_if("remote").alias("remote_postings"),
        F.min("posted_at").alias("oldest"), F.max("posted_at").alias("newest"),
        F.max("synced_at").alias("last_synced_at"),
    )


def source_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("source").agg(F.count("*").alias("postings"))


def profile_list(profiles: DataFrame) -> DataFrame:
    return profiles.select(
        "id", "user_id", "label", "target_roles", "seniority", "salary_min",
        "salary_currency", "remote_preference", "locations_preferred", "deal_breakers",
        "resume_filename", F.col("resume_text").isNotNull().alias("has_resume"),
        F.length("resume_text").alias("resume_characters"),
        "is_default", "created_at", "updated_at")


def profile_order() -> list[Column]:
    """Default profiles first, then the oldest."""
    return [F.desc("is_default"), F.col("created_at"), F.col("id")]
