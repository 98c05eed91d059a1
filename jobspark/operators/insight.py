"""Skill gaps, listing risk, match context and grounded prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import domains
from ..functions import text
from .topn import ranked

# ---- skills ---------------------------------------------------------------------


def skill_gap(pairs: DataFrame, profiles: DataFrame, postings: DataFrame,
              skills: tuple[str, ...] = domains.SKILLS, *, whole_words: bool = False,
              max_postings: int | None = None) -> DataFrame:
    """Per profile: skills its postings mention, how many do, and whether the resume has them.

    ``pairs``: profile_id, job_posting_id and, with ``max_postings``, pair_seq. A skill
    is matched as a plain substring unless ``whole_words``. Each text is scanned once.
    """
    find = text.matched_words if whole_words else text.matched
    wanted = pairs.select("profile_id", "job_posting_id").distinct()
    if max_postings is not None:
        firsts = pairs.groupBy("profile_id", "job_posting_id").agg(
            F.min("pair_seq").alias("pair_seq"))
        wanted = ranked(firsts, ["profile_id"], [F.col("pair_seq"), F.col("job_posting_id")],
                        max_postings, "_rank").select("profile_id", "job_posting_id")
    mentions = postings.select(
        F.col("id").alias("job_posting_id"), find("description_text", skills).alias("_found")
    ).select("job_posting_id", text.each("_found", len(skills)).alias("skill"))
    counts = wanted.join(mentions, "job_posting_id").groupBy("profile_id", "skill").agg(
        F.count("*").alias("jobs_mentioning"))
    owned = profiles.select(
        F.col("id").alias("profile_id"), find("resume_text", skills).alias("_owned"))
    return counts.join(owned, "profile_id").select(
        "profile_id", "skill", "jobs_mentioning",
        F.array_contains("_owned", F.col("skill")).alias("present_in_resume"))


def skill_gap_summary(gap: DataFrame, pairs: DataFrame, postings: DataFrame) -> DataFrame:
    """Per profile: postings analysed, skills missing and skills present."""
    known = postings.select(F.col("id").alias("job_posting_id"))
    looked_at = pairs.select("profile_id", "job_posting_id").distinct().join(
        known, "job_posting_id", "left_semi").groupBy("profile_id").agg(
        F.count("*").alias("jobs_analyzed"))
    found = gap.groupBy("profile_id").agg(
        F.count_if(~F.col("present_in_resume")).alias("missing_skills"),
        F.count_if("present_in_resume").alias("present_skills"))
    return looked_at.join(found, "profile_id", "left").select(
        "profile_id", "jobs_analyzed", F.coalesce("missing_skills", F.lit(0))
        .alias("missing_skills"), F.coalesce("present_skills", F.lit(0)).alias("present_skills"))


def skill_gap_order() -> list[Column]:
    return [F.col("present_in_resume"), F.desc("jobs_mentioning"), F.col("skill")]


def skill_gap_ranked(gap: DataFrame) -> DataFrame:
    """Every skill of a profile's gap with its rank: missing ones first, frequent ones first."""
    return gap.withColumn("rank", F.row_number().over(
        Window.partitionBy("profile_id").orderBy(*skill_gap_order())))


def missing_skills(required: DataFrame, owned: DataFrame) -> DataFrame:
    """(profile_id, skill_id) that postings of a profile ask for and it lacks."""
    return required.select("profile_id", "skill_id").distinct().join(
        owned, ["profile_id", "skill_id"], "left_anti")


def present_skills(required: DataFrame, owned: DataFrame) -> DataFrame:
    return required.select("profile_id", "skill_id").distinct().join(
        owned, ["profile_id", "skill_id"], "left_semi")


# ---- risk -----------------------------------------------------------------------

_WEB = r"^(?i:https?)://(?:[^/?#@]*@)?(?:\[[^\]/?#]+\]|[^/?#@:\[\]]+)"


def web_url(url: Column) -> Column:
    """Whether a text is an http(s) address that names a host."""
    return F.regexp_like(F.trim(F.coalesce(url, F.lit(""))), F.lit(_WEB))


def listing_risk(postings: DataFrame, tokens: dict[str, str] | None = None,
                 url_status: DataFrame | None = None) -> DataFrame:
    """Warnings, score and verdict of every posting.

    ``url_status`` (url, http_status, is_private) holds what a separate check found;
    a web address without a row there could not be verified. Without the table only
    the form of the address counts.
    """
    tokens = domains.RISK_TOKENS if tokens is None else tokens
    hay = F.lower(F.coalesce("description_text", F.lit("")))
    flags = [F.when(F.contains(hay, F.lit(t)), F.lit(label)) for label, t in tokens.items()]
    web = web_url(F.col("apply_url"))
    flags.append(F.when(~web, F.lit(domains.RISK_BAD_URL)))
    frame, status, live = postings, F.lit(None).cast("int"), F.lit(False)
    if url_status is not None:
        known = url_status.select(
            F.col("url").alias("apply_url"), F.col("http_status").alias("_status"),
            F.col("is_private").alias("_private")).dropDuplicates(["apply_url"])
        frame = postings.join(known, "apply_url", "left")
        private = F.coalesce("_private", F.lit(False))
        open_ = web & ~private
        status = F.when(open_, F.col("_status"))
        live = F.coalesce(status < 400, F.lit(False))
        flags += [
            F.when(web & private, F.lit(domains.RISK_PRIVATE_URL)),
            F.when(open_ & (status >= 400), F.concat(
                F.lit(domains.RISK_HTTP_PREFIX), status.cast("string"))),
            F.when(open_ & status.isNull(), F.lit(domains.RISK_UNVERIFIED_URL)),
        ]
    score = F.greatest(F.lit(0), 100 - 20 * F.size("flags"))
    return (
        frame.withColumn("flags", text.filled(*flags))
        .select(
            F.col("id").alias("job_posting_id"), "title", "company", "source",
            live.alias("url_live"), status.alias("http_status"),
            score.alias("risk_score"),
            F.when(score >= 80, F.lit("low_risk")).when(score >= 50, F.lit("review"))
            .otherwise(F.lit("high_risk")).alias("verdict"),
            "flags", F.lit(domains.RISK_NOTICE).alias("notice"))
    )


# ---- profile and posting side by side ---------------------------------------------


def match_context(pairs: DataFrame, profiles: DataFrame, postings: DataFrame,
                  resume_chars: int = 8000, posting_chars: int | None = None) -> DataFrame:
    """Profile and posting facts for each wanted (user_id, job_posting_id).

    ``profiles`` holds one profile per user. Texts are cut before they are joined, so that
    what a caller does not need is not copied for every pair.
    """
    p = profiles.select(
        "user_id", F.col("id").alias("profile_id"), "label", "target_roles",
        "remote_preference", F.col("salary_min").alias("profile_salary_min"),
        text.preview("resume_text", resume_chars).alias("resume_text"))
    j = postings.select(
        F.col("id").alias("job_posting_id"), "title", "company", "location", "remote",
        "salary_min", "salary_max", "description_text" if posting_chars is None
        else text.preview("description_text", posting_chars).alias("description_text"),
        F.length("description_text").alias("description_chars"), "apply_url")
    return pairs.select("user_id", "job_posting_id").distinct().join(p, "user_id").join(
        j, "job_posting_id")


PROMPT_CHARS = 6000  # of each text in a prompt


def prompts(context: DataFrame, format: str = "cover_letter",
            most: int = PROMPT_CHARS) -> DataFrame:
    """The text that a writing model would be given for each pair."""
    if format not in ("cover_letter", "resume_bullet"):
        raise ValueError("format must be cover_letter or resume_bullet.")
    part = lambda c: text.preview(F.coalesce(c, F.lit("")), most)
    return context.select(
        "user_id", "job_posting_id", F.lit(format).alias("format"),
        F.concat(
            F.lit(f"FORMAT: {format}\nJOB TITLE: "), F.coalesce("title", F.lit("")),
            F.lit("\nCOMPANY: "), F.coalesce("company", F.lit("None")),
            F.lit("\n\nJOB TEXT:\n"), part("description_text"),
            F.lit("\nRESUME:\n"), part("resume_text")).alias("prompt"))
