"""Checks and clean-up of user input: profiles, notes, contacts, feedback, uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import domains
from ..functions import rules, text


def user_rules() -> list[Column]:
    return [rules.required("email"), rules.at_most("email", 320), rules.email("email"),
            rules.at_most("display_name", 200)]


def profile_rules() -> list[Column]:
    return [rules.required("label"), rules.at_most("label", 100),
            rules.at_most("seniority", 100),
            rules.one_of("remote_preference", domains.REMOTE_PREFERENCES, optional=True),
            rules.not_negative("salary_min")]


def tidy_profiles(profiles: DataFrame) -> DataFrame:
    """Trimmed lists of at most 20 entries; no preference means any; salary 0 is none."""
    return profiles.withColumns({
        "target_roles": text.clean_list("target_roles"),
        "locations_preferred": text.clean_list("locations_preferred"),
        "remote_preference": F.coalesce(
            text.none_if_empty("remote_preference"), F.lit("any")),
        "salary_min": F.nullif(F.col("salary_min"), F.lit(0).cast(
            profiles.schema["salary_min"].dataType)),
    })


def note_rules() -> list[Column]:
    return [rules.required("note"), rules.at_most("note", 10_000),
            rules.one_of("interview_type", domains.INTERVIEW_TYPES, optional=True),
            rules.iso_day("follow_up_date")]


CONTACT_LIMITS = {"name": 200, "role": 200, "company": 300, "email": 320, "phone": 100,
                  "linkedin_url": 2000, "notes": 5000}


def contact_rules() -> list[Column]:
    return [rules.required("name")] + [rules.at_most(c, n) for c, n in CONTACT_LIMITS.items()]


def tidy_contacts(contacts: DataFrame) -> DataFrame:
    return contacts.withColumns({c: rules.tidy(c) for c in CONTACT_LIMITS})


def feedback_rules() -> list[Column]:
    return [rules.required("job_posting_id"), rules.at_most("job_posting_id", 500),
            F.when(~F.coalesce(F.lower(text.strip("feedback")).isin(*domains.FEEDBACK), F.lit(False)),
                   F.lit("feedback must be good, bad, or skip.")),
            rules.at_most("reason", 2000)]


def tidy_feedback(actions: DataFrame) -> DataFrame:
    return actions.withColumns({
        "feedback": F.lower(text.strip("feedback")), "reason": rules.tidy("reason")})


def search_rules() -> list[Column]:
    return [rules.required("query"), rules.at_most("query", 2000)]


def stage_rules() -> list[Column]:
    return [rules.one_of("stage", domains.STAGES)]


def bookmark_rules() -> list[Column]:
    return [rules.required("job_posting_id"), rules.at_most("job_posting_id", 500),
            rules.at_most("note", 5000)]


def resume_rules() -> list[Column]:
    return [rules.required("filename"), rules.at_most("filename", 255),
            rules.required("resume_text"), rules.at_most("resume_text", 250_000)]


def lookup_users(requests: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with user_id, requests of unknown users) by email in any case."""
    asked = requests.withColumn("_mail", F.lower(text.clean_space("user_email")))
    known = users.select(F.lower("email").alias("_mail"), F.col("id").alias("user_id"))
    return (asked.join(known, "_mail").drop("_mail"),
            asked.join(known, "_mail", "left_anti").drop("_mail"))
