"""Search as a user asks for it: by e-mail, with the profile's defaults and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text
from . import browse, people, search
from .embedding import Embedder

UNKNOWN, NO_PROFILE, NO_TEXT = "unknown user", "no profile", "no search text"


def resolved(requests: DataFrame, users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Requests with user_id, profile_id, the filled-in fields, and why one is refused.

    ``requests``: request_id (unique), user_email, query, remote_only, minimum_salary,
    location. A user counts by e-mail in any case, a profile as the user's default one.
    ``error`` is NULL where a search can be made.
    """
    known, unknown = people.lookup_users(requests, users)
    own = browse.default_profiles(profiles).select(
        "user_id", F.col("id").alias("profile_id"), "target_roles", "remote_preference",
        "salary_min", "locations_preferred")
    found = known.join(own, "user_id", "left")
    filled = search.with_defaults(found).join(
        found.select("request_id", "user_id", "profile_id", F.coalesce(
            text.clean_space("query"), F.lit("")).alias("_asked")), "request_id")
    error = F.when(F.col("profile_id").isNull(), NO_PROFILE).when(
        F.col("_asked") == "", NO_TEXT)
    return filled.withColumn("error", error).drop("_asked").unionByName(
        unknown.select("request_id", F.lit(UNKNOWN).alias("error")), allowMissingColumns=True)


def profile_search(requests: DataFrame, users: DataFrame, profiles: DataFrame,
                   chunks: DataFrame, postings: DataFrame, feedback: DataFrame,
                   embedder: Embedder, model: str, **options) -> DataFrame:
    """The postings nearest to each request's text and roles, re-ranked by the user's
    feedback. Refused requests (see :func:`resolved`) have no rows.

    ``feedback`` holds one signal per (user, posting); ``options`` are those of
    :func:`search.search`. Similarities stay between 0 and 1.
    """
    asked = resolved(requests, users, profiles).filter("error IS NULL")
    found = search.search(search.embedded(asked, embedder, model), chunks, postings, **options)
    owners = asked.select("request_id", "user_id", "profile_id")
    return search.rerank(found.join(owners, "request_id"), feedback, low=0.0)
