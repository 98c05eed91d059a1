"""Browsing postings: plain filters, and the postings that suit a profile."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import domains, session
from ..functions import text
from . import block_top, board
from .search import like_pattern
from .topn import first_per_key, ranked

# ---- predicates -----------------------------------------------------------------


def in_sources(sources: list[str] | None) -> Column:
    wanted = [s.lower() for s in sources or [] if s]
    return F.col("source").isin(wanted) if wanted else F.lit(True)


def is_remote() -> Column:
    return F.col("remote")


def remote_fits(preference) -> Column:
    """remote_only and onsite exclude postings that do not say; others take all."""
    pref = F.lit(preference) if isinstance(preference, str) else preference
    return (
        F.when(pref == "remote_only", F.col("remote"))
        .when(pref == "onsite", ~F.col("remote"))
        .otherwise(F.lit(True))
    )


def salary_at_least(minimum: float) -> Column:
    """Postings that name a high enough salary."""
    return F.col("salary_max").isNotNull() & (F.col("salary_max") >= minimum)


def salary_not_below(minimum: float | None) -> Column:
    """Postings that name no salary, or a high enough one."""
    if not minimum:
        return F.lit(True)
    return F.col("salary_max").isNull() | (F.col("salary_max") >= minimum)


def place_like(location: str) -> Column:
    """Any-case match; % and _ in the given text act as wildcards."""
    return F.col("location").ilike(f"%{location.strip()}%")


def title_matches(roles: list[str]) -> Column:
    wanted = [r.lower() for r in roles]
    if not wanted:
        return F.lit(True)
    title = F.lower("title")
    return F.exists(F.array(*[F.lit(f"%{r}%") for r in wanted]), lambda p: F.like(title, p))


def place_fits(locations: list[str]) -> Column:
    wanted = [x.lower() for x in locations if x.strip()]
    if not wanted:
        return F.lit(True)
    here = F.lower("location")
    return F.col("remote") | F.col("location").isNull() | F.exists(
        F.array(*[F.lit(f"%{x}%") for x in wanted]), lambda p: F.like(here, p))


def newest_first() -> list[Column]:
    return [F.col("posted_at").desc_nulls_last(), F.col("synced_at").desc(), F.col("id")]


SHOWN = ["id", "source", "title", "company", "location", "remote", "salary_min",
         "salary_max", "salary_currency", "employment_type", "category"]


def shown(postings: DataFrame, preview_chars: int = 300) -> DataFrame:
    return postings.select(
        *SHOWN, text.preview("description_text", preview_chars).alias("description_preview"),
        "apply_url", "posted_at", "synced_at")


def browse(postings: DataFrame, condition: Column, limit: int = 25) -> DataFrame:
    """The newest postings that meet a condition."""
    n = max(1, int(limit))
    return shown(postings.filter(condition).orderBy(*newest_first()).limit(n))


# ---- profiles against postings ----------------------------------------------------

_FOUND = "request_id STRING, id STRING, posted BIGINT, synced BIGINT"
_ORDER = ["request_id", "posted", "synced", "id"]
_ASCENDING = [True, False, False, True]


def default_profiles(profiles: DataFrame, required: bool = False) -> DataFrame:
    """One profile per user: the default one, else the oldest.

    When ``required``, users without a default profile have none, as in browsing.
    """
    chosen = profiles.filter("is_default") if required else profiles
    return first_per_key(chosen, ["user_id"], board.profile_order())


def _newest(found: pd.DataFrame, n: int) -> pd.DataFrame:
    found = found.sort_values(_ORDER, ascending=_ASCENDING, kind="stable")
    return found[found.groupby("request_id", sort=False).cumcount() < n]


def _hits(values: pd.Series, words: set[str]) -> dict[str, np.ndarray]:
    """Per LIKE word, which values contain it; NULL values never do."""
    known = values.fillna("").to_numpy(dtype=object)
    missing = values.isna().to_numpy()
    out = {}
    for word in words:
        if any(ch in word for ch in "%_\\"):
            fits = like_pattern(word).fullmatch
            hit = np.fromiter((bool(fits(v)) for v in known), bool, len(known))
        else:
            hit = np.fromiter((word in v for v in known), bool, len(known))
        out[word] = hit & ~missing
    return out


def _score(n: int):
    def score(cand: pd.DataFrame, req: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=["request_id", "id", "posted", "synced"])
        if not len(cand) or not len(req):
            return empty
        cand = cand.sort_values(["posted", "synced", "id"], ascending=[False, False, True])
        by_role = _hits(cand["title"], {r for x in req["roles"] for r in x})
        by_place = _hits(cand["location"], {p for x in req["places"] for p in x})
        says = cand["remote"].notna().to_numpy()
        remote = np.fromiter((v is True or v is np.True_ for v in cand["remote"]), bool, len(cand))
        nowhere = cand["location"].isna().to_numpy()
        salary = cand["salary_max"].astype("float64").fillna(np.inf).to_numpy()
        ids, posted, synced = (cand[c].to_numpy() for c in ("id", "posted", "synced"))
        out_request, out_rows = [], []
        shared = req.groupby(
            [req["roles"].map(tuple), req["preference"], req["places"].map(tuple)], sort=False)
        for (roles, preference, places), members in shared:
            ok = np.ones(len(cand), bool)
            if roles:
                ok &= np.logical_or.reduce([by_role[r] for r in roles])
            if preference == "remote_only":
                ok &= remote
            elif preference == "onsite":
                ok &= says & ~remote
            if places:
                ok &= remote | nowhere | np.logical_or.reduce([by_place[p] for p in places])
            rows = np.flatnonzero(ok)
            pay = salary[rows]
            for name, least in zip(members["request_id"], members["salary_min"]):
                fit = rows[:n] if not least or np.isnan(least) else rows[pay >= least][:n]
                out_request.append(np.full(len(fit), name, dtype=object))
                out_rows.append(fit)
        if not out_rows:
            return empty
        at = np.concatenate(out_rows)
        return pd.DataFrame({
            "request_id": np.concatenate(out_request), "id": ids[at],
            "posted": posted[at], "synced": synced[at]})

    return score


def _micros(ts) -> Column:
    """Sort key of a time; a missing one is older than all others."""
    far = F.lit(-(1 << 62))
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.coalesce(micros, far)


def _newest_found() -> list[Column]:
    return [F.desc("posted"), F.desc("synced"), F.col("id")]


# How much larger each slice of the postings is than the one before it.
GROWTH = 4


def _by_task(candidates: DataFrame, asked: block_top.Asked, n: int,
             candidate_rows: int) -> DataFrame:
    return block_top.best_per_request(
        candidates, asked, _score(n), lambda best: _newest(best, n), _FOUND, "id", candidate_rows)


def _slice_by_slice(candidates: DataFrame, asked: block_top.Asked, n: int,
                    candidate_rows: int) -> DataFrame:
    """What every request finds, for many of them: in the newest postings first, and only
    requests that are not full yet in the next, larger slice of older ones.

    All blocks at once would give ``n`` rows per request and block; here a request that
    older postings must still serve has found few, so the rows stay near the result's.
    """
    spark = candidates.sparkSession
    blocks = max(1, ceil(candidates.count() / candidate_rows))
    path = session.working_dir(spark, "newest-first")
    candidates.repartitionByRange(blocks, *_newest_found()).withColumn(
        "slice", F.spark_partition_id()).write.parquet(f"{path}/candidates")
    ordered = spark.read.parquet(f"{path}/candidates")
    found, first, size = [], 0, 1
    while True:
        part = ordered.filter(F.col("slice").between(first, first + size - 1)).drop("slice")
        at = f"{path}/found-{len(found)}"
        ranked(_by_task(part, asked, n, candidate_rows), ["request_id"], _newest_found(), n,
               "rank").drop("rank").write.parquet(at)
        found.append(at)
        first, size = first + size, size * GROWTH
        if first >= blocks:
            break
        full = spark.read.schema(_FOUND).parquet(*found).groupBy("request_id").agg(
            F.count("*").alias("rows")).filter(F.col("rows") >= n)
        left = f"{path}/asked-{len(found)}"
        asked.frame.join(full, "request_id", "left_anti").write.parquet(left)
        asked = block_top.measure(spark.read.parquet(left), asked.request_rows, asked.request_bytes)
        if not asked.rows:
            break
    return spark.read.schema(_FOUND).parquet(*found)


def relevant_postings(profiles: DataFrame, postings: DataFrame, limit: int = 25,
                      condition: Column | None = None,
                      candidate_rows: int = block_top.CANDIDATE_ROWS, **limits) -> DataFrame:
    """The newest postings that suit each profile: (profile_id, rank, posting …).

    Profiles with equal preferences are looked up once.
    """
    n = max(1, int(limit))
    lowered = lambda c: F.transform(
        F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x))
    preferences = profiles.select(
        F.col("id").alias("profile_id"),
        F.array_sort(F.array_distinct(lowered("target_roles"))).alias("roles"),
        F.when(F.col("remote_preference").isin("remote_only", "onsite"),
               F.col("remote_preference")).otherwise("any").alias("preference"),
        F.coalesce(F.col("salary_min").cast("double"), F.lit(0.0)).alias("salary_min"),
        F.array_sort(F.array_distinct(F.filter(
            lowered("locations_preferred"), lambda x: F.trim(x) != ""))).alias("places"),
    ).withColumn("request_id", F.sha2(F.to_json(F.struct(
        "roles", "preference", "salary_min", "places")), 256))
    requests = preferences.drop("profile_id").dropDuplicates(["request_id"])
    chosen = postings if condition is None else postings.filter(condition)
    candidates = chosen.select(
        "id", F.lower("title").alias("title"), F.lower("location").alias("location"),
        "remote", F.col("salary_max").cast("double").alias("salary_max"),
        _micros("posted_at").alias("posted"), _micros("synced_at").alias("synced"))
    asked = block_top.measure(requests, **limits)
    found = (_by_task(candidates, asked, n, candidate_rows) if asked.local is not None
             else _slice_by_slice(candidates, asked, n, candidate_rows))
    top = ranked(found, ["request_id"], _newest_found(), n, "rank")
    return (
        preferences.select("profile_id", "request_id").join(top, "request_id")
        .select("profile_id", "rank", "id").join(shown(chosen), "id")
    )
