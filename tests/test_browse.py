import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from jobspark.operators import browse, search

TITLES = ["Data Engineer", "ML engineer", "100% remote clerk", "Cook", "data_analyst"]
PLACES = ["Berlin", "Austin, TX", None, "remote", "München"]


def postings(spark, n=300, seed=4):
    rnd = random.Random(seed)
    data = [(f"s:{i:03d}", "s", rnd.choice(TITLES), rnd.choice(PLACES),
             rnd.choice([True, False, None]), rnd.choice([None, float(rnd.randrange(100))]),
             rnd.choice([None, rnd.randrange(40)]), rnd.randrange(5)) for i in range(n)]
    df = spark.createDataFrame(
        data, "id string, source string, title string, location string, remote boolean, "
              "salary_max double, p int, s int")
    day = lambda c: F.timestamp_seconds(F.col(c) * 86400)
    return data, df.select(
        "id", "source", "title", F.lit("c").alias("company"), "location", "remote",
        F.lit(None).cast("double").alias("salary_min"), "salary_max",
        F.lit("USD").alias("salary_currency"), F.lit(None).cast("string").alias("employment_type"),
        F.lit(None).cast("string").alias("category"), F.lit("d" * 400).alias("description_text"),
        F.lit("u").alias("apply_url"), day("p").alias("posted_at"), day("s").alias("synced_at"))


PROFILES = [
    ("p1", [], "any", 0.0, []), ("p2", ["ENGINEER"], "remote_only", 50.0, ["berlin", " "]),
    ("p3", ["cook", "clerk"], "onsite", None, ["A_stin"]), ("p4", ["data_"], "hybrid", 30.0, [" "]),
    ("p5", ["%remote"], None, -1.0, None), ("p6", ["nothing like it"], "any", None, []),
    ("p7", ["engineer"], "remote_only", 50.0, ["Berlin"]), ("p8", None, "onsite", 99.0, ["x"]),
]


def profile_frame(spark):
    return spark.createDataFrame(
        PROFILES, "id string, target_roles array<string>, remote_preference string, "
                  "salary_min double, locations_preferred array<string>")


def wanted(data, profile, n):
    _, roles, preference, least, places = profile

    def like(value, word):
        return value is not None and bool(
            search.like_pattern(word.lower()).fullmatch(value.lower()))

    hits = []
    for pid, _, title, place, remote, pay, posted, synced in data:
        if roles and not any(like(title, r) for r in roles):
            continue
        if preference == "remote_only" and remote is not True:
            continue
        if preference == "onsite" and remote is not False:
            continue
        if least and pay is not None and pay < least:
            continue
        real = [x for x in places or [] if x.strip()]
        if real and not (remote is True or place is None or any(like(place, x) for x in real)):
            continue
        hits.append((posted is None, -(posted or 0), -synced, pid))
    return [h[3] for h in sorted(hits)[:n]]


@pytest.mark.parametrize("limits", [{}, {"request_rows": 2, "candidate_rows": 40}])
def test_relevant_postings_equal_brute_force(spark, limits):
    data, df = postings(spark)
    got = browse.relevant_postings(profile_frame(spark), df.repartition(5), 7, **limits)
    found = {}
    for r in got.orderBy("profile_id", "rank").collect():
        found.setdefault(r["profile_id"], []).append(r["id"])
    want = {p[0]: wanted(data, p, 7) for p in PROFILES}
    assert found == {k: v for k, v in want.items() if v}
    assert len(got.first()["description_preview"]) == 300


def test_full_requests_are_not_asked_again(spark, monkeypatch):
    """With many requests older postings are only looked through for those not yet full."""
    _, df = postings(spark)
    made, whole = [], browse._by_task

    def watched(candidates, asked, n, candidate_rows):
        found = whole(candidates, asked, n, candidate_rows)
        made.append((asked.rows, candidates.count()))
        return found

    monkeypatch.setattr(browse, "_by_task", watched)
    browse.relevant_postings(profile_frame(spark), df, 1, request_rows=2, candidate_rows=20).count()
    assert len(made) > 1 and made[0][0] > made[-1][0]
    assert sum(rows for _, rows in made) <= df.count()


def test_extra_condition_and_no_profiles(spark):
    _, df = postings(spark)
    got = browse.relevant_postings(profile_frame(spark), df, 200, browse.is_remote())
    assert got.filter("remote IS NULL OR NOT remote").count() == 0
    assert browse.relevant_postings(profile_frame(spark).limit(0), df).count() == 0


def test_predicates(spark):
    df = spark.createDataFrame(
        [("a", True, 10.0, "X"), ("b", False, None, None), ("c", None, 5.0, "berlin")],
        "id string, remote boolean, salary_max double, location string").withColumns({
            "source": F.lit("s"), "title": F.col("id")})
    ids = lambda cond: [r[0] for r in rows(df.filter(cond).select("id"))]
    assert ids(browse.is_remote()) == ["a"]
    assert ids(browse.remote_fits("onsite")) == ["b"]
    assert ids(browse.remote_fits("hybrid")) == ["a", "b", "c"]
    assert ids(browse.salary_at_least(6.0)) == ["a"]
    assert ids(browse.salary_not_below(6.0)) == ["a", "b"]
    assert ids(browse.salary_not_below(0)) == ["a", "b", "c"]
    assert ids(browse.in_sources([])) == ["a", "b", "c"]
    assert ids(browse.in_sources(["S"])) == ["a", "b", "c"]
    assert ids(browse.in_sources(["t"])) == []
    assert ids(browse.place_like(" BER_IN ")) == ["c"]
    assert ids(browse.place_fits(["munich"])) == ["a", "b"]
    assert ids(browse.place_fits([" "])) == ["a", "b", "c"]
    assert ids(browse.title_matches(["A", "b"])) == ["a", "b"]


def test_newest_first_with_missing_dates_last(spark):
    data, df = postings(spark)
    got = [r["id"] for r in browse.browse(df, F.lit(True), 1000).collect()]
    order = sorted(data, key=lambda x: (x[6] is None, -(x[6] or 0), -x[7], x[0]))
    assert got == [x[0] for x in order]
    assert [r["id"] for r in browse.browse(df, F.lit(True), 200).collect()] == got[:200]


def test_default_profile(spark):
    df = spark.createDataFrame(
        [("p1", "u1", False, 1), ("p2", "u1", True, 3), ("p3", "u1", True, 2), ("p4", "u2", False, 9),
         ("p5", "u2", False, 9)], "id string, user_id string, is_default boolean, created_at int")
    assert rows(browse.default_profiles(df).select("user_id", "id")) == [
        ("u1", "p3"), ("u2", "p4")]
    assert rows(browse.default_profiles(df, required=True).select("id")) == [("p3",)]
