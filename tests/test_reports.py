from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from jobspark import domains, schemas
from jobspark.functions import rules
from jobspark.operators import board, insight, people, quality, runlog

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    postings = spark.createDataFrame(
        [("j1", "T1", "C1"), ("j2", "T2", None)], "id string, title string, company string"
    ).withColumns({"location": F.lit("L"), "remote": F.lit(True), "apply_url": F.lit("u")})
    users = spark.createDataFrame([("u1", "a@x"), ("u2", "b@x")], "id string, email string")
    apps = spark.createDataFrame(
        [("a1", "u1", "j1", "applied", datetime(2024, 1, 1)),
         ("a2", "u1", "j2", "offer", datetime(2024, 1, 3)),
         ("a3", "u2", "j1", "saved", datetime(2024, 1, 2)),
         ("a4", "u2", "gone", "saved", datetime(2024, 1, 9))],
        "id string, user_id string, job_posting_id string, stage string, "
        "stage_updated_at timestamp")
    notes = spark.createDataFrame(
        [("a1", "u1", date(2024, 1, 5)), ("a1", "u1", date(2024, 1, 4)),
         ("a1", "u1", date(2024, 1, 1)), ("a3", "u1", None)],
        "application_id string, user_id string, follow_up_date date")
    return postings, users, apps, notes


def test_board(spark, tables):
    postings, _, apps, notes = tables
    got = board.board(apps, postings, notes, F.lit(date(2024, 1, 4)))
    assert rows(got.select("id", "note_count", "next_follow_up", "stage_rank")) == [
        ("a1", 3, date(2024, 1, 4), 2), ("a2", 0, None, 5), ("a3", 1, None, 1)]
    saved = spark.createDataFrame([("u1",), ("u3",)], "user_id string")
    assert rows(board.board_counts(apps, saved)) == [
        ("u1", 0, 1, 0, 0, 1, 2, 1), ("u2", 2, 0, 0, 0, 0, 2, 0), ("u3", 0, 0, 0, 0, 0, 0, 1)]


def test_recent_activity_skips_rows_without_posting(spark, tables):
    postings, users, apps, notes = tables
    got = board.recent_activity(apps, users, postings, notes, 2)
    assert rows(got.select("id", "email", "interview_notes")) == [
        ("a2", "a@x", 0), ("a3", "b@x", 1)]


def test_stale_report(spark, tables):
    postings, users, apps, _ = tables
    as_of = F.lit(datetime(2024, 1, 20, 5))
    got = board.stale_report(apps, users, postings, as_of)
    assert rows(got.select("id", "days_without_update")) == [("a1", 19)]
    assert board.stale_report(apps, users, postings, as_of, 365).count() == 0


def test_notes_need_an_own_application(spark, tables):
    _, _, apps, notes = tables
    accepted, refused = board.own_notes(notes, apps)
    assert accepted.count() == 3 and rows(refused.select("application_id")) == [("a3",)]


def test_funnel_order(spark, tables):
    got = board.stage_funnel(tables[2])
    assert [tuple(r) for r in got.orderBy("stage_rank").collect()] == [
        ("saved", 2, 1), ("applied", 1, 2), ("offer", 1, 5)]


def test_skill_gap(spark):
    postings = spark.createDataFrame(
        [("j1", "Python and JavaScript"), ("j2", "python, SQL"), ("j3", None), ("j4", "sql")],
        "id string, description_text string")
    profiles = spark.createDataFrame(
        [("p1", "I know SQL"), ("p2", None)], "id string, resume_text string")
    pairs = spark.createDataFrame(
        [("p1", "j1", 1), ("p1", "j2", 2), ("p1", "j2", 3), ("p1", "j4", 4), ("p2", "j1", 1),
         ("p2", "j3", 2)], "profile_id string, job_posting_id string, pair_seq int")
    got = insight.skill_gap(pairs, profiles, postings)
    ordered = got.filter("profile_id = 'p1'").orderBy(*insight.skill_gap_order())
    assert [tuple(r)[1:] for r in ordered.collect()] == [
        ("python", 2, False), ("java", 1, False), ("javascript", 1, False), ("sql", 2, True)]
    words = insight.skill_gap(pairs, profiles, postings, whole_words=True)
    assert words.filter("skill = 'java'").count() == 0
    two = insight.skill_gap(pairs, profiles, postings, max_postings=2)
    assert rows(two.filter("profile_id = 'p1' AND skill = 'sql'"))[0][2] == 1


def test_risk(spark):
    data = [("1", "Pay by CRYPTO PAYMENT now", "https://x.y/z"), ("2", "fine", None),
            ("3", "gift card, wire transfer, telegram, whatsapp, payment, equipment check", "ftp://x"),
            ("4", "fine", "https:///p"), ("5", "fine", "HTTP://user@host:80/"),
            ("6", None, "http://[::1]/x")]
    df = spark.createDataFrame(data, "id string, description_text string, apply_url string"
                               ).withColumns({"title": F.lit("t"), "company": F.lit("c"),
                                              "source": F.lit("s")})
    got = {r["job_posting_id"]: (r["risk_score"], r["verdict"], r["flags"])
           for r in insight.listing_risk(df).collect()}
    assert got["1"] == (60, "review", ["upfront payment", "crypto payment"])
    assert got["2"] == (80, "low_risk", [domains.RISK_BAD_URL])
    assert got["3"][0] == 0 and got["3"][1] == "high_risk" and len(got["3"][2]) == 7
    assert got["4"][2] == [domains.RISK_BAD_URL]
    assert got["5"] == (100, "low_risk", []) and got["6"][2] == []
    checks = spark.createDataFrame(
        [("https://x.y/z", 404, False), ("HTTP://user@host:80/", 200, False),
         ("http://[::1]/x", None, True)], "url string, http_status int, is_private boolean")
    seen = {r["job_posting_id"]: r for r in insight.listing_risk(df, None, checks).collect()}
    assert seen["1"]["flags"][-1] == "application URL returned HTTP 404"
    assert seen["5"]["url_live"] is True and seen["5"]["http_status"] == 200
    assert seen["6"]["flags"] == [domains.RISK_PRIVATE_URL]
    assert seen["6"]["http_status"] is None
    assert insight.listing_risk(df, None, checks.limit(0)).filter(
        "job_posting_id = '5'").first()["flags"] == [domains.RISK_UNVERIFIED_URL]


def test_prompt(spark):
    context = spark.createDataFrame(
        [("u", "j", "T", None, "d" * 7000, "r" * 7000)],
        "user_id string, job_posting_id string, title string, company string, "
        "description_text string, resume_text string")
    got = insight.prompts(context).first()["prompt"]
    assert got == ("FORMAT: cover_letter\nJOB TITLE: T\nCOMPANY: None\n\nJOB TEXT:\n"
                   + "d" * 6000 + "\nRESUME:\n" + "r" * 6000)
    with pytest.raises(ValueError):
        insight.prompts(context, "poem")


def test_quality(spark, tables):
    postings, users, apps, notes = tables
    named = {"job_postings": postings, "users": users, "applications": apps}
    got = quality.orphan_counts(named, schemas.REFERENCES)
    assert rows(got) == [("applications", "job_posting_id", "job_postings", 1),
                         ("applications", "user_id", "users", 0)]
    assert rows(quality.duplicate_keys(apps, ["user_id"])) == [("u1", 2), ("u2", 2)]
    bad = quality.domain_violations(apps, {"stage": ("saved", "applied")})
    assert rows(bad) == [("stage", "offer", 1)]
    assert rows(quality.missing_values(postings, ["id", "company"])) == [("company", 1), ("id", 0)]
    assert rows(quality.inventory(named)) == [
        ("applications", 4), ("job_postings", 2), ("users", 2)]
    diff = quality.schema_differences(users.withColumn("extra", F.lit(1)), schemas.schema("users"))
    assert rows(diff) == [("created_at", "timestamp", None), ("display_name", "string", None),
                          ("extra", None, "int")]
    vectors = spark.createDataFrame([([1.0],), ([1.0, 2.0],), (None,)], "v array<float>")
    assert quality.bad_vectors(vectors, "v", 2).count() == 2


def test_every_table_has_a_schema(spark):
    assert set(schemas.KEYS) == set(schemas.TABLES)
    for name, keys in schemas.KEYS.items():
        fields = schemas.schema(name).fieldNames()
        assert all(c in fields for key in keys for c in key)


def test_people(spark):
    profiles = spark.createDataFrame(
        [(" ", ["  a ", ""], None, "", 0.0), ("x", None, [" "], "sometimes", -1.0)],
        "label string, target_roles array<string>, locations_preferred array<string>, "
        "remote_preference string, salary_min double").withColumn("seniority", F.lit(None).cast(
            "string"))
    got = rules.check(people.tidy_profiles(profiles), people.profile_rules())
    assert [r["errors"] for r in got.orderBy("label").collect()] == [
        ["label is required."],
        ["remote_preference must be one of: remote_only, hybrid, onsite, any",
         "salary_min cannot be negative."]]
    assert got.filter("label = ' '").first()["salary_min"] is None
    assert got.filter("label = ' '").first()["remote_preference"] == "any"
    users = spark.createDataFrame([("1", "A@x.y")], "id string, email string")
    asked = spark.createDataFrame([(" a@X.y ",), ("missing@example.com",)], "user_email string")
    known, unknown = people.lookup_users(asked, users)
    assert rows(known.select("user_id")) == [("1",)]
    assert rows(unknown) == [("missing@example.com",)]
    stages = spark.createDataFrame([("applied",), ("waiting",), (None,)], "stage string")
    assert rules.rejected(rules.check(stages, people.stage_rules())).count() == 2
    marks = spark.createDataFrame([("j", "maybe", None), ("j", " GOOD", "r")],
                                  "job_posting_id string, feedback string, reason string")
    assert rules.valid(rules.check(marks, people.feedback_rules())).count() == 1


def test_run_log(spark):
    log = runlog.record(spark, "r1", "running", T0, counters={"query_count": 2})
    log = log.unionAll(runlog.record(spark, "r1", "failed", T0, finished_at=T0, error="e" * 20000))
    log = log.unionAll(runlog.record(spark, "r2", "completed", datetime(2024, 1, 2),
                                     finished_at=datetime(2024, 1, 2), metrics={"a": 1}))
    now = runlog.current(log)
    assert rows(now.select("id", "status")) == [("r1", "failed"), ("r2", "completed")]
    assert now.filter("id = 'r1'").select(F.length("error_message")).first()[0] == 10000
    assert runlog.latest(now).first()["id"] == "r2"
    assert [r["id"] for r in runlog.history(now, 1).collect()] == ["r2"]
    assert runlog.iso_times(now).filter("id = 'r2'").first()["started_at"].startswith("2024-01-02T")
    with pytest.raises(ValueError):
        runlog.record(spark, "x", "paused", T0)
