import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from jobspark import domains
from jobspark.operators import folds, merge

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def log(seed, n=400):
    """Actions of few users; one (user, posting) holds a third of them."""
    rnd = random.Random(seed)
    out = []
    for seq in range(n):
        hot = rnd.random() < 0.34
        out.append((("u0", "j0") if hot else (f"u{rnd.randrange(4)}", f"j{rnd.randrange(4)}"))
                   + (at(rnd.randrange(0, 3000)), seq))
    return rnd, out


def replay(actions):
    return sorted(actions, key=lambda a: (a["ts"], a["seq"]))


def frame(spark, actions, ddl):
    names = [c.split()[0] for c in ddl.split(", ")]
    data = [tuple(a[c] for c in names) for a in actions]
    random.Random(0).shuffle(data)
    return spark.createDataFrame(data, ddl).repartition(5)


@pytest.mark.parametrize("seed,slice_", [(1, "hour"), (2, "minute"), (1, "year")])
def test_bookmarks(spark, seed, slice_):
    rnd, base = log(seed)
    actions = [dict(user_id=u, job_posting_id=j, ts=t, seq=s,
                    action=rnd.choice(["save", "save", "delete"]),
                    note=rnd.choice([None, "", "\t ", f"n{s}"])) for u, j, t, s in base]
    state = {}
    for a in replay(actions):
        key = (a["user_id"], a["job_posting_id"])
        if a["action"] == "delete":
            state.pop(key, None)
        elif key in state:
            state[key] = ((a["note"] or "").strip() or state[key][0], state[key][1])
        else:
            state[key] = ((a["note"] or "").strip() or None, a["ts"])
    got = folds.bookmarks(frame(spark, actions,
        "user_id string, job_posting_id string, action string, note string, ts timestamp, "
        "seq int"), slice_)
    assert {(r["user_id"], r["job_posting_id"]): (r["note"], r["saved_at"])
            for r in got.collect()} == state


@pytest.mark.parametrize("seed", [3, 4])
def test_applications(spark, seed):
    rnd, base = log(seed)
    actions = [dict(user_id=u, job_posting_id=j, ts=t, seq=s,
                    stage=rnd.choice([None, *domains.STAGES]),
                    profile_id=rnd.choice([None, "", f"p{s}"])) for u, j, t, s in base]
    state = {}
    for a in replay(actions):
        key = (a["user_id"], a["job_posting_id"])
        row = state.get(key)
        if row is None:
            row = state[key] = dict(stage=a["stage"] or "saved", profile=a["profile_id"] or None,
                                    updated=a["ts"], applied=None, created=a["ts"])
        elif a["stage"] is None:
            row["profile"] = a["profile_id"] or row["profile"]
        if a["stage"]:
            row["stage"], row["updated"] = a["stage"], a["ts"]
            if a["stage"] == "applied" and row["applied"] is None:
                row["applied"] = a["ts"]
    got = folds.applications(frame(spark, actions,
        "user_id string, job_posting_id string, stage string, profile_id string, ts timestamp, "
        "seq int"))
    assert {(r["user_id"], r["job_posting_id"]): dict(
        stage=r["stage"], profile=r["profile_id"], updated=r["stage_updated_at"],
        applied=r["applied_at"], created=r["created_at"]) for r in got.collect()} == state


def test_applied_time_is_set_once(spark):
    data = [("u", "j", s, None, at(i), i) for i, s in enumerate(
        ["applied", "rejected", "applied"])]
    got = folds.applications(spark.createDataFrame(
        data, "user_id string, job_posting_id string, stage string, profile_id string, "
              "ts timestamp, seq int")).first()
    assert got["applied_at"] == at(0) and got["stage_updated_at"] == at(2)


@pytest.mark.parametrize("seed", [5])
def test_feedback(spark, seed):
    rnd, base = log(seed)
    actions = [dict(user_id=u, job_posting_id=j, ts=t, seq=s, reason=rnd.choice([None, f"r{s}"]),
                    feedback=rnd.choice(domains.FEEDBACK)) for u, j, t, s in base]
    state = {}
    for a in replay(actions):
        key = (a["user_id"], a["job_posting_id"])
        created = state[key][2] if key in state else a["ts"]
        state[key] = (a["feedback"], a["reason"], created, a["ts"])
    got = folds.feedback(frame(spark, actions,
        "user_id string, job_posting_id string, feedback string, reason string, ts timestamp, "
        "seq int"))
    assert {(r["user_id"], r["job_posting_id"]): (
        r["feedback"], r["reason"], r["created_at"], r["updated_at"])
        for r in got.collect()} == state


@pytest.mark.parametrize("slice_", ["minute", "hour", "month"])
def test_transitions(spark, slice_):
    rnd, base = log(6)
    actions = [dict(user_id=u, job_posting_id=j, ts=t, seq=s,
                    stage=rnd.choice([None, *domains.STAGES])) for u, j, t, s in base]
    last, want = {}, []
    for a in replay(actions):
        if a["stage"] is None:
            continue
        key = (a["user_id"], a["job_posting_id"])
        before = last.get(key)
        want.append((a["seq"], before, a["stage"], None if before is None else (
            (before, a["stage"]) in domains.STAGE_MOVES)))
        last[key] = a["stage"]
    got = folds.stage_transitions(frame(spark, actions,
        "user_id string, job_posting_id string, stage string, ts timestamp, seq int"), slice_)
    assert sorted((r["seq"], r["previous_stage"], r["stage"], r["allowed"])
                  for r in got.collect()) == sorted(want)


def test_users(spark):
    state = spark.createDataFrame(
        [("1", "a@x.y", "Ann", T0), ("2", "b@x.y", None, T0)],
        "id string, email string, display_name string, created_at timestamp")
    logins = spark.createDataFrame(
        [(" A@x.y", None, at(1), 1), ("B@X.Y", "Bo", at(2), 2), ("b@x.y", "", at(3), 3),
         ("c@x.y", "C1", at(5), 4), ("C@x.y ", "C0", at(4), 5)],
        "email string, display_name string, ts timestamp, seq int")
    got = {r["email"]: r for r in folds.users(logins, state).collect()}
    assert (got["a@x.y"]["id"], got["a@x.y"]["display_name"]) == ("1", "Ann")
    assert got["b@x.y"]["display_name"] == "Bo" and got["b@x.y"]["created_at"] == T0
    assert got["c@x.y"]["display_name"] == "C1" and got["c@x.y"]["created_at"] == at(4)
    assert folds.users(logins).count() == 3


def test_stale_flags(spark):
    as_of = datetime(2024, 2, 1)
    limit = as_of - timedelta(days=14)
    data = [("exact", "applied", limit, False, None),
            ("older", "applied", limit - timedelta(microseconds=1), False, None),
            ("flagged", "applied", T0, True, at(7)), ("moved", "offer", T0, True, at(7)),
            ("recent", "applied", as_of, True, at(7)), ("null", None, T0, False, None)]
    apps = spark.createDataFrame(
        data, "id string, stage string, stage_updated_at timestamp, is_stale boolean, "
              "stale_flagged_at timestamp")
    once = folds.refresh_stale(apps, F.lit(as_of))
    got = {r["id"]: (r["is_stale"], r["stale_flagged_at"]) for r in once.collect()}
    assert got == {"exact": (False, None), "older": (True, as_of), "flagged": (True, at(7)),
                   "moved": (False, None), "recent": (False, None), "null": (False, None)}
    later = folds.refresh_stale(once, F.lit(as_of + timedelta(hours=1)))
    assert {r["id"]: r["stale_flagged_at"] for r in later.collect()}["older"] == as_of
    assert folds.refresh_stale(apps, F.lit(as_of), 0).filter("is_stale").count() == 3


def test_single_default(spark):
    df = spark.createDataFrame(
        [("p1", "u1", True, T0, 1), ("p2", "u1", True, T0, 2), ("p3", "u1", False, at(9), 3),
         ("p4", "u2", False, T0, 4)],
        "id string, user_id string, is_default boolean, ts timestamp, seq int")
    assert rows(folds.single_default(df).select("id", "is_default")) == [
        ("p1", False), ("p2", True), ("p3", False), ("p4", False)]


def test_upsert_replaces_whole_rows_and_is_idempotent(spark):
    state = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string")
    new = spark.createDataFrame([("b", 3, None), ("c", 4, "z")], "id string, n int, s string")
    once = merge.upsert(state, new, ["id"])
    assert rows(once) == [("a", 1, "x"), ("b", 3, None), ("c", 4, "z")]
    assert rows(merge.upsert(once, new, ["id"])) == rows(once)
    batch = spark.createDataFrame([("b", 1, "p"), ("b", 2, "q")], "id string, n int, s string")
    assert rows(merge.latest(batch, ["id"], [F.desc("n")])) == [("b", 2, "q")]


def test_replace_groups_and_delete(spark):
    state = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("c", 0)], "k string, i int")
    new = spark.createDataFrame([("a", 5)], "k string, i int")
    owners = spark.createDataFrame([("a",), ("c",)], "k string")
    assert rows(merge.replace_groups(state, new, ["k"])) == [("a", 5), ("b", 0), ("c", 0)]
    assert rows(merge.replace_groups(state, new, ["k"], owners)) == [("a", 5), ("b", 0)]
    assert rows(merge.delete(state, owners, ["k"])) == [("b", 0)]
