import os
import random
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from jobspark.operators import folds, states
from jobspark.streaming import states as streams

T0 = datetime(2024, 1, 1)
KINDS = {
    "applications": (states.APPLICATIONS, folds.applications,
                     "user_id STRING, job_posting_id STRING, stage STRING, profile_id STRING, "
                     "ts TIMESTAMP, seq BIGINT",
                     lambda r: ("u", f"j{r.randrange(3)}",
                                r.choice([None, "applied", "interviewing", "offer"]),
                                r.choice([None, "", "p1", "p2"]))),
    "bookmarks": (states.BOOKMARKS, folds.bookmarks,
                  "user_id STRING, job_posting_id STRING, action STRING, note STRING, "
                  "ts TIMESTAMP, seq BIGINT",
                  lambda r: ("u", f"j{r.randrange(9)}", r.choice(["save", "save", "delete"]),
                             r.choice([None, " ", "n1", " n2 "]))),
    "feedback": (states.FEEDBACK, folds.feedback,
                 "user_id STRING, job_posting_id STRING, feedback STRING, reason STRING, "
                 "ts TIMESTAMP, seq BIGINT",
                 lambda r: ("u", f"j{r.randrange(3)}", r.choice(["good", "bad"]),
                            r.choice([None, "why"]))),
    "users": (states.USERS, folds.users, "email STRING, display_name STRING, ts TIMESTAMP, seq BIGINT",
              lambda r: (r.choice(["A@x.org", " a@X.org", "b@x.org"]),
                         r.choice([None, " ", "Ann", " Bo "]))),
}


def log(make, n, seed):
    r = random.Random(seed)
    # Many actions share a time; their order is that of seq.
    return [(*make(r), T0 + timedelta(minutes=r.randrange(n // 3)), i) for i in range(n)]


@pytest.mark.parametrize("name", sorted(KINDS))
def test_parts_in_any_order_and_twice_equal_the_fold(spark, name):
    fold, whole, ddl, make = KINDS[name]
    for seed in range(3):
        actions = log(make, 90, seed)
        frame = spark.createDataFrame(actions, ddl)
        random.Random(seed).shuffle(actions)
        parts = [spark.createDataFrame(actions[a:b], ddl)
                 for a, b in ((60, 90), (0, 35), (20, 60), (20, 60))]
        made = fold.part(parts[0])
        for p in parts[1:]:
            made = fold.merge(made.unionByName(fold.part(p)))
        want = whole(frame)
        assert rows(fold.finish(made).select(*want.columns)) == rows(want)
    assert fold.finish(fold.merge(fold.part(frame.limit(0)))).count() == 0


def test_late_deletion_between_saves(spark):
    fold, _, ddl, _ = KINDS["bookmarks"]
    at = lambda m: T0 + timedelta(minutes=m)
    early = fold.part(spark.createDataFrame(
        [("u", "j", "save", "old", at(1), 1), ("u", "j", "save", None, at(5), 3)], ddl))
    late = fold.part(spark.createDataFrame([("u", "j", "delete", None, at(3), 2)], ddl))
    got = fold.finish(fold.merge(early.unionByName(late)))
    assert rows(got.select("note", "saved_at")) == [(None, at(5))]


def test_one_key_with_very_many_actions(spark):
    n = 200_000
    df = spark.range(n).select(
        F.lit("u").alias("user_id"), F.lit("j").alias("job_posting_id"),
        F.when(F.col("id") == 1000, "delete").otherwise("save").alias("action"),
        F.when(F.col("id") == n - 5, "note").alias("note"),
        F.lit(T0).alias("ts"), F.col("id").alias("seq"))
    made = states.BOOKMARKS.merge(states.BOOKMARKS.part(df))
    assert made.count() == n - 1000
    assert rows(states.BOOKMARKS.finish(made).select("note", "saved_at")) == [("note", T0)]


def test_stream_writes_its_batch_alone_and_compacts(spark, tmp_path):
    fold, whole, ddl, make = KINDS["applications"]
    landing, path, mark = (str(tmp_path / x) for x in ("landing", "state", "mark"))
    actions = log(make, 90, 5)
    assert streams.merged(spark, path, fold, ddl).count() == 0
    assert streams.compact(spark, path, fold, ddl) is None
    for n, part in enumerate((actions[60:], actions[:30], actions[30:60])):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").json(landing)
        streams.fold_stream(spark, landing, ddl, path, fold, mark).awaitTermination()
        touched = len({(a[0], a[1]) for a in part})
        assert spark.read.parquet(f"{path}/batch={n}").count() == touched
        if n == 1:
            assert streams.compact(spark, path, fold, ddl) == 1
            assert streams.compact(spark, path, fold, ddl) is None
    assert sorted(x for x in os.listdir(path)) == ["batch=0", "batch=1", "batch=2", "merged=1"]
    # A batch without its mark of commitment does not count.
    spark.createDataFrame([("u", "other", "offer", None, T0, 999)], ddl).transform(
        fold.part).write.parquet(f"{path}/batch=3")
    os.remove(f"{path}/batch=3/_SUCCESS")
    frame = spark.createDataFrame(actions, ddl)
    got = streams.merged(spark, path, fold, ddl)
    assert len(got.inputFiles()) <= 2 * 8  # the merged folder and one batch
    want = whole(frame)
    assert rows(fold.finish(got).select(*want.columns)) == rows(want)
