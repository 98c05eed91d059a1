import json
import random
import time
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from jobspark import schemas, session
from jobspark.operators import embedding, folds, merge, runlog
from jobspark.plans import refresh
from jobspark.sources import tables
from jobspark.sources.tables import StateTable
from jobspark.streaming import refresh as streams

T0 = datetime(2024, 6, 1)
BODY = "We look for people who like to build large tables with great care and joy."
QUERIES = [{"keyword": "engineer", "location": ""}]
EMBED = embedding.hashing_embedder(16)


def land(folder, results):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "page.json").write_text(json.dumps({"results": results}))


def posting(n, body=BODY):
    return {"id": str(n), "title": f"Engineer {n}", "description": body}


def test_run_twice_and_then_change(spark, tmp_path):
    feed, home = tmp_path / "a", str(tmp_path / "store")
    land(feed, [posting(1), posting(2), posting(2, "again " + BODY), posting(3, "too short")])
    paths = {"adzuna": str(feed), "usajobs": str(tmp_path / "absent")}
    first = refresh.run(spark, home, paths, QUERIES, EMBED, "m", as_of=T0)
    assert (first["fetched_rows"], first["prepared_rows"]) == (3, 2)
    assert first["rejected_or_duplicate_rows"] == 1 and first["rows_by_source"] == {"adzuna": 2}
    assert (first["embedded_postings"], first["written_chunks"]) == (2, 2)
    assert [e["source"] for e in first["source_errors"]] == ["usajobs"]
    store = refresh.Store(spark, home)
    assert not list((tmp_path / "store" / "_staged").glob("*"))
    before = rows(store.table("job_posting_embeddings").read())

    again = refresh.run(spark, home, paths, QUERIES, EMBED, "m", as_of=T0 + timedelta(days=1))
    assert again["embedded_postings"] == 0 and again["prepared_rows"] == 2
    assert rows(store.table("job_posting_embeddings").read()) == before
    stored = store.table("job_postings").read()
    assert rows(stored.select("id", "synced_at")) == [
        ("adzuna:1", T0 + timedelta(days=1)), ("adzuna:2", T0 + timedelta(days=1))]

    land(feed, [posting(1, "changed " + BODY), posting(4)])
    (feed / "broken.json").write_text("{")
    third = refresh.run(spark, home, paths, QUERIES, EMBED, "m", as_of=T0 + timedelta(days=2))
    assert third["embedded_postings"] == 2
    assert {(e["source"], e["documents"]) for e in third["source_errors"]} == {
        ("adzuna", 1), ("usajobs", 1)}
    assert store.table("job_postings").read().count() == 3
    log = runlog.current(spark.read.parquet(home + "/pipeline_runs"))
    assert rows(log.groupBy("status").count()) == [("completed", 3)]
    assert runlog.latest(log).first()["synced_rows"] == 2


def test_stored_steps_go_once_nothing_reads_them(spark, tmp_path):
    store = refresh.Store(spark, str(tmp_path / "store"))
    first, second = (store.staged(name, spark.range(3)) for name in ("raw", "prepared"))
    store.drop_staged("raw")
    left = [p.name.split("-")[0] for p in (tmp_path / "store" / "_staged").glob("*/*")]
    assert left == ["prepared"] and second.count() == 3


def test_stale_flags_are_stored(spark, tmp_path):
    feed, home = tmp_path / "a", str(tmp_path / "store")
    land(feed, [posting(1)])
    store = refresh.Store(spark, home)
    apps = spark.createDataFrame(
        [("1", "applied", T0 - timedelta(days=20)), ("2", "applied", T0)],
        "id string, stage string, stage_updated_at timestamp")
    whole = spark.createDataFrame([], schemas.schema("applications")).unionByName(
        apps, allowMissingColumns=True)
    store.table("applications").write(whole)
    got = refresh.run(spark, home, {"adzuna": str(feed)}, QUERIES, EMBED, "m", as_of=T0)
    assert got["stale_applications"] == 1
    assert rows(store.table("applications").read().filter("is_stale").select("id")) == [("1",)]


def test_failure_is_logged_and_raised(spark, tmp_path):
    feed, home = tmp_path / "a", str(tmp_path / "store")
    land(feed, [posting(1)])

    def broken(df, column):
        raise RuntimeError("model is away")

    with pytest.raises(RuntimeError, match="away"):
        refresh.run(spark, home, {"adzuna": str(feed)}, QUERIES, broken, "m", as_of=T0)
    log = runlog.current(spark.read.parquet(home + "/pipeline_runs"))
    assert rows(log.select("status", "error_message")) == [("failed", "model is away")]


def skill_rows(spark, *names):
    return spark.createDataFrame([(n, n.upper(), None, None) for n in names],
                                 schemas.schema("skills"))


def test_state_table(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), schemas.schema("skills"), ["id"], 8)
    assert table.read().count() == 0 and table.versions() == []
    assert table.write(skill_rows(spark, *[f"s{i}" for i in range(40)])) == 1
    one = skill_rows(spark, "s3").withColumn("name", F.lit("new"))
    assert table.update(one, lambda old: merge.upsert(old, one, ["id"])) == 2
    assert table.read().count() == 40 and table.read().filter("name = 'new'").count() == 1
    assert table.read(before=2).filter("name = 'new'").count() == 0
    # Only one bucket of eight was written again.
    folders = list((tmp_path / "t").glob("buckets=8/version=2/bucket=*"))
    assert len(folders) == 1


def test_emptied_buckets_stay_empty(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), schemas.schema("skills"), ["id"], 4)
    table.write(skill_rows(spark, "a", "b", "c"))
    for name in "abc":
        gone = skill_rows(spark, name)
        table.update(gone, lambda old: merge.delete(old, gone, ["id"]))
    assert table.read().count() == 0


def test_vacuum_keeps_the_last_states(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), schemas.schema("skills"), ["id"], 2)
    table.write(skill_rows(spark, "a", "b", "c", "d"))
    for n in range(5):
        one = skill_rows(spark, "a").withColumn("name", F.lit(f"n{n}"))
        table.update(one, lambda old: merge.upsert(old, one, ["id"]))
    before = rows(table.read()), rows(table.read(before=6))
    assert table.vacuum(keep=2) > 0 and table.versions() == [5, 6]
    assert (rows(table.read()), rows(table.read(before=6))) == before
    assert table.vacuum(keep=2) == 0


def test_uncommitted_updates_do_not_count(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), schemas.schema("skills"), ["id"], 4)
    table.write(skill_rows(spark, "a"))
    tables.write_buckets(skill_rows(spark, "lost"), ["id"], 4, f"{table.path}/version=2")
    assert rows(table.read().select("id")) == [("a",)]
    assert table.update(skill_rows(spark, "b"), lambda old: merge.upsert(
        old, skill_rows(spark, "b"), ["id"])) == 2
    assert rows(table.read().select("id")) == [("a",), ("b",)]


def test_tables_bucketed_alike_join_in_place(spark, tmp_path):
    left = tables.save_bucketed(
        spark.range(1000).select(F.col("id").alias("k")), "left_side", "k", 4, str(tmp_path / "l"))
    right = tables.save_bucketed(
        spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("v")), "right_side", "k",
        4, str(tmp_path / "r"))
    joined = left.hint("merge").join(right, "k")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 1000
    spark.sql("DROP TABLE left_side")
    spark.sql("DROP TABLE right_side")


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    landing, home, mark = (str(tmp_path / x) for x in ("landing", "store", "mark"))

    def land_rows(start, stop, body):
        spark.range(start, stop).select(
            F.concat(F.lit("s:"), F.col("id").cast("string")).alias("id"), F.lit("s").alias("source"),
            F.lit("t").alias("title"), F.concat(F.lit(body), F.col("id").cast("string"))
            .alias("description_text"), F.col("id").alias("ingest_seq"),
        ).write.mode("append").json(landing)

    def go():
        streams.postings_stream(spark, landing, home, mark, EMBED, "m", T0).awaitTermination()

    land_rows(0, 20, BODY)
    go()
    store = refresh.Store(spark, home)
    assert store.table("job_postings").read().count() == 20
    land_rows(10, 30, "changed " + BODY)
    go()
    go()
    got = store.table("job_postings").read()
    assert got.count() == 30
    assert got.filter("description_text LIKE 'changed%'").count() == 20
    chunks = store.table("job_posting_embeddings").read()
    assert embedding.pending(got, chunks, "m").count() == 0 and chunks.count() == 30


def test_action_stream_with_late_actions(spark, tmp_path):
    landing, log, mark = (str(tmp_path / x) for x in ("landing", "log", "mark"))
    ddl = ("user_id STRING, job_posting_id STRING, feedback STRING, reason STRING, "
           "ts TIMESTAMP, seq BIGINT")
    state = StateTable(spark, str(tmp_path / "state"), schemas.schema("job_feedback"),
                       ["user_id", "job_posting_id"], 8)
    rnd = random.Random(3)
    actions = [(f"u{rnd.randrange(3)}", f"j{rnd.randrange(3)}",
                rnd.choice(["good", "bad", "skip"]), None, T0 + timedelta(minutes=rnd.randrange(99)),
                i) for i in range(90)]
    for part in range(3):
        df = spark.createDataFrame(actions[part * 30: part * 30 + 30], ddl)
        df.coalesce(1).write.mode("append").json(landing)
        streams.actions_stream(
            spark, landing, ddl, log, state, folds.feedback, mark).awaitTermination()
    whole = folds.feedback(spark.createDataFrame(actions, ddl))
    assert len(state.versions()) == 3
    assert rows(state.read().select(*whole.columns)) == rows(whole)


def test_an_empty_state_is_no_side_of_a_join(spark, tmp_path):
    table = refresh.Store(spark, str(tmp_path), 4).table("job_posting_embeddings")
    empty = table.read()
    assert empty.collect() == [] and empty.schema.simpleString() == table.schema.simpleString()
    postings = spark.range(5).selectExpr("cast(id AS string) AS id", "'h' AS content_hash")
    todo = embedding.pending(postings, empty, "m")
    assert todo.count() == 5
    assert "Join" not in todo._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_are_written_to_their_buckets_alone(spark, tmp_path, monkeypatch):
    store = refresh.Store(spark, str(tmp_path), 4)
    rows = spark.range(6).selectExpr("cast(id AS string) AS id", "concat('h', id) AS content_hash",
                                     "repeat('word ', 300) AS description_text")
    postings = spark.createDataFrame([], schemas.schema("job_postings")).unionByName(
        rows, allowMissingColumns=True)
    store.table("job_postings").write(postings)
    named, staged = [], refresh.Store.staged
    monkeypatch.setattr(refresh.Store, "staged", lambda self, name, df: named.append(name) or staged(self, name, df))
    at = datetime(2024, 6, 1)
    run = lambda: refresh.embed_pending(store, embedding.hashing_embedder(8), "m", at)
    assert run() == (6, 12) and run() == (0, 0)
    assert store.table("job_posting_embeddings").read().count() == 12 and "chunks" not in named


def test_shuffles_go_with_their_query(spark, tmp_path):
    files = lambda: [x for x in (f.getName() for f in list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))) if x.startswith("shuffle_")]
    was = spark.conf.get(session.SHORT_LIVED)
    try:
        store = refresh.Store(spark, str(tmp_path / "store"), 4)
        before = set(files())
        made = store.staged("x", spark.range(5000).repartition(5, "id").groupBy((F.col("id") % 900).alias("k")).count())
        assert made.count() == 900
        end = time.time() + 20
        while set(files()) - before and time.time() < end:
            time.sleep(0.2)
        assert not set(files()) - before
    finally:
        spark.conf.set(session.SHORT_LIVED, was)
