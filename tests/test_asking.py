import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_search import frames

from jobspark.operators import asking, embedding

BODIES = {"s:0": "spark table joins", "s:1": "garden and flowers", "s:2": "spark streams",
          "s:3": "spark table spark table"}


@pytest.fixture()
def tables(spark):
    _, _, p = frames(spark, [(k, "s", k != "s:2", 10.0, "Berlin") for k in BODIES],
                     [("x", "s:0", [1.0], "m", "h")], [])
    body = spark.createDataFrame(list(BODIES.items()), "id string, body string")
    p = p.drop("description_text").join(body, "id").withColumnRenamed("body", "description_text")
    users = spark.createDataFrame(
        [("u1", "a@x.org"), ("u2", "b@x.org"), ("u3", "c@x.org")], "id string, email string")
    profiles = spark.createDataFrame(
        [("p1", "u1", ["table"], "any", None, ["Berlin"], True, "2024-01-02"),
         ("p0", "u1", ["garden"], "any", None, [], False, "2024-01-01"),
         ("p2", "u2", None, "remote_only", None, None, False, "2024-01-01")],
        "id string, user_id string, target_roles array<string>, remote_preference string, "
        "salary_min double, locations_preferred array<string>, is_default boolean, "
        "created_at string")
    asked = spark.createDataFrame(
        [("r1", " A@X.org", "spark", None, None, None), ("r2", "b@x.org", " spark ", None, None, ""),
         ("r3", "c@x.org", "spark", None, None, None), ("r4", "d@x.org", "spark", None, None, None),
         ("r5", "a@x.org", "  ", None, None, None), ("r6", "a@x.org", None, None, None, None)],
        "request_id string, user_email string, query string, remote_only boolean, "
        "minimum_salary double, location string")
    return asked, users, profiles, p


def test_refused_requests(spark, tables):
    asked, users, profiles, _ = tables
    got = asking.resolved(asked, users, profiles)
    assert rows(got.select("request_id", "error")) == [
        ("r1", None), ("r2", None), ("r3", "no profile"), ("r4", "unknown user"),
        ("r5", "no search text"), ("r6", "no search text")]
    first = got.filter("request_id = 'r1'").first()
    assert (first["profile_id"], first["search_text"], first["location"]) == (
        "p1", "spark. Target roles: table", "Berlin")
    assert asking.resolved(asked.limit(0), users, profiles).count() == 0


def test_search_of_a_user(spark, tables):
    asked, users, profiles, p = tables
    embed = embedding.hashing_embedder(4096)
    chunks = embedding.embed_postings(p, embed, "m", F.lit(None).cast("timestamp"))
    signals = spark.createDataFrame(
        [("u1", "s:3", "bad"), ("u2", "s:0", "good")],
        "user_id string, job_posting_id string, feedback string")
    got = asking.profile_search(asked, users, profiles, chunks, p, signals, embed, "m", top_k=5)
    found = {}
    for r in got.orderBy("request_id", "rank").collect():
        found.setdefault(r["request_id"], []).append(r)
    assert set(found) == {"r1", "r2"}
    assert {r["job_posting_id"] for r in found["r1"]} == set(BODIES)
    # "spark. Target roles: table" shares one of its four words with each of them.
    near = {r["job_posting_id"]: r["base_similarity"] for r in found["r1"]}
    assert near["s:0"] == pytest.approx(1 / (2 * 3 ** 0.5), abs=1e-5)
    assert near["s:3"] == pytest.approx(2 / (2 * 8 ** 0.5), abs=1e-5)
    lowered = next(r for r in found["r1"] if r["job_posting_id"] == "s:3")
    assert lowered["similarity"] == pytest.approx(lowered["base_similarity"] - 0.1)
    # The second user's profile asks for remote postings alone.
    assert [(r["job_posting_id"], r["similarity"]) for r in found["r2"]] == [
        ("s:3", 0.707107), ("s:0", pytest.approx(3 ** -0.5 + 0.05, abs=1e-5)), ("s:1", 0.0)]


def test_equal_vectors_tie_by_id(spark, tables):
    _, users, profiles, p = tables
    embed = embedding.hashing_embedder(64)
    same = p.withColumn("description_text", F.lit("one and the same text"))
    chunks = embedding.embed_postings(same, embed, "m", F.lit(None).cast("timestamp"))
    asked = spark.createDataFrame(
        [(f"r{i}", "a@x.org", f"text {i}", None, None, None) for i in range(7)],
        "request_id string, user_email string, query string, remote_only boolean, "
        "minimum_salary double, location string")
    signals = spark.createDataFrame([], "user_id string, job_posting_id string, feedback string")
    got = asking.profile_search(asked, users, profiles, chunks, same, signals, embed, "m")
    for r in got.collect():
        assert r["job_posting_id"] == f"s:{r['rank'] - 1}"
