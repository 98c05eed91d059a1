import random

import numpy as np
import pandas as pd
import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from jobspark.operators import block_top, embedding, search
from jobspark.plans import bridge, queries

PLACES = ["Berlin", "New York, NY", "York_100%", None, "new york"]


def make(seed, n=120, dim=6):
    rnd = random.Random(seed)
    postings = [(f"s{i % 3}:{i:03d}", f"s{i % 3}", rnd.choice([True, False, None]),
                 rnd.choice([None, float(rnd.randrange(50, 150))]), rnd.choice(PLACES))
                for i in range(n)]
    chunks = []
    for i, p in enumerate(postings):
        # The first posting owns a third of all chunks.
        for c in range(n // 2 if i == 0 else rnd.randrange(0, 3)):
            base = [rnd.choice([-1.0, 0.0, 1.0]) for _ in range(dim)]
            if not any(base):
                base[0] = 1.0
            chunks.append((f"{p[0]}#{c}", p[0], base, rnd.choice(["m", "m", "n"]),
                           rnd.choice(["h", "old"])))
    requests = [("r1", [1.0] * dim, "m", None, False, None, None),
                ("r2", [1.0, -1.0] + [0.0] * (dim - 2), "m", ["S1", "S2"], True, None, None),
                ("r3", [0.5] * dim, "m", [], False, 100.0, None),
                ("r4", [-1.0] * dim, "n", None, False, None, "york"),
                ("r5", [1.0] * dim, "m", None, False, None, "k_1"),
                ("r6", [1.0] * dim, "absent", None, False, None, None)]
    return postings, chunks, requests


def frames(spark, postings, chunks, requests):
    p = spark.createDataFrame(
        postings, "id string, source string, remote boolean, salary_max double, location string")
    p = p.withColumns({
        "content_hash": F.lit("h"), "title": F.lit("t"), "company": F.lit("c"),
        "salary_min": F.lit(None).cast("double"), "salary_currency": F.lit("USD"),
        "employment_type": F.lit(None).cast("string"), "category": F.lit(None).cast("string"),
        "description_text": F.repeat(F.lit("abc "), 300), "apply_url": F.lit("u"),
        "posted_at": F.lit(None).cast("timestamp")})
    c = spark.createDataFrame(
        chunks, "id string, job_posting_id string, embedding array<float>, model_name string, "
                "content_hash string").withColumn("chunk_text", F.col("id"))
    r = spark.createDataFrame(
        requests, "request_id string, vector array<double>, model_name string, "
                  "sources array<string>, remote_only boolean, minimum_salary double, "
                  "location string")
    return r, c, p


def fits(place, asked):
    if asked is None:
        return True
    return place is not None and bool(search.like_pattern(asked).fullmatch(place))


def brute(postings, chunks, requests, pool, k, fresh=False):
    known = {p[0]: p for p in postings}
    out = []
    for rid, vector, model, sources, remote_only, salary, place in requests:
        near = []
        for cid, pid, emb, m, h in chunks:
            _, source, remote, pay, where = known[pid]
            if m != model or (fresh and h != "h"):
                continue
            if sources and source not in [s.lower() for s in sources]:
                continue
            if remote_only and remote is not True:
                continue
            if salary is not None and (pay is None or pay < salary):
                continue
            if not fits(where, place):
                continue
            a, b = np.array(emb), np.array(vector)
            d = 1 - float(a @ b) / float(np.linalg.norm(a) * np.linalg.norm(b))
            near.append((round(d, 9), cid, pid))
        best = {}
        for d, cid, pid in sorted(near)[:pool]:
            best.setdefault(pid, (d, pid, cid))
        for rank, (d, pid, cid) in enumerate(sorted(best.values())[:k], 1):
            out.append((rid, rank, pid, cid, round(1 - d, 6)))
    return sorted(out)


def got(df):
    return sorted((r["request_id"], r["base_rank"], r["job_posting_id"], r["chunk_id"],
                   round(r["similarity"], 6)) for r in df.collect())


def stable(found):
    """Ranks and similarities; equal distances may order by float noise."""
    return [(r, n, s) for r, n, _, _, s in found]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("fresh", [False, True])
@pytest.mark.parametrize("late", [False, True])
def test_equals_brute_force(spark, seed, fresh, late):
    data = make(seed)
    r, c, p = frames(spark, *data)
    want = brute(*data, pool=50, k=5, fresh=fresh)
    found = got(search.search(r, c, p, top_k=5, fresh_only=fresh, late=late))
    assert stable(found) == stable(want)
    assert not any(x[0] == "r6" for x in found)


def test_blocks_equal_broadcast(spark):
    r, c, p = frames(spark, *make(3))
    whole = got(search.search(r, c, p, top_k=8))
    blocks = got(search.search(r, c, p, top_k=8, request_rows=2, candidate_rows=20))
    assert blocks == whole
    by_size = got(search.search(r, c, p, top_k=8, request_bytes=200, candidate_rows=50))
    assert by_size == whole


def test_filters_common_to_all_requests(spark):
    postings, chunks, _ = make(6)
    dim = len(chunks[0][2])
    asked = [("a", [1.0] * dim, "m", ["s1"], True, 60.0, None),
             ("b", [-1.0] * dim, "m", ["S2", "s1"], True, 90.0, "new")]
    r, c, p = frames(spark, postings, chunks, asked)
    assert stable(got(search.search(r, c, p, top_k=5))) == stable(
        brute(postings, chunks, asked, 50, 5))
    assert search.search(r.limit(0), c, p).count() == 0
    blank = [("a", [1.0] * dim, "m", [""], False, None, None)]
    r, c, p = frames(spark, postings, chunks, blank)
    assert stable(got(search.search(r, c, p))) == stable(brute(
        postings, chunks, [("a", [1.0] * dim, "m", None, False, None, None)], 50, 5))


@pytest.mark.parametrize("pool", [1, 3, 10])
def test_late_filters_draw_again_where_too_few_are_left(spark, pool):
    r, c, p = frames(spark, *make(4, n=200))
    direct = got(search.search(r, c, p, top_k=5, pool=pool, late=False))
    assert got(search.search(r, c, p, top_k=5, pool=pool, late=True)) == direct
    assert got(search.search(r, c, p, top_k=5, pool=pool, late=True, request_rows=2,
                             candidate_rows=30)) == direct


def test_first_draw_moves_no_vector(spark, tmp_path):
    r, c, p = frames(spark, *make(4))
    c.write.parquet(str(tmp_path / "chunks"))
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    asked = block_top.measure(r.withColumn("probes", F.lit(None).cast("array<int>")))
    plan = search._draw(asked, stored, 10, 1000)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("MapInPandas", 1)[1]
    assert "Exchange" not in below and "Join" not in below


def test_models_of_different_dimension(spark):
    postings = [("s:1", "s", True, None, None), ("s:2", "s", True, None, None)]
    chunks = [("s:1#0", "s:1", [1.0, 0.0], "m", "h"), ("s:2#0", "s:2", [0.0, 1.0, 0.0], "n", "h")]
    r, c, p = frames(spark, postings, chunks, [
        ("a", [1.0, 0.0], "m", None, False, None, None),
        ("b", [0.0, 1.0, 0.0], "n", None, False, None, None)])
    assert got(search.search(r, c.coalesce(1), p)) == [
        ("a", 1, "s:1", "s:1#0", 1.0), ("b", 1, "s:2", "s:2#0", 1.0)]
    r, c, p = frames(spark, postings, chunks, [
        ("a", [1.0, 0.0, 0.0], "m", None, False, None, None)])
    with pytest.raises(Exception, match="matmul|dimension"):
        search.search(r, c, p).collect()


def test_vectors_of_zeros_are_near_nothing(spark):
    postings = [(f"s:{i:02d}", "s", True, None, None) for i in range(80)]
    chunks = [(f"{x[0]}#0", x[0], [1.0, float(i)] if i < 20 else [0.0, 0.0], "m", "h")
              for i, x in enumerate(postings)]
    r, c, p = frames(spark, postings, chunks, [
        ("r", [1.0, 0.0], "m", None, False, None, None)])
    assert len(got(search.search(r, c, p, top_k=25))) == 20


def test_one_posting_may_fill_the_pool(spark):
    postings = [("s:1", "s", True, None, None), ("s:2", "s", True, None, None)]
    chunks = [(f"s:1#{i:02d}", "s:1", [1.0, 0.001 * i], "m", "h") for i in range(60)]
    chunks.append(("s:2#0", "s:2", [0.0, 1.0], "m", "h"))
    r, c, p = frames(spark, postings, chunks, [
        ("r", [1.0, 0.0], "m", None, False, None, None)])
    assert got(search.search(r, c, p, top_k=5)) == [("r", 1, "s:1", "s:1#00", 1.0)]


def test_equal_vectors_are_cut_by_id(spark):
    postings = [(f"s:{i:03d}", "s", True, None, None) for i in range(300)]
    chunks = [(f"{x[0]}#0", x[0], [1.0, 1.0], "m", "h") for x in postings]
    random.Random(5).shuffle(chunks)
    r, c, p = frames(spark, postings, chunks, [
        ("r", [1.0, 1.0], "m", None, False, None, None)])
    found = got(search.search(r, c.repartition(7), p, top_k=25))
    assert [x[2] for x in found] == [f"s:{i:03d}" for i in range(25)]


def test_result_columns_and_limits(spark):
    r, c, p = frames(spark, *make(1))
    every = search.search(r, c, p, top_k=1000)
    assert every.groupBy("request_id").count().agg(F.max("count")).first()[0] > 25
    df = search.search(r, c, p, top_k=1000, most=25)
    assert df.groupBy("request_id").count().agg(F.max("count")).first()[0] <= 25
    first = df.first()
    assert len(first["description_preview"]) == 500 and first["chunk_text"] == first["chunk_id"]
    assert (search.pool_of(1), search.pool_of(20), search.pool_of(25), search.pool_of(60)) == (50, 200, 250, 600)
    assert (search.top_k_of(0), search.top_k_of(99), search.top_k_of(99, 20)) == (1, 99, 20)


def test_like_keeps_wildcards():
    assert search.like_pattern("a_c").fullmatch("xxABCxx")
    assert not search.like_pattern("a_c").fullmatch("ac")
    assert search.like_pattern("a%c").fullmatch("a\n...c")
    assert search.like_pattern("100\\%").fullmatch("is 100% it")
    assert not search.like_pattern("100\\%").fullmatch("is 100 it")


def test_rerank_keeps_every_result(spark):
    found = spark.range(1500).select(
        F.lit("r").alias("request_id"), F.lit("u").alias("user_id"), F.col("id").cast("string").alias("job_posting_id"),
        F.lit(0.5).alias("similarity"), F.col("id").alias("base_rank"))
    none = spark.createDataFrame([], "user_id string, job_posting_id string, feedback string")
    got = search.rerank(found, none)
    assert got.count() == 1500 and got.agg(F.max("rank")).first()[0] == 1500


def test_rerank(spark):
    found = spark.createDataFrame(
        [("r", "u", "a", 1, 0.98), ("r", "u", "b", 2, 0.97), ("r", "u", "c", 3, 0.96),
         ("r", "u", "d", 4, 0.02), ("r", "u", "e", 5, 0.02)],
        "request_id string, user_id string, job_posting_id string, base_rank int, "
        "similarity double")
    signals = spark.createDataFrame(
        [("u", "a", "bad"), ("u", "b", "good"), ("u", "c", "skip"), ("u", "d", "bad"),
         ("other", "e", "good")], "user_id string, job_posting_id string, feedback string")
    df = search.rerank(found, signals)
    assert rows(df.select("rank", "job_posting_id", "similarity", "base_similarity")) == [
        (1, "b", 1.0, 0.97), (2, "c", 0.92, 0.96), (3, "a", 0.88, 0.98), (4, "e", 0.02, 0.02),
        (5, "d", -0.08, 0.02)]
    floor = search.rerank(found, signals, low=0.0).filter("job_posting_id = 'd'").first()
    assert floor["similarity"] == 0.0


def test_profile_defaults(spark):
    df = spark.createDataFrame(
        [("1", " find  work ", None, None, "", ["a", "b"], "remote_only", 10.0, ["Berlin"]),
         ("2", "x", True, 5.0, "Rome", [], "any", 10.0, ["Berlin"]),
         ("3", "x", False, None, None, None, None, None, ["REMOTE"]),
         ("4", "x", False, None, None, None, "hybrid", 0.0, ["A", "B"])],
        "request_id string, query string, remote_only boolean, minimum_salary double, "
        "location string, target_roles array<string>, remote_preference string, "
        "salary_min double, locations_preferred array<string>")
    assert rows(search.with_defaults(df)) == [
        ("1", "find work. Target roles: a, b", True, 10.0, "Berlin"),
        ("2", "x", True, 5.0, "Rome"), ("3", "x", False, None, None),
        ("4", "x", False, 0.0, None)]


def test_approximate_search_finds_most(spark):
    data = make(9, n=200)
    r, c, p = frames(spark, *data)
    c, r = c.filter("model_name = 'm'"), r.filter("model_name = 'm'")
    model = search.train_lists(c, 6)
    listed = search.with_list(c, model)
    exact = search.search(r, c, p, top_k=5)
    every = search.approximate_search(r, listed, p, model, probes=6, top_k=5)
    assert got(every) == got(exact)
    some = search.approximate_search(r, listed, p, model, probes=3, top_k=5)
    score = search.recall(some, exact).agg(F.avg("recall")).first()[0]
    assert 0.4 <= score <= 1.0


def test_lists_in_small_blocks_equal_exact_search(spark):
    postings, chunks, requests = make(4, n=90)
    # One list holds a third of all chunks; one chunk has no vector, one request only zeros.
    chunks += [(f"s0:000#x{i}", f"s{i % 3}:{i % 90:03d}", [1.0, 0.01 * i, 0.0, 0.0, 0.0, 0.0], "m",
                "h") for i in range(1, 60)] + [("none", "s0:000", None, "m", "h")]
    requests.append(("r7", [0.0] * 6, "m", None, False, None, None))
    r, c, p = frames(spark, postings, chunks, requests)
    centres = [[float(i == j) for i in range(6)] for j in range(6)]
    listed = search.with_list(c, centres)
    assert listed.filter("list_id IS NULL").count() == 1
    assert listed.groupBy("list_id").count().agg(F.max("count")).first()[0] > 60
    exact = got(search.search(r, c, p, top_k=5))
    for rows_, asked in ((20_000, 4_000), (7, 2)):
        found = search.approximate_search(r, listed, p, centres, probes=6, top_k=5,
                                          list_rows=rows_, list_requests=asked)
        assert got(found) == exact
    fresh = search.approximate_search(r, listed, p, centres, probes=6, top_k=5, fresh_only=True)
    assert got(fresh) == got(search.search(r, c, p, top_k=5, fresh_only=True))
    few = search.probed_pairs(r, listed, centres, 2).first()
    assert few["compared"] < few["all_pairs"]
    every = search.probed_pairs(r, listed.filter("embedding IS NOT NULL"), centres, 6).first()
    assert every["compared"] == every["all_pairs"]


def test_lists_of_empty_tables(spark):
    r, c, p = frames(spark, *make(4, n=9))
    centres = [[1.0] * 6, [-1.0] * 6]
    listed = search.with_list(c.limit(0), centres)
    assert search.approximate_search(r, listed, p, centres).count() == 0
    assert search.approximate_search(
        r.limit(0), search.with_list(c, centres), p, centres).count() == 0


def test_recall_of_the_registered_search(spark):
    found = queries.QUERIES["approximate_search"](spark, SF)
    assert found.agg(F.sum("found") / F.sum("wanted")).first()[0] >= 0.9
    asked, stored = bridge.vector_requests(spark, SF), bridge.chunks(spark, SF)
    exact = search.search(asked, stored, bridge.postings(spark, SF), top_k=10)
    share = search.recall(queries.QUERIES["approximate_topk"](spark, SF), exact)
    assert share.agg(F.avg("recall")).first()[0] >= 0.9


def test_text_search_equals_brute_force(spark):
    words = "spark table query join shuffle key bucket stream window skew".split()
    rnd = random.Random(8)
    texts = {f"s:{i:02d}": " ".join(rnd.choice(words) for _ in range(rnd.randrange(5, 400)))
             for i in range(25)}
    asked = {f"r{i}": " ".join(rnd.sample(words, 3)) for i in range(4)}
    _, _, p = frames(spark, [(k, "s", True, None, None) for k in texts], [("x", "s:00", [1.0], "m",
                                                                          "h")], [])
    body = spark.createDataFrame(list(texts.items()), "id string, body string")
    p = p.drop("description_text").join(body, "id").withColumnRenamed("body", "description_text")
    embed = embedding.hashing_embedder(4096)
    stored = embedding.embed_postings(p, embed, "m", F.lit(None).cast("timestamp"), size=300,
                                      overlap=30)
    requests = spark.createDataFrame(list(asked.items()), "request_id string, search_text string")
    found = got(search.search(search.embedded(requests, embed, "m"), stored, p, top_k=5))

    def counts(text):
        return np.array([text.split().count(w) for w in words], float)

    want = []
    for rid, text in asked.items():
        near = []
        for pid, whole in texts.items():
            at, index = 0, 0
            while True:
                piece = whole[at: at + 300]
                a, b = counts(text), counts(piece)
                cut = np.array([w for w in piece.split()])
                other = [w for w in cut if w not in words]
                size = np.sqrt(b @ b + sum(other.count(w) ** 2 for w in set(other)))
                near.append((round(1 - float(a @ b) / (np.linalg.norm(a) * size), 5),
                             f"{pid}#{index}", pid))
                if at + 300 >= len(whole):
                    break
                at, index = at + 270, index + 1
        best = {}
        for d, cid, pid in sorted(near)[:50]:
            best.setdefault(pid, d)
        want += [(rid, n, round(1 - d, 5)) for n, d in enumerate(sorted(best.values())[:5], 1)]
    assert [(r, n) for r, n, *_ in found] == [(r, n) for r, n, _ in sorted(want)]
    assert [s for *_, s in found] == pytest.approx([s for *_, s in sorted(want)], abs=1e-4)


def test_blocks_of_many_requests_equal_brute_force():
    rnd = np.random.default_rng(3)
    cand = pd.DataFrame({
        "id": [f"c{i:03d}" for i in range(200)], "job_posting_id": "p", "content_hash": "h",
        "embedding": [rnd.integers(-2, 3, 3).astype(float) for _ in range(200)], "model_name": "m",
        "source": "s", "remote": [bool(i % 2) for i in range(200)],
        "salary_max": [float(i) if i % 5 else None for i in range(200)], "location": "Berlin"})
    vectors = [np.array(v) for v in ([1.0, 0, 0], [1.0, 2, 0], [0.0, 0, 0])]
    req = pd.DataFrame([(f"r{i}", vectors[i % 3], "m", None, i % 2 == 0, float(i) if i % 4 else None, "b_rl")
                        for i in range(60)], columns=search.REQUEST_FIELDS)
    score = search._score(7)
    first, second = score(cand[:100], req), cand[100:]
    best = search._keep_nearest(first, 7)
    later = score(second, req, search._farthest(best, 7))
    assert len(later) < len(score(second, req))  # what is too far away is left out
    found = search._keep_nearest(pd.concat([best, later], ignore_index=True), 7)
    for _, r in req.iterrows():
        want = []
        for _, c in cand.iterrows():
            size = np.linalg.norm(c["embedding"]) * np.linalg.norm(r["vector"])
            if size and (not r["remote_only"] or c["remote"]) and (
                    pd.isna(r["minimum_salary"]) or c["salary_max"] >= r["minimum_salary"]):
                want.append((round(1 - c["embedding"] @ r["vector"] / size, 12), c["id"]))
        got = found[found["request_id"] == r["request_id"]]
        assert list(got["chunk_id"]) == [c for _, c in sorted(want)[:7]]


def test_a_task_holds_numbers_and_hands_on_bounded_blocks(monkeypatch):
    rnd = np.random.default_rng(4)
    cand = pd.DataFrame({
        "id": [f"c{i:03d}" for i in rnd.permutation(300)], "job_posting_id": "p", "content_hash": "h",
        "embedding": [rnd.integers(-2, 3, 3).astype(float) for _ in range(300)], "model_name": "m",
        "source": "s", "remote": True, "salary_max": rnd.integers(0, 40, 300).astype(float), "location": "Berlin"})
    req = pd.DataFrame([(f"r{i}", rnd.integers(-1, 2, 3).astype(float), "m", None, False, float(i % 9), None)
                        for i in range(50)], columns=search.REQUEST_FIELDS)
    monkeypatch.setattr(search, "_EMITTED", 40)
    blocks = [cand[k:k + 70].reset_index(drop=True) for k in range(0, 300, 70)]
    made = list(search._gather(7)(iter(blocks), req))
    assert all(0 < len(x) <= 40 for x in made)
    want = search._keep_nearest(search._score(300)(cand, req), 7)
    rows = lambda df: sorted(map(tuple, df[["request_id", "chunk_id", "job_posting_id", "content_hash", "distance"]].to_numpy()))
    assert rows(pd.concat(made)) == rows(want)


@pytest.mark.parametrize("late", [False, True])
def test_requests_that_ask_for_the_same_are_drawn_once(spark, monkeypatch, late):
    chunks = spark.createDataFrame(
        [(f"c{i}", f"p{i % 7}", [float(i), 1.0], "m", "h", f"t{i}") for i in range(20)],
        "id string, job_posting_id string, embedding array<double>, model_name string, content_hash string, chunk_text string")
    postings = spark.createDataFrame([(f"p{i}", "s", i % 2 == 0, 10.0 * i, "Berlin", f"text {i}") for i in range(7)],
                                     "id string, source string, remote boolean, salary_max double, location string, description_text string")
    postings = postings.withColumns({c: F.lit(None).cast("string") for c in (
        "title", "company", "salary_currency", "employment_type", "category", "apply_url")}).withColumns(
        {"salary_min": F.lit(0.0), "posted_at": F.lit(None).cast("timestamp")})
    asked = spark.createDataFrame(
        [(f"r{i}", [1.0, float(i % 2)], "m", None, i % 3 == 0, None, None) for i in range(12)],
        "request_id string, vector array<double>, model_name string, sources array<string>, remote_only boolean, "
        "minimum_salary double, location string")
    seen, best = [], search.block_top.best_per_request
    monkeypatch.setattr(search.block_top, "best_per_request", lambda c, a, *more: seen.append(a.rows) or best(c, a, *more))
    got = search.search(asked, chunks, postings, top_k=3, late=late)
    found = {}
    for r in got.collect():
        found.setdefault(r["request_id"], []).append((r["base_rank"], r["job_posting_id"], r["similarity"]))
    assert seen[0] == (2 if late else 4)
    assert len(found) == 12 and all(sorted(found[f"r{i}"]) == sorted(found[f"r{i + 6}"]) for i in range(6))
    assert sorted(found["r0"]) != sorted(found["r1"])
