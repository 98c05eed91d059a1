"""Classifiers by held-out accuracy; pages, archives and vectors by round trip and brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from jobspark.llm import common, embedding_dedup, html_wrappers, language_cnn, quality_mil, queries, warc

SF = "/root/testdata/sf0.01"


# ---- language and quality ----------------------------------------------------------------

def test_language_of_held_out_documents(spark):
    got = queries.QUERIES["op5_language_cnn"](spark, SF).toPandas()
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(lang, on="doc_id")
    assert len(got) == len(lang)
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert both.score.between(0, 1).all()


def test_language_of_odd_texts(spark):
    docs = spark.createDataFrame(
        [(i, t, x) for i in range(40) for t, x in (("der und die das " * 20, "de"), ("le la les des " * 20, "fr"))],
        "doc_id bigint, text string, lang string")
    model = language_cnn.train(docs)
    odd = [None, "", "123 456 !!", "²³", "der", "le la les " * 50_000, "\0\0", "é"]
    got = {r["doc_id"]: r for r in language_cnn.identify(
        spark.createDataFrame([(i, t, "x") for i, t in enumerate(odd)], "doc_id bigint, text string, score string"), model).collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 3, 6)] == ["und"] * 5 and got[5]["lang_pred"] == "fr"
    assert all(got[i]["score"] == 0 for i in (0, 1, 2, 3, 6))
    untrained = language_cnn.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_cnn.identify(docs, untrained).collect()} == {"und"}
    assert language_cnn.identify(docs.limit(0), model).collect() == []


def test_every_window_counts():
    model = language_cnn.fit([b"aaaa" * 64] * 30 + [b"zzzz" * 64] * 30, ["a"] * 30 + ["z"] * 30)
    text = "a" * 256 + "z" * 256 * 9
    assert language_cnn.classify(model, [text])[0][0] == "z"
    assert language_cnn.classify(model, [text[::-1] + "a" * 256 * 30])[0][0] == "a"


def test_quality_of_held_out_documents(spark):
    got = queries.QUERIES["op3_quality_mil"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == 1000 and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]).all()
    assert (held.predicted == held.quality).mean() > 0.97
    good = held[held.quality == 1]
    assert good[good.toxic == 1].predicted.mean() > 0.95  # another matter than quality


def test_attention_finds_the_bad_passage():
    rng = np.random.default_rng(0)
    good = lambda n: bytes(rng.choice(list(b"abcdefgh "), n * quality_mil.PASSAGE).tolist())
    bad = lambda n: bytes(rng.choice(list(b"#$%&* "), n * quality_mil.PASSAGE).tolist())
    texts = [good(rng.integers(2, 9)) for _ in range(80)] + [good(3) + bad(1) + good(4) for _ in range(80)]
    bags = [quality_mil.encode(quality_mil.cut(t)) for t in texts]
    model = quality_mil.fit(bags, [1] * 80 + [0] * 80)
    assert quality_mil.scores(model, [good(8), good(6) + bad(1) + good(1), b"", None]).round().tolist()[:2] == [1, 0]
    x = quality_mil.encode(quality_mil.cut(good(6) + bad(1) + good(1)))
    weight = quality_mil._forward(model, x, np.array([0]))[4]
    assert weight.argmax() == 6


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "x", 3)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, 7)], "doc_id bigint, quality int")
    model = quality_mil.train(docs, labels)
    assert quality_mil.score(docs, model).count() == 3
    assert quality_mil.train(docs, labels.filter("quality = 1")) is None
    assert [r["score"] for r in quality_mil.score(docs, None).collect()] == [1.0] * 3
    assert quality_mil.score(docs.limit(0), model).collect() == []


# ---- pages -------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; tail</h1>%s<form><label>Name</label><input></form><aside>aside</aside>
<section class="comments"><p>Nice post</p></section></article>
<div id="sidebar-2">links</div><script>var a = "</p><article>";</script><footer>(c)</footer></body></html>"""


@pytest.mark.parametrize("body, text", [
    ("<p>One <b>bo</b>ld</p><p>Two</p>", "One bold Two"),
    ("<p>One<br>two<p>three", "One two three"),
    ("<p>a&nbsp; b\n\tc &lt;p&gt; &copy &#150;</p>", "a b c <p> © –"),
    ("<ul><li>x<li>y</ul><!-- <p>no</p> -->", "x y"),
    ("<p>1 < 2 & 3</p>", "1 < 2 & 3"),
    ("<p title='a>b'>q</p><div class=ad>buy</div>", "q"),
    ("", ""),
])
def test_main_text_of_a_page(body, text):
    tree = html_wrappers.shape(html_wrappers.parse(PAGE % body))
    for wrapper, main in ((None, None), (tree, "/html/body/article")):
        assert html_wrappers.main_text(PAGE % body, wrapper, main) == f"Head & tail {text}".strip()


def test_alignment_makes_groups_and_slots():
    pages = [PAGE % "<p>a</p>", PAGE % "<p>a</p><p>b</p><p>c</p>", PAGE % "<h2>s</h2><p>a</p>",
             PAGE % "<dl><dt>k<dd>v<dt>k<dd>v</dl>"]
    shapes = [html_wrappers.shape(html_wrappers.parse(p)) for p in pages]
    whole = shapes[0]
    for one in shapes[1:]:
        whole = html_wrappers.align(whole, one)
    pattern = html_wrappers.expression(whole)
    assert "(<h2>#</h2>)?" in pattern and "(<p>#</p>)*" in pattern and "(<dt>#</dt><dd>#</dd>)+" in pattern
    assert all(html_wrappers._covers(whole, html_wrappers.parse(p)) for p in pages)
    assert not html_wrappers._covers(whole, html_wrappers.parse(PAGE % "<table><tr><td>x</table>"))


def test_main_element_is_what_holds_most_text_of_a_host(spark):
    page = "<body><div class=box><p>{}</p></div><div class=story><p>{}</p></div></body>"
    rows = [(i, "http://h.example/1", page.format("short", "long text " * 9)) for i in range(9)]
    rows += [(9, "http://H.example/2", page.format("for once very long " * 20, "story")), (10, None, None),
             (11, "none", "plain text"), (11, "none", "plain text")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("own"))
    got = {r["page_id"]: r for r in html_wrappers.extract(df).collect()}
    assert got[9]["text"] == "story" and got[9]["n_chars"] == 5
    assert got[10]["text"] == "" and got[11]["text"] == "plain text"
    assert html_wrappers.extract(df.limit(0)).collect() == []


def test_many_shapes_of_a_host_are_aligned_in_buckets(spark):
    rng = random.Random(1)
    tags = [f"x{i}" for i in range(12)]
    pages = ["<article><p>main</p>" + "".join(f"<{t}>{t}</{t}>" for t in sorted(rng.sample(tags, rng.randint(0, 12))))
             + "</article>" for _ in range(300)]
    df = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    made = html_wrappers.wrappers(df).collect()
    assert len(made) == 1 and made[0]["main"] == "/article"
    import json
    assert all(html_wrappers._covers(json.loads(made[0]["wrapper"]), html_wrappers.parse(p)) for p in pages)


# ---- archives ----------------------------------------------------------------------------

def test_archives_round_trip(spark, tmp_path):
    big = "<p>ü" + "x" * 200 + "</p>"
    rows = [(3, "http://a/é b\r\nX: y", big), (1, "http://b", big), (2, None, "small"), (5, "u", "small"),
            (4, "u", None), (6, "u", ""), (7, "u", big + "\r\n\r\n\x1f\x8b"), (None, "u", big), (8, "u", "z" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    path = str(tmp_path / "w")
    warc.write_archives(df, path, records_per_file=2)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows) and all(r["verified"] for r in got)
    by_id = {r["record_id"]: r for r in got}
    for page_id, _, html in rows:
        r = by_id[f"urn:page:{page_id}"]
        payload = (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        revisit = html == big and page_id != 1
        assert r["record_type"] == ("revisit" if revisit else "response")
        assert r["refers_to"] == ("urn:page:1" if revisit else None)
        assert r["payload"] == (None if revisit else payload)
    import glob
    import gzip
    text = b"".join(gzip.open(f).read() for f in glob.glob(f"{path}/part-*"))
    assert text.count(b"WARC/1.1\r\n") == len(rows) and b"\r\nX: y" not in text
    empty = str(tmp_path / "none")
    assert warc.archive(df.limit(0), empty).collect() == []


def test_damage_is_noticed():
    data = warc.record(1, "http://a", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parse(data).verified
    assert not warc.parse(data.replace(b"payload", b"pAyload")).verified
    with pytest.raises(ValueError):
        warc.parse(data[:-1])
    packed = warc.member(data)
    assert list(warc.members(packed + warc.member(b"") + packed)) == [data, data]
    with pytest.raises(ValueError):
        list(warc.members(packed[:-3]))


# ---- vectors -----------------------------------------------------------------------------

def simple_links(rows):
    """Links, and the smallest id reachable, of (id, vector, label)."""
    def fine(v, label):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    near = [[False] * n for _ in range(n)]
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if a == b and fine(v, a) and fine(w, b) and len(v) == len(w):
                v1, w1 = np.array(v, float), np.array(w, float)
                near[i][j] = near[j][i] = v1 @ w1 / math.sqrt((v1 @ v1) * (w1 @ w1)) >= 0.93
    out = []
    for i in range(n):
        seen, stack = {i}, [i]
        while stack:
            for j in (j for j, x in enumerate(near[stack.pop()]) if x and j not in seen):
                seen.add(j)
                stack.append(j)
        out.append((rows[i][0], sum(near[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return out


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup.tiles, "__defaults__", (7,))  # many tiles
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1, 1, 1, None):
        center = rng.normal(size=16)
        for spread in (0.05, 0.25, 0.5, 3):
            rows += [[None, (center + spread * rng.normal(size=16)).tolist(), label] for _ in range(9)]
    rows += [[None, rows[0][1], 0], [None, rows[0][1], 0], [None, (np.array(rows[0][1]) * 5).tolist(), 0],
             [None, None, 0], [None, [], 0], [None, [0.0] * 16, 0], [None, [math.nan] + [1.0] * 15, 0],
             [None, [None] + [1.0] * 15, 0], [None, [math.inf] + [1.0] * 15, 0], [None, rows[0][1][:8], 0]]
    order = rng.permutation(len(rows)).tolist()
    rows = [(int(i), r[1], r[2]) for i, r in zip(order, rows)] + [(5, rows[40][1], rows[40][2]), (None, rows[41][1], rows[41][2])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumns(
        {"node": F.lit("x"), "vec": F.lit(1), "n": F.lit(2)})
    got = embedding_dedup.near_duplicates(df).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == sorted(simple_links(rows), key=str)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert embedding_dedup.near_duplicates(df.limit(0)).collect() == []


def test_floats_are_compared_in_double_precision(spark):
    rng = np.random.default_rng(4)
    center = rng.normal(size=(4, 24))
    given = (center[rng.integers(0, 4, 120)] + rng.choice([0.1, 0.27], 120)[:, None] * rng.normal(size=(120, 24))).astype(np.float32)
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(given)] + [(500, [float(x) for x in given[0]], 0), (501, [-0.0] * 24, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = embedding_dedup.near_duplicates(df).collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == sorted(simple_links(rows))


def test_bounds_lose_no_link():
    rng = np.random.default_rng(5)
    for d in (3, 16, 64):
        x = embedding_dedup.unit(rng.normal(size=(60, d)) + 3 * rng.normal(size=(6, d))[rng.integers(0, 6, 60)])
        turned = x @ np.linalg.qr(rng.normal(size=(d, d)))[0]
        links = embedding_dedup.near(turned[:30], turned[30:], x[:30], x[30:])
        assert (links == (x[:30] @ x[30:].T >= 0.93)).all()


def test_checkpoints_go_to_the_shared_folder(spark):
    df = common.checkpoint(spark.range(3))
    assert df.count() == 3 and spark.sparkContext.getCheckpointDir() is not None


def test_documents_stay_where_no_language_can_be_learned(spark):
    docs = spark.createDataFrame(
        [(1, "some words", None), (2, None, None), (3, "", None), (4, "12 34", None),
         (5, "ж", None), (None, "more words", None), (5, "ж", None)],
        "doc_id bigint, text string, lang string")
    kept = language_cnn.keep_identified(docs, language_cnn.train(docs), 0.5)
    assert kept.columns == docs.columns
    assert sorted((r[0] or 0, r[1]) for r in kept.collect()) == [
        (0, "more words"), (1, "some words"), (5, "ж"), (5, "ж")]
    assert language_cnn.keep_identified(docs.limit(0), language_cnn.train(docs), 0.5).count() == 0


def test_language_stage_drops_what_is_in_no_learned_language(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(3)
    odd = {
        -1: "Широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства. ",
        -2: "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. ",
        -3: "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
        -4: "x " + " ".join(str(rng.randrange(10**6)) for _ in range(200)),
    }
    texts = {i: (t * 20)[:1000] for i, t in odd.items()}
    own = {r["lang"]: r["text"] for r in given.filter("length(text) between 1500 and 3000").join(
        spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id"), "doc_id").collect()}
    mixed = own["de"][:1024] + own["fr"][:1024]
    texts |= {-5: own["en"], -6: mixed, -7: "ж"}  # without label, in two languages, too short to tell
    docs = given.unionByName(spark.createDataFrame(
        [(i, t, None, None, len(t)) for i, t in texts.items()], given.schema))
    kept = {r[0] for r in corpus_pipeline.language(spark, docs, SF).select("doc_id").collect()}
    assert {i for i in texts if i in kept} == {-5, -6, -7}
    all_ids = {r[0] for r in given.select("doc_id").collect()}
    good = {r[0] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id").collect()}
    assert len(all_ids - kept) < 0.015 * len(all_ids) and good & all_ids <= kept


def test_language_stage_judges_texts_of_any_length(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    cyrillic = ("Широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства. "
                "Съешь же ещё этих мягких французских булок, да выпей чаю! ")
    rng = random.Random(9)  # letters beside numbers, shorter than a window
    texts = {-i: "x " + " ".join(str(rng.randrange(10**6)) for _ in range(rng.randrange(15, 32))) for i in range(1, 21)}
    texts[-50] = "".join(f"Строка {i * i % 997}: {cyrillic} " for i in range(400))  # hundreds of windows
    short = {-100 - r["doc_id"]: r["text"][:100] for r in given.filter("length(text) > 300").join(
        spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id"), "doc_id").collect()}
    docs = given.unionByName(spark.createDataFrame(
        [(i, t, None, None, len(t)) for i, t in (texts | short).items()], given.schema))
    kept = {r[0] for r in corpus_pipeline.language(spark, docs, SF).select("doc_id").collect()}
    assert max(len(texts[-i].encode()) for i in range(1, 21)) < language_cnn.WINDOW
    assert -50 not in kept and len(kept & set(texts)) <= 4
    assert len(kept & set(short)) >= 0.98 * len(short)
    brief = docs.filter(F.col("doc_id") <= -100).join(given.select(
        (-100 - F.col("doc_id")).alias("doc_id"), F.col("lang").alias("own")), "doc_id").select(
        "doc_id", "text", F.col("own").alias("lang"), "source", "n_chars")  # no document fills a window
    assert corpus_pipeline.language(spark, brief, SF).filter("doc_id < 0").count() >= 0.98 * len(short)
