import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from jobspark.llm import common, queries, suffix_dedup as dedup

WIDTH = 100
SCHEMA = "doc_id long, text string"


def brute(rows):
    """Rows of one id must have one text."""
    seen, out = set(), {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = [False] * len(data)
        for at in range(len(data) - WIDTH + 1):
            string = data[at:at + WIDTH]
            if string in seen:
                gone[at:at + WIDTH] = [True] * WIDTH
            seen.add(string)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        rest = bytes(b for b, g in zip(data, gone) if not g)
        out[doc] = (doc, len(data), sum(gone), runs, hashlib.sha256(rest).hexdigest())
    return sorted((out[doc] for doc, _ in rows), key=repr)


def found(df, **limits):
    return sorted((tuple(r) for r in dedup.report(df, **limits).collect()), key=repr)


def passages(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "übung", "x", "longer-word", "0"]
    blocks = [" ".join(rng.choice(words) for _ in range(rng.randrange(8, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rng.choice(blocks) if rng.random() < .5 else
                 " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(30))
                 for _ in range(rng.randrange(0, 6))]
        rows.append((i, "\n".join(parts)))
    for i in range(n, n + 20):  # near copies
        text = rng.choice(rows)[1]
        at = rng.randrange(len(text) + 1)
        rows.append((i, text[:at] + "#" + text[at:]))
    return rows


@pytest.mark.parametrize("symbols", [2, 3, 200, 2000])
@pytest.mark.parametrize("few", [0, 512])
def test_suffix_array_against_sorting(monkeypatch, symbols, few):
    if few and symbols > few:
        return
    monkeypatch.setattr(dedup, "FEW", few)
    rng = random.Random(symbols)
    for n in [0, 1, 2, 3, 10, 100, 400]:
        for _ in range(5):
            s = [rng.randrange(1, symbols) for _ in range(n)]
            s = np.array(s + s[: n // 2] + [0])
            want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
            assert dedup.suffix_array(s, symbols).tolist() == want


def test_prefixes_end_at_separators():
    s = np.frombuffer(b"abcab\0abcab\0bc\0", np.uint8).astype(np.int64) + 2
    s[s == 2] = 1
    s = np.r_[s, 0]
    array = dedup.suffix_array(s, 258)
    got = dedup.common_prefixes(s, array, 1)
    for a, b in zip(array, array[1:]):
        n = 0
        while s[a + n] == s[b + n] and s[a + n] > 1:
            n += 1
        assert got[b] == n


@pytest.mark.parametrize("seed", [1, 2])
def test_report_against_brute_force(spark, seed):
    rows = passages(seed, 150)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(7)) == brute(rows)


def test_grams_beyond_a_shard_are_dealt_again(spark):
    rng = random.Random(5)
    line = "this very common line stands in each document, between words that no other document has "
    rows = [(i, f"{rng.random()} {line}{rng.random()} {'~' * rng.randrange(300)} end") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(9)
    pieces = dedup.meet(dedup.deal(dedup.typed(df), dedup.GRAMS[0]), dedup.GRAMS[0], 2000)
    assert not pieces.filter("data IS NOT NULL").isEmpty()
    assert found(df, shard_bytes=2000) == brute(rows)


def test_copies_and_repeats_inside_a_text(spark):
    text = "".join(f"word{i} " for i in range(60))
    rows = [(3, text), (1, text), (9, text + text), (2, text[:99]), (4, "z" * 5000), (5, "ab" * 4000),
            (6, "x" + text[50:300]), (-7, text[100:230])]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_nulls_empty_and_equal_rows(spark):
    text = "".join(f"{i}, " for i in range(80))
    rows = [(None, text), (1, None), (2, ""), (5, text), (5, text), (6, text[:100]), (7, "ü" * 60), (8, "ü" * 60)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_very_long_text_among_short_ones(spark):
    rng = random.Random(6)
    long = " ".join(str(rng.randrange(10 ** 6)) for _ in range(60_000))
    rows = [(1, long[5000:9000]), (2, long), (3, long[300_000:300_400] + "!")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    rows = passages(4, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    assert dedup.report(df.limit(0)).collect() == []
    more = df.withColumn("id", F.lit("x")).withColumn("data", F.lit(3)).withColumn("core", F.lit(True))
    assert found(more.withColumn("start", F.lit(9))) == brute(rows)


def test_query_against_brute_force_on_whole_table(spark):
    rows = [tuple(r) for r in common.table(spark, SF, "documents", "doc_id", "text").collect()]
    got = queries.QUERIES["op12_suffix_dedup"](spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert sum(r.n_removed for r in got) > 0
