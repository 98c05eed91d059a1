import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SF
from jobspark.llm import conversation_repair as repair, queries

SCHEMA = "conv_id long, turn int, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
BLANKS = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        ids = [" " if x is None else str(x) for x in (conv, turn)]
        drawn = zlib.crc32(":".join(ids).encode()) % 20
        if drawn == 0:
            continue
        if drawn == 1:
            text = ""
        if drawn == 2:
            text = "".join(c for c in text if c not in ".!?")
        if drawn == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if drawn == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen
                   else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Cost, audit and text: the least of all edit sequences, column by column."""
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def closed(states):
        todo = list(states)
        while todo:
            end = todo.pop()
            cost, audit, lines = states[end]
            new = cost + 5, audit + "I", lines + [names[follows[end]] + ":"]
            if follows[end] not in states or new < states[follows[end]]:
                states[follows[end]] = new
                todo.append(follows[end])
        return states

    states = closed({"": (0, "", [])})
    for (_, _, role, text), mark in zip(rows, marks):
        step = {}

        def offer(end, new):
            step[end] = min(step.get(end, new), new)

        for end, (cost, audit, lines) in states.items():
            offer(end, (cost + 2, audit + "D", lines))
            if mark not in ("blank", "duplicate"):
                extra = 5 if mark == "truncated" else 0
                to = follows[end]
                if role[:1] == to:
                    offer(to, (cost + extra, audit + "K", lines + [f"{role}:{text}"]))
                if role[:1] == "s" and end == "":
                    offer("s", (cost + extra, audit + "K", lines + [f"{role}:{text}"]))
                offer(to, (cost + extra + 1, audit + "R", lines + [f"{names[to]}:{text}"]))
        states = closed(step)
    return min(states[end] for end in ("", "a") if end in states)


def expected(given):
    out = []
    for conv in {r[0] for r in given}:
        rows = sorted(damage([r for r in given if r[0] == conv]),
                      key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        marks = faults(rows)
        turns = {r[1] for r in rows if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
        cost, audit, lines = cheapest(rows, marks)
        out.append((conv, gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines))))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in repair.report(df).select(*COLUMNS).collect()), key=repr)


def drawn_rows(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["Hi.", "Go on!", "What?", "cut off", "", "  \n", None, "end. \t", "ü?", "a\nb."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "anna"]
    rows = []
    for conv in [None, *range(conversations)]:
        turn = rng.randrange(3)
        for _ in range(rng.randrange(1, most)):
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(roles), rng.choice(texts)))
            turn += rng.choice([0, 1, 1, 1, 3])
    return rows


@pytest.mark.parametrize("seed,conversations,most", [(1, 150, 12), (2, 12, 90)])
def test_report_against_brute_force(spark, seed, conversations, most):
    rows = drawn_rows(seed, conversations, most)
    random.Random(seed).shuffle(rows)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == expected(rows)


def test_hot_conversation_over_many_tasks(spark):
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"line {rng.randrange(9000)}.") for t in range(9000)]
    rows += [(7, 50, "user", "same.")] * 500 + [(8, 1, "user", "Hm.")]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(16)) == expected(rows)


def test_conversation_without_rows_after_damage(spark):
    turn = next(t for t in range(200) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    assert found(spark.createDataFrame([(1, turn, "user", "Hi.")], SCHEMA)) == [
        (1, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_empty_table_and_clashing_columns(spark):
    rows = drawn_rows(4, 20, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    assert repair.report(df.limit(0)).collect() == []
    more = df.withColumn("key", F.lit("x")).withColumn("copies", F.lit(3)).withColumn("head", F.lit(True))
    assert found(more) == expected(rows)


def test_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "Yes.")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == expected(rows)


def test_repaired_rows_alternate_and_lose_nothing_whole(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    out = repair.repair(given).collect()
    talks = {}
    for r in sorted(out, key=lambda r: (repr(r.conv_id), r.at)):
        talks.setdefault(r.conv_id, []).append(r.role[0])
    assert talks
    for roles in talks.values():
        line = "".join(roles).removeprefix("s")
        assert line and line == "ua" * (len(line) // 2)


def test_query_returns_every_conversation(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    out = queries.QUERIES["op13_conversation_repair"](spark, SF)
    assert out.count() == given.select("conv_id").distinct().count()
