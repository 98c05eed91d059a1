"""Pseudonyms: bijective, of the same format, equal for equal values."""

import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from jobspark.llm import pseudonyms


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def replaced(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("values", F.lit("x"))
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymise(df, "k").collect()}
    return [got[i]["text"] for i in range(len(texts))], [got[i]["n_values"] for i in range(len(texts))]


def test_values_keep_their_format_and_link(spark):
    card = "4111 1111 1111 1111"
    texts = [f"a {card}, b", f"{card}|{card}", "call +1 555 123-4567 now", "ip 10.20.30.40.", "on 2001-02-28", "x.y@mail.example.com!"]
    new, n = replaced(spark, texts)
    assert n == [1, 2, 1, 1, 1, 1]
    other = new[0][2:-3]
    assert other != card and luhn(other.replace(" ", "")) and re.fullmatch(r"(\d{4} ){3}\d{4}", other)
    assert new[1] == f"{other}|{other}"
    assert re.fullmatch(r"call \+\d \d{3} \d{3}-\d{4} now", new[2]) and new[2] != texts[2]
    assert all(int(x) < 256 for x in new[3][3:-1].split(".")) and new[3] != texts[3]
    assert date.fromisoformat(new[4][3:]) and new[4] != texts[4]
    assert re.fullmatch(r"u[0-9a-f]{16}@mail\.example\.com!", new[5])


def test_invalid_values_nulls_and_empty_stay(spark):
    texts = ["4111111111111112", "300.1.1.1", "2001-02-30", None, "", "plain 12 text", "v1.2.3.4.5"]
    new, n = replaced(spark, texts)
    assert new == texts and n == [0] * len(texts)
    assert pseudonyms.pseudonymise(spark.createDataFrame([], "doc_id bigint, text string"), "k").collect() == []


def test_days_are_permuted(spark):
    days = [(date(1950, 1, 1) + timedelta(i)).isoformat() for i in range(36525)]
    df = spark.createDataFrame([(d,) for d in days], "d string").select(
        pseudonyms.pseudonym(F.col("d"), F.lit("day"), "k").alias("d"))
    assert {r[0] for r in df.collect()} == set(days)


def test_no_python_runs(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    plan = pseudonyms.pseudonymise(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_cards_among_other_digits(spark):
    solid, spaced = "4111111111111111", "4111 1111 1111 1111"
    texts = [solid, f"{spaced} 123", f"{solid} 12/27", f"ref 2 {solid}", f"{spaced} 5500-0000-0000-0004",
             f"{spaced} 555-123-4567", f"{spaced} 10.0.0.1", f"1 22 333 {spaced} 12x", f"{spaced} 2001-02-28",
             "12 " * 30 + solid, "4111 1111 1111 1112", "7" * 25, f"{solid} 12.ab@x.de"]
    new, n = replaced(spark, texts)
    other = new[0]
    wide = " ".join(other[i:i + 4] for i in range(0, 16, 4))
    assert other != solid and luhn(other) and n[0] == 1
    assert new[1:4] == [f"{wide} 123", f"{other} 12/27", f"ref 2 {other}"] and n[1:4] == [1, 1, 1]
    assert new[4].startswith(f"{wide} ") and luhn(re.sub("[^0-9]", "", new[4][20:])) and n[4] == 2
    for i, rest in ((5, "555-123-4567"), (6, "10.0.0.1"), (8, "2001-02-28"), (12, "12.ab@x.de")):
        assert new[i].startswith((wide, other)) and rest not in new[i] and n[i] == 2
    assert solid not in new[9] and spaced not in new[7]
    assert new[10:12] == texts[10:12] and n[10:12] == [0, 0]


def test_phones_without_country_code_and_other_days(spark):
    texts = ["call (555) 123-4567!", "555-123-4567", "(555)123-4567", "1931-05-06", "31/12/1980", "12.31.1980", "1980-12-31",
             "5/6/1980.", "1980/12/31", "31-12-1980", "31.13.1980", "2101-02-29"]
    new, n = replaced(spark, texts)
    assert n == [1] * 10 + [0, 0] and new[10:] == texts[10:]
    digits = [re.sub("[^0-9]", "", x) for x in new]
    assert digits[0] == digits[1] == digits[2] != "5551234567" and re.fullmatch(r"call \(\d{3}\) \d{3}-\d{4}!", new[0])
    assert new[3] != texts[3] and date(1850, 1, 1) <= date.fromisoformat(new[3]) < date(1950, 1, 1)
    y, m, d = new[6].split("-")
    assert new[4] == f"{d}/{m}/{y}" and new[8] == f"{y}/{m}/{d}" and new[9] == f"{d}-{m}-{y}"
    m, d, y = map(int, new[5].split("."))
    assert date(y, m, d) != date(1980, 12, 31) and d > 12
    assert re.fullmatch(r"\d{1,2}/\d{1,2}/\d{4}\.", new[7])


def test_other_days_are_permuted(spark):
    for first, form in ((1850, "%Y-%m-%d"), (1950, "%m/%d/%Y"), (2050, "%d.%m.%Y")):
        days = [date(first, 1, 1) + timedelta(i) for i in range((date(first + 100, 1, 1) - date(first, 1, 1)).days)]
        days = {d.strftime(form) for d in days if form != "%m/%d/%Y" or d.day > 12}
        kind = "day" if form[1] == "Y" else "written"
        df = spark.createDataFrame([(d,) for d in days], "d string").select(
            pseudonyms.pseudonym(F.col("d"), F.lit(kind), "k").alias("d"))
        assert {r[0] for r in df.collect()} == days


def test_mail_with_many_labels(spark):
    text = "x@" + "a." * 100_000 + "com end"
    out = pseudonyms.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k")
    assert out.count() == 1 and out.collect()
