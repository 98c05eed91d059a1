import html
import re
import time

import pytest
from conftest import SF, rows
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from jobspark.functions import rules, text, vectors
from jobspark.plans import queries


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def many(spark, column, values, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


SPACES = ["a b", "  a ", "a\u0085b", "a\x0bb\x0cc", "a\x1cb\x1fc", "   ", "",
          "a  b\t\nc", "　x　"]


def test_clean_space_equals_split_and_join(spark):
    assert many(spark, text.clean_space("x"), SPACES) == [" ".join(s.split()) for s in SPACES]
    assert one(spark, text.clean_space("x"), None) is None


def test_strip(spark):
    values = SPACES + ["\n\ta b\u00a0", "\u2003"]
    assert many(spark, text.strip("x"), values) == [v.strip() for v in values]


def test_strip_knows_every_space_and_passes_over_inner_ones(spark):
    ends = spark.range(1, 0x3100).select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    kept = {r[0] for r in ends.filter(text.strip(F.concat("c", F.lit("x"), "c")) != "x").collect()}
    assert kept == {chr(i) for i in range(1, 0x3100) if chr(i).strip()}
    # 200 MB with a space after every word: a pattern would try at each.
    long = spark.range(400, numPartitions=8).select(
        F.repeat(F.lit("note "), 100_000).alias("x")).select(F.length(text.strip("x")).alias("n"))
    start = time.time()
    assert long.agg(F.min("n"), F.max("n")).first() == (499_999, 499_999)
    assert time.time() - start < 6


def test_validations_are_dealt_over_the_cores(spark):
    for query in (queries.contact_validation, queries.feedback_validation):
        assert "REPARTITION_BY_NUM" in query(spark, SF)._jdf.queryExecution().executedPlan().toString()


ALPHABET = st.text(alphabet="ab \t  \x1c\u0085é", max_size=30)


@settings(max_examples=15, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=40))
def test_length_rule_on_raw_text(spark, values):
    got = many(spark, text.cleaned_at_least("x", 8), values)
    assert got == [len(" ".join(v.split())) >= 8 for v in values]
    assert many(spark, text.has_text("x"), values) == [bool(v.split()) for v in values]


def test_length_rule_at_the_limit(spark):
    values = ["x" * 39, "x" * 40, "x" * 41, " " * 5 + "x" * 40 + " ", "x " * 20, "x " * 20 + "y"]
    assert many(spark, text.cleaned_at_least("x", 40), values) == [
        False, True, True, True, False, True]
    assert one(spark, text.cleaned_at_least("x", 40), None) is False


def test_words(spark):
    assert many(spark, text.words("x"), ["", "a", "a b", None]) == [0, 1, 2, 0]


HTML = [
    ("<p>Hello <b>big</b> world</p>", "Hello big world"),
    ("a<script>var x = '<p>no</p>';</script>b", "a b"),
    ("<style>p{}</style><!-- no <b> -->yes", "yes"),
    ("a &amp; b &lt;c&gt; &quot;d&quot; &copy;", 'a & b <c> "d" ©'),
    ("&amp;lt; &#38;lt; &#65; &#x42; &#x1F600;", "&lt; &lt; A B 😀"),
    ("&nosuch; & &middot;&nbsp;x", "&nosuch; & · x"),
    ('<a title="x>y" href=\'z>w\'>link</a>', "link"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<!DOCTYPE html><html><body>t</body></html>", "t"),
    ("<ul><li>one</li><li>two</li></ul>", "one two"),
    ("<template><p>hid</p></template>seen", "seen"),
    ("kept<!-- never closed <b>lost</b>", "kept"),
    ("kept<script>var never = 'closed';", "kept"),
    ("kept <a href='never closed", "kept"),
    ("", ""), (None, ""),
]


@pytest.mark.parametrize("source,expected", HTML)
def test_html_text(spark, source, expected):
    assert one(spark, text.html_text("x"), source) == expected


@pytest.mark.parametrize("unit", [
    "<!--", "<a ", '<a "', "<script>", "<script ", "<!", "< ", "&", "&amp;", " ", "<b>", '<a b="x" ',
    "<template>", "</", "please mention the word "])
def test_hostile_texts_take_linear_time(spark, unit):
    df = spark.createDataFrame([(unit * 60_000,)], "x string")
    start = time.perf_counter()
    df.select(text.cut_from(text.html_text("x"), "please mention the word")).collect()
    df.select(text.cleaned_at_least("x", 40), text.strip("x"), text.words(
        text.clean_space("x"))).collect()
    assert time.perf_counter() - start < 10


def test_comments_and_scripts_may_hold_each_other(spark):
    values = ["<p>a</p><script>if(a<!--b){}</script><p>tail</p>", "a<!-- <script> -->b<style>x</style>c"]
    assert many(spark, text.html_text("x"), values) == ["a tail", "a b c"]


def test_numbers_and_days_of_other_forms(spark):
    assert many(spark, text.to_number("x"), ["1d", "1f", "2.D ", "1e3", "-.5"]) == [None, None, None, 1000.0, -0.5]
    days = ["20240101", "2024-01-01T10", "2024-01-01T10+02:00", "2024010", "20241301"]
    assert many(spark, text.iso_text(text.parse_iso("x")), days) == [
        "2024-01-01T00:00:00.000000", "2024-01-01T10:00:00.000000", "2024-01-01T08:00:00.000000", None, None]


def test_unescape_agrees_with_standard_library(spark):
    values = ["&eacute;&Uuml;&euro;", "&amp;amp;", "&#8364; &hellip;", "plain", "&", "&;",
              "&copy 2024", "&copyright", "&notit;", "&#150;&#128;&#x93;", "&#65 &#x42.", "&nosuch;",
              "&notin; &not", "a&ampb"]
    assert many(spark, text.unescape("x"), values) == [html.unescape(v) for v in values]


def test_cut_from(spark):
    values = ["Good job. Please mention the word X\nand more", "PLEASE MENTION THE WORD", "none"]
    cut = re.compile("please mention the word.*", re.I | re.S)
    assert many(spark, text.cut_from("x", "please mention the word"), values) == [
        cut.sub("", v) for v in values]


def test_parse_iso(spark):
    values = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+05:00", "2024-01-02T03:04:05",
              "2024-01-02 03:04:05.25", "2024-01-02", "2024-01-02T03:04+0530", "soon", "",
              "2024", "2024-13-01", None]
    got = many(spark, text.iso_text(text.parse_iso("x")), values)
    assert got == [
        "2024-01-02T03:04:05.000000", "2024-01-01T22:04:05.000000",
        "2024-01-02T03:04:05.000000", "2024-01-02T03:04:05.250000",
        "2024-01-02T00:00:00.000000", "2024-01-01T21:34:00.000000",
        None, None, None, None, None]


def test_parse_iso_does_not_depend_on_the_session_zone(spark):
    seconds = F.unix_seconds(text.parse_iso("x"))
    before = one(spark, seconds, "2024-01-02T03:04:05")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert one(spark, seconds, "2024-01-02T03:04:05") == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_parse_day(spark):
    values = ["2024-02-29", "2023-02-29", "2024-2-9", "tomorrow", None]
    got = many(spark, text.parse_day("x").cast("string"), values)
    assert got == ["2024-02-29", None, None, None, None]


def test_matched_is_plain_substring(spark):
    terms = ("java", "javascript", "spark", "c++")
    assert one(spark, text.matched("x", terms), "JavaScript, PySpark") == [
        "java", "javascript", "spark"]
    assert one(spark, text.matched_words("x", terms), "JavaScript, PySpark, C++!") == [
        "javascript", "c++"]
    assert one(spark, text.matched("x", terms), None) == []


def test_flags_and_lists(spark):
    assert many(spark, text.flag("x"), ["1", "TRUE", "yes", "no", None]) == [
        True, True, True, False, False]
    items = [" a ", "", "b", "  "] + [str(i) for i in range(30)]
    got = one(spark, text.clean_list("x"), items, "array<string>")
    assert got == (["a", "b"] + [str(i) for i in range(30)])[:20]
    assert many(spark, text.to_number("x"), ["12.5", " 7 ", "abc", None]) == [
        12.5, 7.0, None, None]
    assert many(spark, text.looks_remote("x", F.lit(None)), ["REMOTE, DE", "Berlin", None]) == [
        True, False, False]


def test_vectors(spark):
    df = spark.createDataFrame(
        [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])],
        "a array<float>, b array<float>")
    got = [r[0] for r in df.select(vectors.cosine_distance("a", "b")).collect()]
    assert got[0] == pytest.approx(1 - 24 / 25) and got[1] is None
    assert [r[0] for r in df.select(vectors.has_dimension("a", 2)).collect()] == [True, True]
    values = [0.1, -2.0, 1e-7, 123456789.123, 0.0, 1.5e20]
    assert one(spark, vectors.literal("x"), values, "array<double>") == (
        "[" + ",".join(format(v, ".9g") for v in values) + "]")


def test_rules(spark):
    df = spark.createDataFrame(
        [("  ", "a@b.c", "applied", "2024-01-01"), ("abcd", "not-an-email", "waiting", "tomorrow"),
         ("ok", "@x", None, ""), ("ok", "x@", "offer", None)],
        "name string, email string, stage string, day string")
    checked = rules.check(df, [
        rules.required("name"), rules.at_most("name", 3), rules.email("email"),
        rules.one_of("stage", ["applied", "offer"], optional=True), rules.iso_day("day")])
    got = rows(checked.select("name", "errors"))
    assert ("  ", ["name is required."]) in got
    assert ("abcd", ["name must be 3 characters or fewer.", "Enter a valid email address.",
                     "stage must be one of: applied, offer",
                     "day must use YYYY-MM-DD."]) in got
    assert rules.rejected(checked).count() == 4 and rules.valid(checked).count() == 0
