"""Format-preserving pseudonyms of personal numbers and dates, with DataFrame functions only.

Card numbers with a right check digit, telephone numbers, IPv4 addresses and days are
replaced by another value of the same format. Among neighbouring groups of digits every run
of 13 to 19 digits may be a card number; the leftmost valid one wins, of these the longest. A keyed Feistel network permutes the values of
a format, so equal values get equal pseudonyms in all documents and different ones different
pseudonyms. E-mail addresses, which are no numbers, get a keyed hash as local part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
# Days are permuted inside their century, of which the middle one has all days of the product.
FIRST_DAYS, DAYS = {1850: 36524, 1950: 36525, 2050: 36524}, (75, 487)
WALK = 64  # steps through the permutation until a day fits; two in three do
YEAR = "(?:18[5-9]|19[0-9]|20[0-9]|21[0-4])[0-9]"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "day": rf"(?<![0-9-]){YEAR}-[01][0-9]-[0-3][0-9](?![0-9-])|(?<![0-9./-])(?:{YEAR}/[01]?[0-9]/[0-3]?[0-9]"
           rf"|{YEAR}\.[01]?[0-9]\.[0-3]?[0-9])(?![0-9]|[./-][0-9])",
    "written": r"(?<![0-9./-])(?:" + "|".join(rf"[0-3]?[0-9]{s}[0-3]?[0-9]{s}{YEAR}" for s in ("/", r"\.", "-"))
               + r")(?![0-9]|[./-][0-9])",
    "address": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+?[0-9]{1,3}(?:[ .-]|(?=\()))?(?:\(?[0-9]{3}\)?[ .-]|\([0-9]{3}\))[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
# Neighbouring groups of digits, 13 digits at least, up to what is one of the others.
PATTERNS["card"] = (
    r"(?<![0-9A-Za-z])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![A-Za-z])"
    rf"(?:[ -](?!{'|'.join(f'(?:{p})' for p in PATTERNS.values())})[0-9]++(?![A-Za-z]))*+")
CARD = (13, 19)
ANY = "|".join(PATTERNS.values())


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _long(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def feistel(left: Column, right: Column, n_left: Column, n_right: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the pairs of numbers below ``n_left`` and ``n_right``."""

    def noise(i: Column, other: Column, n: Column) -> Column:
        digest = F.sha2(F.concat_ws("/", F.lit(key), F.lit(kind), i.cast("string"), n_left.cast(
            "string"), n_right.cast("string"), other.cast("string")), 256)
        return F.pmod(_long(F.conv(F.left(digest, F.lit(12)), 16, 10)), n)

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, lambda acc, i: F.struct(
        F.when(i % 2 == 0, F.pmod(acc["l"] + noise(i, acc["r"], n_left), n_left)).otherwise(acc["l"]).alias("l"),
        F.when(i % 2 == 1, F.pmod(acc["r"] + noise(i, acc["l"], n_right), n_right)).otherwise(acc["r"]).alias("r")))


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Another string of as many digits (two at least)."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    done = feistel(_long(F.left(digits, half)), _long(F.right(digits, rest)), _power(half), _power(rest), key, kind)
    return _let(done, lambda x: F.concat(F.lpad(x["l"].cast("string"), half, "0"),
                                         F.lpad(x["r"].cast("string"), rest, "0")))


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits as the check of card numbers counts them, from the right."""
    each = F.split(F.reverse(digits), "")
    return F.aggregate(F.transform(each, lambda c, i: _long(c) * (1 + i % 2)), F.lit(0).cast("bigint"),
                       lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x))


def _in_format(value: Column, digits: Column) -> Column:
    """The digits one after the other where the value has its own."""
    at = F.sequence(F.lit(1), F.length(value))
    return F.array_join(F.transform(at, lambda p: _let(F.substr(value, p, F.lit(1)), lambda c: F.when(
        F.regexp_like(c, F.lit("[0-9]")), F.substr(digits, F.length(only_digits(F.left(value, p))), F.lit(1))).otherwise(c))), "")


def _numbers(value: Column) -> Column:
    return F.split(value, "[./-]")


def _ymd(value: Column) -> Column:
    """The day of year, month and day; NULL if there is none."""
    return F.concat_ws("-", _numbers(value)).try_cast("date")


def _dmy(value: Column) -> Column:
    return F.concat_ws("-", F.reverse(_numbers(value))).try_cast("date")


def _mdy(value: Column) -> Column:
    return _let(_numbers(value), lambda x: F.concat_ws(
        "-", F.get(x, F.lit(2)), F.get(x, F.lit(0)), F.get(x, F.lit(1))).try_cast("date"))


def cards(value: Column) -> Column:
    """``(s, e)`` of the valid card numbers among groups of digits, from the left: the place
    of the first character, from one, and that after the last."""

    def longest(groups: Column, i: Column) -> Column:
        """Length of the longest valid number that begins with group ``i``, or NULL."""
        some = F.slice(groups, i + 1, F.lit(CARD[1]))
        joined = F.transform(F.sequence(F.lit(1), F.size(some)), lambda j: F.array_join(F.slice(some, F.lit(1), j), ""))
        fit = F.filter(F.transform(joined, lambda d, j: F.struct(d.alias("d"), j.alias("gaps"))), lambda x: (
            F.length(x["d"]).between(*CARD)) & (luhn_sum(x["d"]) % 10 == 0))
        return F.array_max(F.transform(fit, lambda x: F.length(x["d"]) + x["gaps"]))

    def all_of(groups: Column) -> Column:
        start = F.struct(F.lit(1).alias("at"), F.lit(1).alias("free"), F.expr(
            "cast(array() as array<struct<s: int, e: int>>)").alias("found"))

        def step(acc: Column, i: Column) -> Column:
            after = acc["at"] + F.length(F.get(groups, i)) + 1
            here = F.when(acc["at"] >= acc["free"], longest(groups, i))
            return _let(here, lambda n: F.when(n.isNull(), F.struct(
                after.alias("at"), acc["free"].alias("free"), acc["found"].alias("found"))).otherwise(F.struct(
                    after.alias("at"), (acc["at"] + n).alias("free"), F.array_append(acc["found"], F.struct(
                        acc["at"].alias("s"), (acc["at"] + n).alias("e"))).alias("found"))))

        return F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, step)["found"]

    return _let(F.split(value, "[ -]"), all_of)


def kind_of(value: Column) -> Column:
    """What a found value is; NULL where it is not valid. Groups of digits may hold cards."""
    is_kind = {k: F.regexp_like(value, F.lit(f"^(?:{p})$")) for k, p in PATTERNS.items() if k != "card"}
    octets = F.split(value, r"\.")
    return (
        F.when(is_kind["email"], F.lit("email"))
        .when(is_kind["day"] & _ymd(value).isNotNull(), F.lit("day"))
        .when(is_kind["written"] & F.coalesce(_dmy(value), _mdy(value)).isNotNull(), F.lit("written"))
        .when(is_kind["address"] & ~F.exists(octets, lambda x: _long(x) > 255), F.lit("address"))
        .when(is_kind["phone"], F.lit("phone"))
        .when(F.regexp_like(value, F.lit("^[0-9](?:[ -]?[0-9]){12,}+$")), F.lit("card")))


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    def card(v: Column) -> Column:
        digits = only_digits(v)
        body = permuted_digits(F.left(digits, F.length(digits) - 1), key, "card")
        return _let(body, lambda b: _in_format(v, F.concat(b, F.pmod(
            -luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))))

    def groups(v: Column) -> Column:
        def replaced(found: Column) -> Column:
            def before(i: Column) -> Column:
                return F.when(i == 0, F.lit(1)).otherwise(F.get(found, i - 1)["e"])

            return F.concat(F.array_join(F.transform(found, lambda x, i: F.concat(
                F.substr(v, before(i), x["s"] - before(i)), card(F.substr(v, x["s"], x["e"] - x["s"])))), ""),
                F.substr(v, before(F.size(found))))

        return _let(cards(v), replaced)

    def other_day(d: Column, late: Column) -> Column:
        """Another day of the century; if ``late``, one after the twelfth of its month."""
        firsts = [F.lit(f"{y}-01-01").cast("date") for y in FIRST_DAYS]
        first = F.when(d < firsts[1], firsts[0]).when(d < firsts[2], firsts[1]).otherwise(firsts[2])
        size = F.when((d >= firsts[1]) & (d < firsts[2]), F.lit(FIRST_DAYS[1950])).otherwise(F.lit(FIRST_DAYS[1850]))

        def step(acc: Column, _: Column) -> Column:
            done = feistel(acc["n"] % DAYS[0], F.floor(acc["n"] / DAYS[0]), F.lit(DAYS[0]), F.lit(DAYS[1]), key, "day")
            return F.when(acc["fits"], acc).otherwise(_let(
                _let(done, lambda x: x["l"] + x["r"] * DAYS[0]), lambda n: F.struct(n.alias("n"), (
                    (n < size) & (~late | (F.dayofmonth(F.date_add(first, n.cast("int"))) > 12))).alias("fits"))))

        start = F.struct(F.datediff(d, first).cast("bigint").alias("n"), F.lit(False).alias("fits"))
        return _let(F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, step),
                    lambda x: F.date_add(first, x["n"].cast("int")))

    def in_form(v: Column, d: Column, order: tuple[str, str, str]) -> Column:
        """The day with the separator of ``v``, and as short as that where a number is."""
        short = F.exists(_numbers(v), lambda x: F.length(x) == 1)
        sign = F.regexp_extract(v, "[./-]", 0)
        part = {"y": F.year(d).cast("string")} | {k: F.when(short, n.cast("string")).otherwise(
            F.lpad(n.cast("string"), 2, "0")) for k, n in (("m", F.month(d)), ("d", F.dayofmonth(d)))}
        return F.concat(part[order[0]], sign, part[order[1]], sign, part[order[2]])

    def day(v: Column) -> Column:
        return _let(other_day(_ymd(v), F.lit(False)), lambda d: in_form(v, d, ("y", "m", "d")))

    def written(v: Column) -> Column:
        # What can be day and month is; the rest keeps a day after the twelfth in the second place.
        late = _dmy(v).isNull()
        return _let(other_day(F.coalesce(_dmy(v), _mdy(v)), late), lambda d: F.when(
            late, in_form(v, d, ("m", "d", "y"))).otherwise(in_form(v, d, ("d", "m", "y"))))

    def address(v: Column) -> Column:
        o = F.transform(F.split(v, r"\."), _long)
        done = feistel(F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)),
                       F.lit(65536), F.lit(65536), key, "address")
        return _let(done, lambda x: F.concat_ws(".", *[
            F.floor(x[side] / 256).cast("string") if high else (x[side] % 256).cast("string")
            for side in ("l", "r") for high in (True, False)]))

    email = F.concat(F.lit("u"), F.left(F.sha2(F.concat(F.lit(f"{key}/email/"), value), 256), F.lit(16)),
                     F.lit("@"), F.substring_index(value, "@", -1))
    return (
        F.when(kind == "card", groups(value)).when(kind == "day", day(value)).when(kind == "written", written(value))
        .when(kind == "address", address(value))
        .when(kind == "phone", _in_format(value, permuted_digits(only_digits(value), key, "phone")))
        .when(kind == "email", email).otherwise(value))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_values, text)``: the text with pseudonyms for all valid values in it.

    A NULL text stays NULL and has no value. Numbers that fail their check stay as they are.
    Repeated rows and NULL ids stay; other columns are ignored; an empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    found = docs.select(F.col(id_col), text.alias("text"), F.transform(
        F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANY), F.lit(0)),
        lambda v: _let(kind_of(v), lambda k: F.struct(F.when(k == "card", F.size(cards(v))).when(
            k.isNotNull(), F.lit(1)).otherwise(F.lit(0)).alias("n"), pseudonym(v, k, key).alias("new")))).alias("values"))
    parts = F.zip_with(F.split("text", ANY), "values", lambda a, v: F.concat(
        F.coalesce(a, F.lit("")), F.coalesce(v["new"], F.lit(""))))
    return found.select(
        id_col, F.aggregate("values", F.lit(0).cast("bigint"), lambda acc, v: acc + v["n"]).alias("n_values"),
        F.when(F.size("values") > 0, F.array_join(parts, "")).otherwise(F.col("text")).alias("text"))
