"""Column functions over text. All of them stay inside the JVM."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

# Java's \s is ASCII only; this class equals the Unicode white space set.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def clean_space(text) -> Column:
    """Collapse runs of white space to one blank and trim."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


# The characters of that class.
_WHITE = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text) -> Column:
    """Without white space of any kind at both ends. Trimmed from the ends: a pattern would
    try every character between them."""
    return F.btrim(_c(text).cast("string"), F.lit(_WHITE))


_BLANK, _SOLID = r"[\s\x1c-\x1f]", r"[^\s\x1c-\x1f]"


def has_text(text) -> Column:
    """Whether anything but white space is there; cheaper than cleaning first."""
    return F.regexp_like(F.coalesce(_c(text), F.lit("")), F.lit(f"(?U){_SOLID}"))


def cleaned_at_least(text, n: int) -> Column:
    """Whether the cleaned text has ``n`` characters, read off the raw text.

    A filter on the cleaned text would be moved below the cleaning, which would then
    run twice. This looks no further than the n-th character.
    """
    unit = f"(?:{_SOLID}|{_BLANK}++(?={_SOLID}))"
    return F.regexp_like(
        F.coalesce(_c(text), F.lit("")), F.lit(f"(?U)^{_BLANK}*+{unit}{{{n}}}"))


def none_if_empty(text) -> Column:
    return F.nullif(_c(text), F.lit(""))


def first_filled(*texts) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[none_if_empty(t) for t in texts])


def words(text) -> Column:
    """Number of blank-separated words of an already cleaned text."""
    c = _c(text)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(0)).otherwise(
        F.size(F.split(c, " "))
    )


def cut_from(text, marker: str) -> Column:
    """Drop everything from the first ``marker`` (any case) to the end."""
    return F.regexp_replace(text, rf"(?is)\Q{marker}\E.*", "")


def preview(text, n: int) -> Column:
    return F.left(_c(text), F.lit(n))


def content_hash(text) -> Column:
    return F.sha2(_c(text), 256)


def looks_remote(*texts) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", *[_c(t) for t in texts])), F.lit("remote"))


def filled(*texts) -> Column:
    """Array of the texts that are not NULL; none of them may hold a line feed.

    Joined and split instead of filtered: compiled code, in which parts that the
    texts share (such as a lower-cased document) are made once.
    """
    joined = F.concat_ws("\n", *texts)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(
        F.split(joined, "\n"))


def matched(text, terms) -> Column:
    """Array of the terms that occur, as plain substrings, in lower-cased text."""
    hay = _lowered(text)
    return filled(*[F.when(F.contains(hay, F.lit(t)), F.lit(t)) for t in _terms(terms)])


def each(found: str, most: int) -> Column:
    """Explodes an array column of at most ``most`` items.

    Exploding the bare column would let the optimizer add a test for emptiness and move
    it below the column's own computation, which would then run again for the test.
    """
    return F.explode(F.slice(found, 1, most))


def matched_words(text, terms) -> Column:
    """Like :func:`matched`, but a term must not touch another word character."""
    hay = _lowered(text)
    return filled(*[
        F.when(F.contains(hay, F.lit(t))
               & F.regexp_like(hay, F.lit(rf"(?U)(?<!\w)\Q{t}\E(?!\w)")), F.lit(t))
        for t in _terms(terms)
    ])


def contains_any(text, terms) -> Column:
    hay = _lowered(text)
    found = F.lit(False)
    for t in _terms(terms):
        found = found | F.contains(hay, F.lit(t))
    return found


def flag(text) -> Column:
    """Text form of a switch: 1, true, yes in any case."""
    return F.lower(F.coalesce(_c(text), F.lit(""))).isin("1", "true", "yes")


def to_number(text) -> Column:
    """Text of a number, else NULL; a cast alone also takes Java's suffixes (``1d``, ``1f``)."""
    return F.when(~F.regexp_like(_c(text), F.lit(r"(?i)[0-9.][df]\s*$")),
                  _c(text).try_cast("double"))


def clean_list(items, most: int = 20) -> Column:
    """Strip the elements, drop blanks, keep the first ``most``."""
    trimmed = F.transform(_c(items), strip)
    return F.slice(F.filter(trimmed, lambda x: x != ""), 1, most)


_ISO = (
    r"^(?:\d{8}|\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?)?)$"
)
_ISO_ZONED = r"(Z|[+-]\d{2}:?\d{2})$"


def parse_iso(text) -> Column:
    """ISO-8601 text to an instant; text without an offset is UTC; else NULL.

    Days may lack their hyphens and times their minutes.
    The zone is made explicit, so the session time zone does not matter.
    """
    t = F.regexp_replace(_c(text), ",", ".")
    t = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    t = F.regexp_replace(t, r"^(.{10}[T ]\d{2})(Z|[+-]|$)", "$1:00$2")
    t = F.regexp_replace(t, r"(:\d{2}(?:\.\d+)?[+-]\d{2})(\d{2})$", "$1:$2")
    t = F.regexp_replace(t, r"^(.{10}[T ]\d{2}:\d{2})(Z|[+-]|$)", "$1:00$2")
    zoned = (
        F.when(F.length(t) == 10, F.concat(t, F.lit("T00:00:00Z")))
        .when(F.regexp_like(t, F.lit(_ISO_ZONED)), t)
        .otherwise(F.concat(t, F.lit("Z")))
    )
    return F.when(F.regexp_like(_c(text), F.lit(_ISO)), zoned).try_cast("timestamp")


def parse_day(text) -> Column:
    """``YYYY-MM-DD`` to a date; NULL when malformed."""
    t = _c(text)
    return F.when(F.regexp_like(t, F.lit(r"^\d{4}-\d{2}-\d{2}$")), t).try_cast("date")


def iso_text(ts) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


# Elements whose text is not page text, and markup that carries none. What is never closed
# runs to the end of the text, so that no start is tried in vain and time stays linear.
# One pattern for both, as either may hold the start of the other: the leftmost counts.
_HIDDEN = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<(script|style|template|rt|rp)\b[^>]*+(?:>|\z).*?(?:</\1\s*+>|\z)"
)
_TAG = (
    r"(?s)</?[a-zA-Z](?:[^>\"']++|\"[^\"]*+(?:\"|\z)|'[^']*+(?:'|\z))*+(?:>|\z)"
    r"|<![^>]*+(?:>|\z)|<\?[^>]*+(?:>|\z)"
)
# Names that the standard also reads without a semicolon, longer ones first.
_OPEN_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
_REFERENCE_OR_TEXT = (
    r"&(?:#[xX][0-9A-Fa-f]{1,6};?|#[0-9]{1,7};?|[A-Za-z][A-Za-z0-9]*;|(?:" + _OPEN_NAMES + r"))|[^&]+|&"
)
# Numbers that stand for characters of an older code page.
_OLD_NUMBERS = {n: bytes([n]).decode("cp1252") for n in range(128, 160)
                if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


# The standard's named references as one JSON literal, which Spark parses while planning.
# Lookups go through the names in turn, so the short, common ones come first.
_NAMED_REFERENCES = json.dumps({
    "&" + name: char for name, char in sorted(
        html5.items(), key=lambda x: (len(x[0]), x[0]))})


def strip_markup(html) -> Column:
    """Text nodes of an HTML text, parted by blanks; references still encoded."""
    t = F.regexp_replace(F.coalesce(_c(html), F.lit("")), _HIDDEN, " ")
    return F.regexp_replace(t, _TAG, " ")


def unescape(text) -> Column:
    """Decode the character references of a text, each one once."""
    t = _c(text)
    names = F.from_json(F.lit(_NAMED_REFERENCES), "map<string,string>")

    def char_of(code: Column) -> Column:
        known = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        hexed = F.lpad(F.hex(F.when(known, code)), 8, "0")
        old = F.try_element_at(
            F.create_map(*[F.lit(x) for pair in _OLD_NUMBERS.items() for x in pair]), code.cast("int"))
        return F.coalesce(old, F.decode(F.unhex(hexed), "UTF-32"))

    def opened(piece: Column) -> Column:
        """A name that holds a shorter one known without semicolon."""
        start = F.regexp_extract(piece, f"^&(?:{_OPEN_NAMES})", 0)
        return F.concat(F.try_element_at(names, start), F.substr(piece, F.length(start) + 1))

    def decoded(piece: Column) -> Column:
        digits = F.substring(piece, 4, 6)
        return F.coalesce(
            F.when(~F.startswith(piece, F.lit("&")) | (F.length(piece) == 1), piece)
            .when(F.regexp_like(piece, F.lit("^&#[xX]")),
                  char_of(F.conv(F.regexp_replace(digits, ";", ""), 16, 10).cast("long")))
            .when(F.startswith(piece, F.lit("&#")),
                  char_of(F.regexp_replace(piece, "[&#;]", "").try_cast("long")))
            .otherwise(F.coalesce(F.try_element_at(names, piece), opened(piece))),
            piece,
        )

    pieces = F.regexp_extract_all(t, F.lit(_REFERENCE_OR_TEXT), F.lit(0))
    return F.when(
        F.contains(t, F.lit("&")), F.array_join(F.transform(pieces, decoded), "")
    ).otherwise(t)


def html_text(html) -> Column:
    """Page text of an HTML text: markup removed, references decoded."""
    return clean_space(unescape(strip_markup(html)))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lowered(text) -> Column:
    return F.lower(F.coalesce(_c(text), F.lit("")))


def _terms(terms) -> list[str]:
    return [str(t).lower() for t in terms]
