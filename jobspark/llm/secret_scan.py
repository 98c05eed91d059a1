"""Secret scan: fixed patterns, and strings that a primed compressor cannot foresee.

Besides the pattern kinds, a string in a sensitive context (a word such as "secret" or
"bearer" shortly before it) is measured by its marginal compressed size: zstandard, primed
with a dictionary of usual identifiers, compresses the text around the string without and
with it, and with random strings of the same length and alphabet in its place. A string that
costs nearly what those cost repeats nothing of the code around it nor of usual names, and is
reported as ``novel``. Occurrences of the string that follow a sensitive word too are no part
of the text around it. A private key goes on over the lines of its block.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
import string as letters
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

# Kinds, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
LEAST = {"assign": 6, "access": 20, "hex": 24}
# What an assignment holds at least; a text without any needs no pattern.
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

NOVEL = "novel"
SENSITIVE = (
    "password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "api key",
    "api-key", "access key", "access_key", "accesskey", "private key", "private_key", "bearer",
    "authorization", "credential", "client_id", "signature", "session_id", "webhook",
)
NEAR = 32  # code points between the sensitive word and the string
AROUND = 400  # code points of context on either side
LEAST_NOVEL = 12
NOVELTY = 0.9  # of what a random string costs, less
SPARE = 2  # bytes that short matches may save in a random string
DRAWS, ENOUGH = 4, 1000  # random strings, or so many characters of them
LEAST_PIECE = 20  # of a string with dots, such as the parts of a signed token
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{12,}")
HEX_DIGITS = re.compile(r"[0-9A-Fa-f]+")
# Lower case of A-Z alone keeps every place.
LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
VARIED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])")
# A private key: its first line, and the lines after it, broken or with written-out breaks.
PRIVATE = re.compile(r"private[ _-]?key", re.IGNORECASE)
BREAK = re.compile(r"""(?:\\[rn]|[\s"',>#*|]|\+(?=[\s"']))+""")
ARMOUR = re.compile(
    rf"private key[ A-Z]*-{{5}}(?:{BREAK.pattern}[A-Za-z-]+:[^\n\\]*(?=\n|\\[rn]))*{BREAK.pattern}", re.IGNORECASE)
LINE = re.compile(r"[A-Za-z0-9+/=_]+(?:-[A-Za-z0-9+/=_]+)*")

# Identifiers and values that code usually has around secrets.
USUAL = " ".join(SENSITIVE) + (
    " example placeholder changeme your_api_key_here insert_token_here xxxxxxxxxxxxxxxx"
    " 0000000000000000 1234567890 0123456789abcdef abcdefghijklmnopqrstuvwxyz"
    " ABCDEFGHIJKLMNOPQRSTUVWXYZ undefined null none true false localhost 127.0.0.1"
    " os.environ.get( process.env. getenv( System.getProperty( config. settings. self."
    " username user_id client_id client_secret refresh_token access_token id_token"
    " aws_access_key_id aws_secret_access_key database_url connection_string http:// https://"
    " www. .com .org .net application/json Content-Type: Authorization: Bearer Basic import"
    " return function const var let public static final String int version encoding utf-8"
    " sha256 sha1 md5 base64 digest checksum hash uuid version1 2023-01-01 2024-01-01"
)

Span = tuple[str, int, int]
DIGITS_16 = (letters.digits + "abcdef", letters.digits + "ABCDEF", letters.hexdigits)
CLASSES = (letters.ascii_lowercase, letters.ascii_uppercase, letters.digits)


def alphabet(string: str) -> str:
    """What a random string like this one is drawn from: base 16, or the classes of
    characters that it has, and its other characters."""
    if HEX_DIGITS.fullmatch(string):
        return next(x for x in DIGITS_16 if set(string) <= set(x))
    used = set(string)
    return "".join(x for x in CLASSES if used & set(x)) + "".join(sorted(used.difference(*CLASSES)))


class Scanner:
    """Finds secrets in one text after the other."""

    def __init__(self) -> None:
        primed = zstandard.ZstdCompressionDict(
            USUAL.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(
            level=9, dict_data=primed, write_content_size=False, write_dict_id=False)

    def base(self, text: str, low: str) -> list[Span]:
        spans = []
        if any(h in low for h in HINTS):
            spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text)
                      if len(m[2]) >= LEAST["assign"]]
        if "AKIA" in text:
            spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)
                      if len(m[0]) >= LEAST["access"]]
        spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
        return spans

    def context(self, text: str, low: str, start: int, end: int) -> str:
        """The text around a string, without its equals that follow a sensitive word."""
        string = text[start:end]
        out = []
        for first, last in ((max(0, start - AROUND), start), (end, min(end + AROUND, len(text)))):
            at = first
            # Equals that the ends of the context cut count too.
            reach = (max(0, first - len(string)), start) if last == start else (end, last + len(string))
            equal = text.find(string, *reach)
            while 0 <= equal < last:
                before = low[max(0, equal - NEAR - LEAST_NOVEL):equal]
                if any(word in before for word in SENSITIVE):
                    out.append(text[at:max(at, equal)])
                    at = max(at, equal + len(string))
                equal = text.find(string, equal + len(string), reach[1])
            out.append(text[at:last])
        return "".join(out)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode()))

    def is_novel(self, string: str, around: str) -> bool:
        """Whether the string adds about as many compressed bytes as a random one."""
        if len(string) < LEAST_NOVEL or not VARIED.match(string):
            return False
        without = self.size(around)
        own = self.size(around + string) - without
        draw = random.Random(len(string))
        draws = max(1, min(DRAWS, ENOUGH // len(string)))
        chars = alphabet(string)
        cost = sum(self.size(around + "".join(draw.choices(chars, k=len(string)))) - without
                   for _ in range(draws)) / draws
        return own >= NOVELTY * cost - SPARE

    def lines(self, text: str, begin: int, armour: bool) -> tuple[int, list[str]]:
        """End and lines of a private key that begins there. Behind the first line of an
        armour whatever stands in lines of its own belongs to it; else lines are as long as
        the first one, but for the last."""
        out: list[str] = []
        stop = place = begin
        while line := LINE.match(text, place):
            one, gap = line[0], BREAK.match(text, line.end())
            broken = gap is not None and ("\n" in gap[0] or "\\n" in gap[0])
            closed = text.startswith("-----", gap.end() if gap else line.end())
            last = not armour and bool(out) and len(one) < len(out[0])
            if out and not (closed or broken or len(one) == len(out[0]) or last):
                break
            if not armour and out and len(one) > len(out[0]) or last and not (
                    closed or VARIED.match(one) or one.endswith("=")):
                break
            out.append(one)
            stop = line.end()
            if closed or last or not broken:
                break
            place = gap.end()
        return stop, out

    def private(self, text: str, word: re.Match) -> tuple[list[str], int, int] | None:
        """Lines, start and end of the key after a private-key word."""
        if armour := ARMOUR.match(text, word.start()):
            stop, lines = self.lines(text, armour.end(), True)
            return (lines, armour.end(), stop) if lines else None
        for near in CANDIDATE.finditer(text, word.end(), word.end() + NEAR + LEAST_NOVEL):
            begin = near.start() + len(near[0]) - len(near[0].lstrip("=.~_-"))
            stop, lines = self.lines(text, begin, False)
            if len(lines) > 1:
                return lines, begin, stop
        return None

    def novel(self, text: str, low: str, known: list[Span]) -> list[Span]:
        found: list[Span] = []
        taken: list[tuple[int, int]] = []  # places of what is found, sorted
        measured: set[int] = set()
        # Spans of kinds may lie in each other: beside the starts, the furthest end so far.
        known = sorted(known, key=lambda s: s[1])
        starts = [a for _, a, _ in known]
        furthest = list(itertools.accumulate((b for _, _, b in known), max))

        def meets_known(start: int, end: int) -> bool:
            at = bisect.bisect_left(starts, end)
            return at > 0 and start < furthest[at - 1]

        def take(start: int, end: int, strings: list[str]) -> None:
            around = self.context(text, low, start, end)
            if any(self.is_novel(x, around) for x in strings):
                found.append((NOVEL, start, end))
                bisect.insort(taken, (start, end))

        def covered(start: int) -> bool:
            at = bisect.bisect(taken, (start, len(text)))
            return at > 0 and start < taken[at - 1][1]

        for word in PRIVATE.finditer(text):
            key = None if covered(word.start()) else self.private(text, word)
            if key and key[1] not in measured:
                measured.add(key[1])
                # Some kinds of keys begin with fixed lines: one novel line is enough.
                take(key[1], key[2], ["".join(key[0]), *key[0]])
        measured.clear()  # a single line may be novel where the lines are not
        for word in SENSITIVE:
            at = low.find(word)
            while at >= 0:
                stop = at + len(word)
                for near in CANDIDATE.finditer(text, stop, stop + NEAR + LEAST_NOVEL):
                    start = near.start()
                    if start in measured or covered(start):
                        continue
                    measured.add(start)
                    string = CANDIDATE.match(text, start)[0].rstrip(".")
                    end = start + len(string)
                    if len(string) >= LEAST_NOVEL and VARIED.match(string) and not meets_known(
                            start, end):
                        parts = [x for x in string.split(".") if LEAST_PIECE <= len(x) < len(string)]
                        take(start, end, [string, *parts])
                at = low.find(word, stop)
        return found

    def scan(self, text: str) -> tuple[list[Span], list[Span]]:
        """Pattern spans and novel spans, each by start and kind; places in code points."""
        low = text.lower()
        if len(low) != len(text):  # some letters have a longer lower case
            low = text.translate(LOWER)
        base = self.base(text, low)
        order = (*KINDS, NOVEL)
        key = lambda s: (s[1], order.index(s[0]))
        return sorted(base, key=key), sorted(self.novel(text, low, base), key=key)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, counts per pattern kind, ``base_sha256``, ``spans`` (text
    form) and ``found`` (array of kind, start, end).

    A NULL text is an empty one and has no span. Repeated rows and NULL ids stay; other
    columns of ``docs`` are ignored; an empty table gives no rows. Spans of one start are
    ordered by kind: assign, access, hex, novel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        order = (*KINDS, NOVEL)
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, texts, found = [], [], []
            for text in batch.column(1).to_pylist():
                base, novel = scanner.scan(text or "")
                for k, name in enumerate(KINDS):
                    counts[k].append(sum(s[0] == name for s in base))
                every = sorted(base + novel, key=lambda s: (s[1], order.index(s[0])))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                texts.append(joined(every))
                found.append([{"kind": a, "start": b, "end": c} for a, b, c in every])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array(digests, pa.string()), pa.array(texts, pa.string()),
                 pa.array(found, kind)],
                [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {id_type}, n_assign bigint, n_access bigint, n_hex bigint, "
             "base_sha256 string, spans string, "
             "found array<struct<kind: string, start: bigint, end: bigint>>")


def masked(text: str, spans: list[Span], mask: str = "[secret]") -> str:
    """The text with every span, overlapping ones as one, replaced by ``mask``."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, secrets in ``text_col`` masked. NULL
    texts stay NULL."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            clean = []
            for text in batch.column(at).to_pylist():
                if text:
                    base, novel = scanner.scan(text)
                    text = masked(text, base + novel) if base or novel else text
                clean.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(clean, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
