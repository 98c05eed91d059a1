"""Repair of conversations whose turns are blank, repeated, cut off or out of order.

A conversation is a lattice: a column for every row and one after the last, in each column a node
for what the repaired text ended on (nothing, system, user, assistant). Arcs keep, rerole or delete
the row and lead to the next column; an insertion stays in its column. The cheapest repair is a
shortest path, found by the auction algorithm: nodes carry prices, a path grows from an origin
along an arc whose cost and price equal the price of its end, and is cut back by one node, whose
price rises, where there is none. Origins are taken from the last column to the first, so a path
ends at the first node whose price is known to be final. Final prices tell the tight arcs, and
among these the least letters are followed from the start.

Rows are spread by (conversation, turn), so one conversation may hold any share of them; what is
brought together per conversation is one byte per row, as the audit that is returned has one, too.
The digest of a repaired conversation is a chain over its text, which one task streams in order.

Defined results: NULL roles and texts count as one space (a blank text), a NULL turn comes first
and is ``" "`` where ids and turns are hashed, a NULL conv_id is a conversation of its own. Rows of
one turn are ordered by role and digest of the text; equal rows are repetitions. A role without
any character fits nowhere. A conversation without rows has zeros, an empty audit and the digest
of nothing; an empty table gives no rows. Other columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import common, merkle

# Costs of edits.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
# What a repaired conversation ends on.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
# What may follow, beside a system turn at the start.
FOLLOWS = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
FAULTS = ("whole", "truncated", "blank", "duplicate")
BLANKS = " \t\n\x0b\x0c\r"
# Columns between two prices that are kept for the way back.
BLOCK = 4096
NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


# Rows ---------------------------------------------------------------------------------

def typed(rows: DataFrame) -> DataFrame:
    """``key, turn, role, text, drawn`` without NULLs but in turn; ``key`` is "" for no id."""
    as_text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    return rows.select(
        F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit("")).alias("key"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
        (F.crc32(F.concat_ws(":", *as_text).cast("binary")) % 20).alias("drawn"))


def as_given(rows: DataFrame) -> DataFrame:
    """Rows as they are, each once."""
    return typed(rows).select("key", "turn", "role", "text", F.lit(1).alias("copies"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults drawn from the check sum of their id and turn: 0 drops the row, 1 empties
    the text, 2 takes its ends of sentences, 3 repeats it, 4 makes it a user's."""
    drawn = F.col("drawn")
    return typed(rows).select(
        "key", "turn", F.when(drawn == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(drawn == 1, "").when(drawn == 2, F.translate("text", ".!?", "")).otherwise(
            F.col("text")).alias("text"),
        F.when(drawn == 0, 0).when(drawn == 3, 2).otherwise(1).alias("copies"))


def digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def symbol(fault: Column) -> Column:
    """One letter for a row: its role's initial and its fault."""
    initial = F.instr(F.lit(INITIALS), F.left("role", F.lit(1)))
    known = F.when(F.left("role", F.lit(1)) == "", 0).otherwise(initial)
    return F.char(F.lit(65) + known * len(FAULTS) + fault)


def symbols(rows: DataFrame) -> DataFrame:
    """``key, turn, role, digest, held, first, more``: different rows of a conversation, how often
    each is held, and the letters of its first and of its further copies."""
    ends = F.rtrim("text", F.lit(BLANKS))
    slim = rows.select(
        "key", "turn", F.when(F.col("copies") > 0, F.col("role")).otherwise("").alias("role"),
        F.when(F.col("copies") > 0, digest()).alias("digest"), "copies",
        F.when(ends == "", 2).when(F.right(ends, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1).alias("fault"))
    held = common.written(slim.groupBy("key", "turn", "role", "digest").agg(
        F.sum("copies").alias("held"), F.first("fault").alias("fault")), "conversation-rows")
    seen = held.filter("held > 0").groupBy("key", "role", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("given"), "turn")).alias("seen"))
    both = held.join(seen, ["key", "role", "digest"], "left")
    blank = F.col("fault") == 2
    repeated = F.when(blank, 2).otherwise(3)
    return both.select(
        "key", "turn", "role", "digest", "held",
        symbol(F.when(~blank & ~F.col("turn").eqNullSafe(F.col("seen.turn")), 3).otherwise(F.col("fault"))).alias("first"),
        symbol(repeated).alias("more"))


def strings(rows: DataFrame) -> DataFrame:
    """``key, pieces``: a conversation's letters in order, a piece per task that had some of them,
    each with its number of turns, the least and the greatest."""
    order = ["key", F.col("turn").asc_nulls_first(), "role", "digest"]
    kind = "key string, part int, turns long, low long, high long, letters string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, at = TaskContext.get().partitionId(), [], None

        def close() -> None:
            if at is not None:
                done.append((at, part, turns, low, high, "".join(letters)))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(list(zip(*done)) or [[]] * 6, TYPES)],
                ["key", "part", "turns", "low", "high", "letters"])

        for batch in batches:
            for key, turn, held, first, more in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at:
                    close()
                    at, turns, low, high, letters = key, 0, None, None, []
                if held:
                    letters.append(first + more * (held - 1))
                    if turn is not None and turn != high:
                        turns, low, high = turns + 1, turn if low is None else low, turn
            yield out()
            done.clear()
        close()
        yield out()

    TYPES = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    runs = symbols(rows).repartitionByRange(*order).sortWithinPartitions(*order).select(
        "key", "turn", "held", "first", "more").mapInArrow(run, kind)
    return runs.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("part", "turns", "low", "high", "letters"))).alias("pieces"))


# The lattice ----------------------------------------------------------------------------

def arcs(letter: str | None, node: int) -> list[tuple[str, int, int, bool]]:
    """``(edit, cost, end, whether in the next column)``; no letter: the column after the last."""
    follows = FOLLOWS[node]
    out = [("I", INSERT, follows, False)]
    if letter is None:
        return out
    role, fault = divmod(ord(letter) - 65, len(FAULTS))
    out.append(("D", DELETE, node, True))
    if fault < 2:
        extra = CUT_OFF * fault
        if role == follows:
            out.append(("K", extra, follows, True))
        else:
            out.append(("R", REROLE + extra, follows, True))
        if role == SYSTEM and node == NOTHING:
            out.append(("K", extra, SYSTEM, True))
    return out


def auction(letter: str | None, beyond: tuple[int | None, ...]) -> list[int]:
    """Final prices of a column's nodes, given the final ones of the next.

    For the column after the last ``beyond`` says at which nodes a conversation may end.
    """
    price, final = [0] * 4, [False] * 4
    graph = [arcs(letter, node) for node in range(4)]
    for origin in range(4):
        path = [origin]
        while not final[path[-1]]:
            node = path[-1]
            ends = [(cost + (beyond[end] if onward else price[end]), onward, end)
                    for _, cost, end, onward in graph[node]]
            if letter is None and beyond[node] is not None:
                ends.append((beyond[node], True, node))
            least, onward, end = min(ends)
            if price[node] < least:  # cut back
                price[node] = least
                if len(path) > 1:
                    path.pop()
            elif onward:  # the next column's prices are final
                break
            else:
                path.append(end)
        for node in path:
            final[node] = True
    return price


def tight(letter: str | None, price: list[int], beyond: tuple[int | None, ...]) -> list[tuple[str, int]]:
    """For each node the least edits along tight arcs until the column is left, and where to."""
    out = []
    for node in range(4):
        edits = ""
        while True:
            if letter is None and beyond[node] is not None and price[node] == beyond[node]:
                break
            edit, _, end, onward = min(
                (edit, cost, end, onward) for edit, cost, end, onward in arcs(letter, node)
                if price[node] == cost + (beyond[end] if onward else price[end]))
            edits, node = edits + edit, end
            if onward:
                break
        out.append((edits, node))
    return out


class Lattice:
    """Columns by letter and relative prices of the next one; equal columns are settled once."""

    def __init__(self) -> None:
        self.known: dict[tuple[str | None, tuple], tuple[tuple[int, ...], int, list]] = {}

    def column(self, letter: str | None, beyond: tuple) -> tuple[tuple[int, ...], int, list]:
        """Prices less the least of them, that least one, and the edits from each node."""
        found = self.known.get((letter, beyond))
        if found is None:
            price = auction(letter, beyond)
            least = min(price)
            found = tuple(p - least for p in price), least, tight(letter, price, beyond)
            self.known[letter, beyond] = found
        return found

    def repair(self, letters: str) -> tuple[int, str]:
        """The least cost and the least audit of that cost."""
        end, cost, last = self.column(None, (0, None, None, 0))
        prices, kept = end, []
        for stop in range(len(letters), 0, -BLOCK):
            kept.append((stop, prices))
            for letter in reversed(letters[max(stop - BLOCK, 0):stop]):
                prices, least, _ = self.column(letter, prices)
                cost += least
        cost += prices[NOTHING]
        node, audit = NOTHING, []
        for stop, prices in reversed(kept):
            moves = []
            for letter in reversed(letters[max(stop - BLOCK, 0):stop]):
                prices, _, move = self.column(letter, prices)
                moves.append(move)
            for move in reversed(moves):
                edits, node = move[node]
                audit.append(edits)
        audit.append(last[node][0])
        return cost, "".join(audit)


def audits(conversations: DataFrame) -> DataFrame:
    """``key, numbers, audit`` of conversations as ``strings`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice()
        for batch in batches:
            numbers, edits = [], []
            for pieces in batch.column(1).to_pylist():
                letters = "".join(p["letters"] for p in pieces)
                lows = [p["low"] for p in pieces if p["turns"]]
                highs = [p["high"] for p in pieces if p["turns"]]
                turns = sum(p["turns"] for p in pieces) - sum(a == b for a, b in zip(highs, lows[1:]))
                gaps = highs[-1] - lows[0] + 1 - turns if turns else 0
                faults = [sum(letters.count(chr(65 + r * len(FAULTS) + f)) for r in range(4))
                          for f in range(len(FAULTS))]
                roles = letters.translate(BY_ROLE)
                legal = sum(roles.count(pair) for pair in LEGAL)
                cost, audit = lattice.repair(letters)
                numbers.append([gaps, faults[2], faults[3], faults[1], max(len(roles) - 1, 0) - legal, cost])
                edits.append(audit)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(numbers, pa.list_(pa.int64())), pa.array(edits, pa.string())],
                ["key", "numbers", "audit"])

    BY_ROLE = {65 + r * len(FAULTS) + f: "?sua"[r] for r in range(4) for f in range(len(FAULTS))}
    LEGAL = ("su", "ua", "au")  # no two of one kind overlap
    return conversations.mapInArrow(run, "key string, numbers array<long>, audit string")


# Repaired text --------------------------------------------------------------------------

def follow(audits_of: DataFrame, rows: DataFrame, digests_only: bool) -> DataFrame:
    """Walks along rows and audits of conversations, each conversation's audit before its rows.

    Gives the digest per conversation, or else the repaired rows ``key, at, role, text``.
    """
    nothing = F.lit(None)
    order = ["key", F.col("head").desc(), F.col("turn").asc_nulls_first(), "role", "digest"]
    heads = audits_of.select(
        "key", F.lit(True).alias("head"), nothing.cast("long").alias("turn"), nothing.cast("string").alias("role"),
        nothing.cast("binary").alias("digest"), F.col("audit").alias("text"), F.lit(1).alias("copies"), "numbers")
    lines = rows.filter("copies > 0").select(
        "key", F.lit(False).alias("head"), "turn", "role", digest().alias("digest"), "text", "copies",
        nothing.cast("array<long>").alias("numbers"))
    stream = heads.union(lines).repartition("key").sortWithinPartitions(*order).select(
        "key", "head", "role", "text", "copies", "numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, state, place, done = None, "", 0, NOTHING, 0, []
        numbers, sha = None, hashlib.sha256()

        def put(role: str, text: str) -> None:
            nonlocal place
            if digests_only:
                sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            else:
                done.append((key, place, role, text))
            place += 1

        def insert() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state, at = FOLLOWS[state], at + 1
                put(ROLES[state], "")

        def close() -> None:
            if key is not None:
                insert()
                if digests_only:
                    done.append((key, numbers, audit, sha.hexdigest()))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for k, head, role, text, copies, counted in zip(*(c.to_pylist() for c in batch.columns)):
                if head:
                    close()
                    key, audit, numbers, at, state, place = k, text, counted, 0, NOTHING, 0
                    sha = hashlib.sha256()
                    continue
                for _ in range(copies):
                    insert()
                    edit, at = audit[at], at + 1
                    if edit == "D":
                        continue
                    if edit == "K" and role[0] == "s":
                        state = SYSTEM
                    else:
                        state = FOLLOWS[state]
                    put(role if edit == "K" else ROLES[state], text)
            yield out()
        close()
        yield out()

    if digests_only:
        names, types = ["key", "numbers", "audit", "repaired_sha256"], [
            pa.string(), pa.list_(pa.int64()), pa.string(), pa.string()]
        return stream.mapInArrow(run, "key string, numbers array<long>, audit string, repaired_sha256 string")
    names, types = ["key", "at", "role", "text"], [pa.string(), pa.int64(), pa.string(), pa.string()]
    return stream.mapInArrow(run, "key string, at long, role string, text string")


def by_id(out: DataFrame, rows: DataFrame, *columns: str | Column) -> DataFrame:
    kind = rows.schema["conv_id"].dataType
    return out.select(F.when(F.col("key") != "", F.expr("substring(key, 2)").cast(kind)).alias("conv_id"), *columns)


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, at, role, text``."""
    ready = as_given(rows)
    return by_id(follow(audits(strings(ready)), ready, False), rows, "at", "role", "text")


def report(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of the repair of every conversation, after damage."""
    ready = damaged(rows)
    found = follow(audits(strings(ready)), ready, True)
    return by_id(found, rows, *[F.col("numbers")[i].alias(n) for i, n in enumerate(NUMBERS)],
                 "audit", "repaired_sha256")


def _add(state: str, cost: str, letter: str) -> str:
    return (f"lpad((left({state}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{letter}'")


def _closed(v: dict[int, str]) -> dict[int, str]:
    """A column of states with insertions."""
    v = dict(v)
    v[2] = f"least({v[2]}, {_add(v[0], '5', 'I')}, {_add(v[1], '5', 'I')}, {_add(v[3], '5', 'I')})"
    return v


# States are strings of cost and audit, so that the least one is the cheapest and then the first.
ORACLE_SQL = f"""
WITH RECURSIVE {merkle.CRC_TABLE},
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {merkle.crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS drawn
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN drawn = 4 THEN 'user' ELSE role END AS role,
         CASE drawn WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM given, range(2) c(k) WHERE drawn <> 0 AND (k = 0 OR drawn = 3)),
placed AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ends, left(role, 1) AS ini,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i
  FROM damaged),
marked AS (
  SELECT *, CASE WHEN ends = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(ends, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM marked GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS v0, NULL::VARCHAR AS v1, '000000005I' AS v2, '000000010II' AS v3
  FROM (SELECT DISTINCT conv_id FROM given)
  UNION ALL
  SELECT conv_id, i, v0, v1, v2, least(v3, {_add('v2', '5', 'I')}) FROM (
    SELECT conv_id, i, v0, v1,
           {_closed({0: 'v0', 1: 'v1', 2: 'v2', 3: 'v3'})[2]} AS v2, v3 FROM (
      SELECT m.conv_id, m.i, {_add('w.v0', '2', 'D')} AS v0,
             least({_add('w.v1', '2', 'D')}, CASE WHEN ok AND ini = 's' THEN {_add('w.v0', 'pen', 'K')} END) AS v1,
             least({_add('w.v2', '2', 'D')},
                   CASE WHEN ok AND ini = 'u' THEN least({_add('w.v0', 'pen', 'K')}, {_add('w.v1', 'pen', 'K')}, {_add('w.v3', 'pen', 'K')})
                        WHEN ok THEN least({_add('w.v0', 'pen + 1', 'R')}, {_add('w.v1', 'pen + 1', 'R')}, {_add('w.v3', 'pen + 1', 'R')}) END) AS v2,
             least({_add('w.v3', '2', 'D')},
                   CASE WHEN ok AND ini = 'a' THEN {_add('w.v2', 'pen', 'K')}
                        WHEN ok THEN {_add('w.v2', 'pen + 1', 'R')} END) AS v3
      FROM walk w JOIN (SELECT *, fault IN ('', 'truncated') AS ok,
                               CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS pen FROM marked) m
        ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1))),
best AS (
  SELECT w.conv_id, left(least(v0, v3), 9)::BIGINT AS cost, substr(least(v0, v3), 10) AS audit
  FROM walk w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id
  WHERE w.i = coalesce(c.n, 0)),
told AS (
  SELECT conv_id, audit, 1 AS step, 0::BIGINT AS i, '' AS last, NULL::VARCHAR AS told FROM best
  UNION ALL
  SELECT t.conv_id, t.audit, t.step + 1, CASE e WHEN 'I' THEN t.i ELSE t.i + 1 END,
         CASE WHEN e = 'D' THEN t.last WHEN e = 'K' THEN m.ini WHEN t.last = 'u' THEN 'a' ELSE 'u' END,
         CASE WHEN e = 'D' THEN t.told
              ELSE coalesce(t.told || chr(10), '') ||
                   CASE WHEN e = 'K' THEN m.role WHEN t.last = 'u' THEN 'assistant' ELSE 'user' END || ':' ||
                   CASE e WHEN 'I' THEN '' ELSE m.text END END
  FROM (SELECT *, substr(audit, step, 1) AS e FROM told WHERE step <= length(audit)) t
  LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM t.conv_id AND m.i = t.i + 1)
SELECT b.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank,
       coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, b.cost, b.audit,
       sha256(coalesce(t.told, '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
JOIN told t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.step = length(b.audit) + 1
"""
