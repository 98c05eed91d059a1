"""Removal of repeated passages with suffix arrays of shards, built by induced sorting.

A string of ``WIDTH`` bytes goes where its least hash of a gram leads, so that equal strings meet in
one shard wherever they stand. Neighbouring strings with the same gram travel as one piece. A
shard's pieces are laid end to end in the order of (document, start); its suffix array is induced
from the sorted leftmost-smaller substrings, the permuted common prefixes tell which strings are
equal, and of equal ones all but the first are repeats. Bytes that a repeat covers are removed.

Equal pieces of a lot are merged before they are shuffled, the others packed into blocks by the
task they go to. A gram whose different pieces exceed
a shard is not solved in place: its pieces are cut anew by longer grams and dealt out again, at
last by whole strings, of which no two different ones share a gram. So no group is collected
beyond a shard, and none is cut off.

Defined results: a NULL text is empty. Rows without id come before all others; texts of one id are
ordered by their hash; rows of equal id and text are one document and share its result. An empty
table gives no rows. Other columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import common

WIDTH = 100
# Lengths of grams: the first deal, and those of pieces that were too many for a shard.
GRAMS = (16, 58, 79, 90, 95, 98, 100)
SHARD = 1 << 21  # bytes of pieces in one suffix array
TOGETHER = 1 << 20  # bytes of texts that are cut at once
FEW = 512  # symbols up to which a whole bucket is induced at once

BLOCK = 1 << 25  # bytes of pieces that a task holds until they are packed by where they go

PACKED = "bucket int, id long, tie long, start long, stop long, block binary"
PIECES = "core long, id long, tie long, start long, stop long, at int, data binary"
Piece = tuple[tuple, int, bytes]  # (key of the document, start, bytes)


# Suffix arrays -----------------------------------------------------------------------

def smaller(s: np.ndarray) -> np.ndarray:
    """Whether a suffix is smaller than the next one; ``s`` ends with its only, least 0."""
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    rises = np.r_[s[starts[1:]] > s[starts[:-1]], True]
    return np.repeat(rises, np.diff(np.r_[starts, len(s)]))


def _dealt(at: np.ndarray, symbols: np.ndarray, queues: list[list[np.ndarray]]) -> None:
    """Appends positions to the queues of their symbols, in their order."""
    if not len(at):
        return
    order = np.argsort(symbols, kind="stable")
    at, symbols = at[order], symbols[order]
    cuts = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
    for symbol, part in zip(symbols[cuts].tolist(), np.split(at, cuts[1:])):
        queues[symbol].append(part)


def _with_runs(queue: list[np.ndarray], s: np.ndarray, symbol: int) -> np.ndarray:
    """A bucket's queue and what it induces in the same bucket, wave by wave."""
    waves = list(queue)
    wave = np.concatenate(waves) if waves else np.empty(0, np.int64)
    while len(wave):
        wave = wave[wave > 0] - 1
        wave = wave[s[wave] == symbol]
        waves.append(wave)
    return np.concatenate(waves) if waves else wave


def induce_buckets(s: np.ndarray, least: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array that ordered leftmost-smaller suffixes induce, a bucket at a time."""
    seeds: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    _dealt(least, s[least], seeds)
    larger: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    falling = []
    for c in range(symbols):
        own = _with_runs(larger[c], s, c)
        falling.append(own)
        before = np.concatenate([own, *seeds[c]])
        before = before[before > 0] - 1
        before = before[s[before] > c]
        _dealt(before, s[before], larger)
    lesser: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    out = [np.array([len(s) - 1])]
    rising: list[np.ndarray] = [out[0]] * symbols
    for c in range(symbols - 1, 0, -1):
        rising[c] = _with_runs(lesser[c], s, c)
        before = np.concatenate([rising[c], falling[c][::-1]])
        before = before[before > 0] - 1
        before = before[s[before] < c]
        _dealt(before, s[before], lesser)
    for c in range(1, symbols):
        out += [falling[c], rising[c][::-1]]
    return np.concatenate(out)


def induce_scan(s: np.ndarray, least: np.ndarray, symbols: int) -> np.ndarray:
    """The same, an entry at a time, for many symbols."""
    ends = np.cumsum(np.bincount(s, minlength=symbols))
    rises, text = smaller(s).tolist(), s.tolist()
    heads, tails = [0, *ends[:-1].tolist()], ends.tolist()
    out = [-1] * len(text)
    for at in least[::-1].tolist():
        c = text[at]
        tails[c] -= 1
        out[tails[c]] = at
    for i in range(len(text)):
        at = out[i] - 1
        if at >= 0 and not rises[at]:
            c = text[at]
            out[heads[c]] = at
            heads[c] += 1
    tails = ends.tolist()
    for i in range(len(text) - 1, -1, -1):
        at = out[i] - 1
        if at >= 0 and rises[at]:
            c = text[at]
            tails[c] -= 1
            out[tails[c]] = at
    return np.array(out, np.int64)


def names(s: np.ndarray, least: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Numbers of the leftmost-smaller substrings, in text order; equal ones share a number."""
    length = np.zeros(len(s), np.int64)
    length[least] = np.r_[np.diff(least) + 1, 1]
    one, two = ordered[:-1], ordered[1:]
    differs = length[one] != length[two]
    active, k = np.flatnonzero(~differs), 0
    while len(active):
        unequal = s[one[active] + k] != s[two[active] + k]
        differs[active[unequal]] = True
        k += 1
        active = active[~unequal]
        active = active[length[one[active]] > k]
    number = np.zeros(len(s), np.int64)
    number[ordered] = np.r_[0, np.cumsum(differs)]
    return number[least]


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Starts of all suffixes in order; ``s`` holds 0 once, at its end."""
    induce = induce_buckets if symbols <= FEW else induce_scan
    rises = smaller(s)
    first = np.r_[False, rises[1:] & ~rises[:-1]]
    least = np.flatnonzero(first)
    if len(least) < 2:  # nothing but falling symbols before the end
        return induce(s, least, symbols) if len(least) else np.array([0])
    rough = induce(s, least, symbols)
    number = names(s, least, rough[first[rough]])
    many = int(number.max()) + 1
    if many < len(least):
        order = suffix_array(number, many)
    else:
        order = np.empty(len(least), np.int64)
        order[number] = np.arange(len(least))
    return induce(s, least[order], symbols)


def common_prefixes(s: np.ndarray, array: np.ndarray, stop: int) -> np.ndarray:
    """By position, the length a suffix shares with the one before it in the array, counted up to
    the next symbol that is at most ``stop``. Compared only where it does not follow from the left."""
    before = np.full(len(s), -1, np.int64)
    before[array[1:]] = array[:-1]
    own = (before <= 0) | np.r_[True, s[:-1] <= stop]
    own[1:] |= s[:-1] != s[before[1:] - 1]
    shared = np.zeros(len(s), np.int64)
    active, k = np.flatnonzero(own & (before >= 0)), 0
    while len(active):
        a = s[active + k]
        active = active[(a == s[before[active] + k]) & (a > stop)]
        k += 1
        shared[active] = k
    known = np.maximum.accumulate(np.where(own, np.arange(len(s)), 0))
    return np.maximum(shared[known] - (np.arange(len(s)) - known), 0)


def repeats(pieces: list[Piece], width: int = WIDTH) -> Iterator[tuple[tuple, int, int]]:
    """``(key, start, stop)`` covered by strings that an earlier one of the pieces equals."""
    pieces = sorted(pieces, key=lambda p: p[:2])
    s = np.frombuffer(b"".join(data + b"\0" for _, _, data in pieces) + b"\0", np.uint8).astype(np.int64) + 2
    ends = np.cumsum(np.fromiter((len(data) + 1 for _, _, data in pieces), np.int64, len(pieces)))
    s[ends - 1], s[-1] = 1, 0
    array = suffix_array(s, 258)
    same = common_prefixes(s, array, 1)[array] >= width
    groups = np.flatnonzero(~same)
    first = np.minimum.reduceat(array, groups)
    sizes = np.diff(np.r_[groups, len(array)])
    at = np.sort(array[array != np.repeat(first, sizes)])
    which = np.searchsorted(ends, at, "right")
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(which) != 0)) + 1
    for run, i in zip(np.split(at, cut), which[np.r_[0, cut]].tolist() if len(at) else ()):
        key, start, data = pieces[i]
        shift = start - int(ends[i]) + len(data) + 1
        yield key, shift + int(run[0]), shift + int(run[-1]) + width


# Pieces ------------------------------------------------------------------------------

def grams(text: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every gram along the last axis."""
    h, held = text.astype(np.uint64) + np.uint64(1), 1
    factor = 0x9E3779B97F4A7C15
    while held < size:
        more = min(held, size - held)
        h = h[..., :h.shape[-1] - more] * np.uint64(factor) + h[..., more:]
        held, factor = held + more, factor * factor + 2 & (1 << 64) - 1 | 1
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def cut(texts: list[bytes], size: int, width: int = WIDTH) -> Iterator[tuple[int, int, int, int, int]]:
    """``(text, from, to, place, core)`` of runs of strings whose first least gram is the same one;
    it stands at ``place`` in the run and has the hash ``core``."""
    text = np.frombuffer(b"".join(texts), np.uint8)
    if len(text) < width:
        return
    h = grams(text, size)
    bits = np.uint64((1 << len(h).bit_length()) - 1)
    low = h & ~bits | np.arange(len(h), dtype=np.uint64)
    window, held = width - size + 1, 1
    while held < window:
        more = min(held, window - held)
        low = np.minimum(low[:len(low) - more], low[more:])
        held += more
    at = (low & bits).astype(np.int64)
    ends = np.cumsum([len(t) for t in texts])
    which = np.searchsorted(ends, np.arange(len(at)), "right")
    inside = np.arange(len(at)) + width <= ends[which]
    starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (which[1:] != which[:-1]) | (inside[1:] != inside[:-1])])
    stops = np.r_[starts[1:], len(at)]
    valid = inside[starts]
    starts, stops = starts[valid], stops[valid]
    owner = which[starts]
    shift = (ends - [len(t) for t in texts])[owner]
    yield from zip(owner.tolist(), (starts - shift).tolist(), (stops - shift + width - 1).tolist(),
                   (at[starts] - starts).tolist(), h[at[starts]].view(np.int64).tolist())


def _key(doc: int | None, tie: int) -> tuple:
    return doc is not None, doc or 0, tie


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_LONGS = [(name, pa.int64()) for name in ("id", "tie", "start", "stop")]
PACKED_ARROW = pa.schema([("bucket", pa.int32()), *_LONGS, ("block", pa.binary())])
PIECES_ARROW = pa.schema([("core", pa.int64()), *_LONGS, ("at", pa.int32()), ("data", pa.binary())])
# The numbers of a piece in a block, before the bytes of all pieces.
NUMBERS = (("given", np.uint8), ("id", np.int64), ("tie", np.int64), ("start", np.int64),
           ("length", np.uint8), ("at", np.uint8))


def pack(pieces: list[tuple]) -> bytes:
    """Pieces ``(given, id, tie, start, length, at, data)``, ids as differences, as one block."""
    pieces.sort(key=lambda p: p[:4])
    numbers = [np.array(c, kind) for c, (_, kind) in zip(zip(*pieces), NUMBERS)]
    numbers[1] = np.diff(numbers[1], prepend=0)
    raw = b"".join([len(pieces).to_bytes(8, "little"), *(n.tobytes() for n in numbers), *(p[-1] for p in pieces)])
    return zstandard.ZstdCompressor(3).compress(raw)


def unpack(block: bytes, size: int) -> pa.RecordBatch:
    """The pieces of a block, their grams hashed again."""
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, at, found = int.from_bytes(raw[:8], "little"), 8, {}
    for name, kind in NUMBERS:
        found[name] = np.frombuffer(raw, kind, n, at)
        at += n * np.dtype(kind).itemsize
    data = raw[at:]
    ends = np.r_[0, np.cumsum(found["length"], dtype=np.int32)].astype(np.int32)
    places = (ends[:-1] + found["at"])[:, None] + np.arange(size)
    core = grams(np.frombuffer(data, np.uint8)[places], size)[:, 0].view(np.int64)
    start = found["start"]
    return pa.RecordBatch.from_arrays([
        pa.array(core), pa.array(np.cumsum(found["id"]), mask=found["given"] == 0), pa.array(found["tie"]),
        pa.array(start), pa.array(start + found["length"]), pa.array(found["at"].astype(np.int32)),
        pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)])],
        schema=PIECES_ARROW)


def deal(texts: DataFrame, size: int) -> DataFrame:
    """Pieces of ``id, tie, start, data``, sorted by gram within the tasks they are dealt to; those
    that equal an earlier one of the same lot of texts are known to be repeats and have no bytes."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}
        rows: list[tuple] = []
        out: list[tuple] = []
        held = packed = 0

        def lot() -> None:
            nonlocal packed
            rows.sort(key=lambda r: (_key(r[0], r[1]), r[2]))
            seen: dict[bytes, tuple] = {}
            for i, a, b, at, core in cut([r[3] for r in rows], size):
                doc, tie, start, data = rows[i]
                data = data[a:b]
                place = doc, tie, start + a
                if seen.setdefault(data, place) == place:
                    waiting.setdefault(core % buckets, []).append(
                        (doc is not None, doc or 0, tie, start + a, b - a, at, data))
                    packed += len(data)
                elif out and out[-1][1:3] == place[:2] and out[-1][3] <= start + a <= out[-1][4]:
                    out[-1] = (*out[-1][:4], max(out[-1][4], start + b), None)
                else:
                    out.append((core % buckets, *place, start + b, None))
            rows.clear()

        def flush() -> pa.RecordBatch:
            out.extend((bucket, None, None, None, None, pack(some)) for bucket, some in waiting.items())
            waiting.clear()
            ready = _batch(out, PACKED_ARROW)
            out.clear()
            return ready

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                held += len(row[3])
                if held > TOGETHER:
                    lot()
                    held = 0
                    if packed > BLOCK:
                        yield flush()
                        packed = 0
        lot()
        yield flush()

    def open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.filter(batch.column(5).is_null())
            if known.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(known.num_rows, np.int64)), *known.columns[1:5],
                     pa.nulls(known.num_rows, pa.int32()), pa.nulls(known.num_rows, pa.binary())],
                    schema=PIECES_ARROW)
            for block in batch.column(5):
                if block.is_valid:
                    yield unpack(block.as_py(), size)

    packed_rows = texts.select("id", "tie", "start", "data").mapInArrow(run, PACKED)
    return packed_rows.repartition(tasks, "bucket").mapInArrow(open_blocks, PIECES).sortWithinPartitions("core")


def related(group: dict[bytes, tuple], size: int, width: int = WIDTH) -> list[bytes]:
    """Of pieces with one gram those that agree with another one in half a string beside it.

    A string that two pieces share has the gram at one place, so they agree in half of what the
    string has beside the gram, either on its left or on its right.
    """
    half = (width - size) // 2
    sides: dict[tuple, bytes | None] = {}
    alive = set()
    for data, (_, _, at) in group.items():
        for key in ((0, data[at - half:at]) if at >= half else None,
                    (1, data[at + size:at + width - half]) if len(data) >= at + width - half else None):
            if key is None:
                continue
            if key in sides:
                alive.add(data)
                alive.add(sides[key])
            else:
                sides[key] = data
    return [data for data in group if data in alive]


def meet(pieces: DataFrame, size: int, shard_bytes: int = SHARD) -> DataFrame:
    """Repeats (``data`` is NULL) among pieces, and the pieces of grams that exceed a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[Piece] = []
        group: dict[bytes, tuple] = {}
        out: list[tuple] = []
        core, held, heavy, over = None, 0, 0, False

        def gone(key: tuple, start: int, stop: int) -> None:
            out.append((0, key[1] if key[0] else None, key[2], start, stop, None, None))

        def solve() -> None:
            nonlocal held
            for key, start, stop in repeats(shard) if shard else ():
                gone(key, start, stop)
            shard.clear()
            held = 0

        def give_back() -> None:
            for data, (key, start, at) in group.items():
                out.append((core, key[1] if key[0] else None, key[2], start, start + len(data), at, data))
            group.clear()

        def close() -> None:
            nonlocal held, heavy, over
            if over:
                give_back()
            elif len(group) > 1:
                some = related(group, size)
                added = sum(map(len, some)) + len(some)
                if held + added > shard_bytes:
                    solve()
                shard.extend((*group[data][:2], data) for data in some)
                held += added
            group.clear()
            heavy, over = 0, False

        def wanted(batch: pa.RecordBatch) -> pa.RecordBatch:
            """Without pieces that are alone with their gram inside the batch."""
            cores = batch.column(0).to_numpy()
            near = np.r_[True, cores[1:] == cores[:-1]]
            near[-1:] = True
            near[:-1] |= cores[1:] == cores[:-1]
            return batch.filter(pa.array(near | batch.column(6).is_null().to_numpy(zero_copy_only=False)))

        for batch in batches:
            if not batch.num_rows:
                continue
            for c, doc, tie, start, stop, at, data in zip(*(x.to_pylist() for x in wanted(batch).columns)):
                if data is None:
                    out.append((0, doc, tie, start, stop, None, None))
                    continue
                if c != core:
                    close()
                    core = c
                key = _key(doc, tie)
                known = group.get(data)
                if known is None:
                    group[data] = key, start, at
                    heavy += len(data) + 1
                    if heavy > shard_bytes:
                        over = True
                        give_back()
                        heavy = 0
                elif known[:2] != (key, start):
                    first, again = sorted([known[:2], (key, start)])
                    group[data] = *first, at
                    gone(*again, again[1] + len(data))
            yield _batch(out, PIECES_ARROW)
            out.clear()
        close()
        solve()
        yield _batch(out, PIECES_ARROW)

    return pieces.mapInArrow(run, PIECES)


def spans(texts: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """``id, tie, start, stop`` of repeats in texts ``id, tie, start, data``; they may overlap."""
    found = None
    for size in GRAMS:
        met = common.written(meet(deal(texts, size), size, shard_bytes), "repeats")
        known = met.filter("data IS NULL").select("id", "tie", "start", "stop")
        found = known if found is None else found.union(known)
        texts = met.filter("data IS NOT NULL")
        if texts.isEmpty():
            return found
    raise AssertionError("whole strings share no gram")


# Documents ---------------------------------------------------------------------------

def typed(docs: DataFrame) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(data).alias("tie"),
                       F.lit(0).cast("long").alias("start"), data.alias("data"))


def kept(docs: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that stay) of every row."""
    rows = typed(docs)
    found = spans(rows, shard_bytes).groupBy("id", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    both = rows.alias("r").join(
        found.alias("f"), F.col("r.id").eqNullSafe(F.col("f.id")) & (F.col("r.tie") == F.col("f.tie")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, data, ranges in zip(*(c.to_pylist() for c in batch.columns)):
                parts, at, removed, runs, end = [], 0, 0, 0, -1
                for start, stop in sorted((r["start"], r["stop"]) for r in ranges or ()):
                    runs += start > end
                    if stop > at:
                        parts.append(data[at:start])
                        removed += stop - max(start, at)
                        at = stop
                    end = max(end, stop)
                rest = b"".join(parts) + data[at:]
                out.append((doc, len(data), removed, runs, rest))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.select(F.col("r.id"), F.col("r.data"), F.col("f.ranges")).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def report(docs: DataFrame, shard_bytes: int = SHARD) -> DataFrame:
    """Per document how many bytes go, in how many runs, and the digest of those that stay."""
    return kept(docs, shard_bytes).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
