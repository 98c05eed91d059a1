"""Packing of documents into sequences: shortest-pack-first over the length histogram.

Documents are tokenised and cut into pieces of at most one sequence. Only the histogram of
piece lengths (at most ``SIZE`` numbers) reaches the driver, where lengths are placed
longest first, each into the emptiest packs that still have room, as counts of packing
patterns. Patterns are joined back by rank: the pieces of a length are numbered by
(partition, order in it), and each number falls into one slot of one pattern.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common

SIZE = 2048
END = 1
ENCODED = 20_000  # new parts that are encoded at once: the tokenizer takes a hundred bytes for each id
CACHE = 400_000  # parts whose ids a worker keeps from one group of texts, or task, to the next
TOGETHER = 1 << 21  # bytes of texts that are looked up as one group
ROWS = 500  # texts of a batch that are Python strings at once

Slots = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _kinds() -> np.ndarray:
    """For each byte: 1 an ASCII letter, 2 ASCII punctuation but the apostrophe, 4 any other
    visible ASCII sign, 8 the first byte of U+00C0 to U+00FF."""
    kinds = np.zeros(256, np.uint8)
    for i in range(0x21, 0x7F):
        kinds[i] = 1 if chr(i).isalpha() else 4 if chr(i).isdigit() or chr(i) == "'" else 2
    kinds[0xC3] = 8
    return kinds


KINDS = _kinds()
LETTER, PUNCTUATION, VISIBLE, START = 1, 2, 7, 15


def borders(data: np.ndarray) -> np.ndarray:
    """Whether a text, as UTF-8 bytes, may be cut before each byte without changing its ids.

    The vocabulary's pre-tokeniser starts a new unit at a space before a visible sign, at
    punctuation after a letter, and at a line feed between visible signs and behind it. Not
    every such place is found: signs beyond ASCII count as letters only from U+00C0 to U+00FF.
    """
    kinds = KINDS[data]
    found = np.zeros(len(data) + 1, bool)
    if len(data) < 2:
        return found[:-1]
    letter = kinds == LETTER
    wide = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # no times or division sign
    letter[1:] |= wide
    starts = (kinds & START) > 0
    found[1:-1] = letter[:-1] & (kinds[1:] == PUNCTUATION)
    found[:-2] |= (data[:-1] == 0x20) & starts[1:]
    ends = letter | ((kinds & VISIBLE) > 0)
    feeds = np.flatnonzero((data[1:-1] == 0x0A) & ends[:-2] & starts[2:]) + 1
    found[feeds] = found[feeds + 1] = True
    return found[:-1]


class Encoder:
    """Ids of whole texts as uint32 bytes (little-endian machines), with a cache by part.

    Texts are cut into parts where the vocabulary's pre-tokeniser starts a new unit anyway;
    equal parts are encoded once. Texts that hold a special token are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)  # byte-level: a character for each byte
        self._forget()

    def _forget(self) -> None:
        """The known parts, and where the ids of each lie in ``ids``."""
        self.parts = pa.array([], pa.binary())
        self.first = self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32)
                for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: pa.Array) -> None:
        """Adds parts: those that start with a single space are encoded as one text, whose ids
        are cut by the bytes they stand for, and the others each by itself."""
        words = new.to_pylist()
        inner = np.fromiter((w[:1] == b" " and len(w) > 1 and KINDS[w[1]] > 0 for w in words),
                            bool, len(words))
        at = np.flatnonzero(inner)
        count = np.zeros(len(words), np.int64)
        first = np.zeros(len(words), np.int64)
        found = []
        if len(at):
            ids, = self._encode([b"".join(words[i] for i in at).decode()])
            end = np.cumsum(self.n_bytes[ids])
            stop = np.cumsum(np.fromiter((len(words[i]) for i in at), np.int64, len(at)))
            cut = np.searchsorted(end, stop)
            if (end[cut] != stop).any():
                raise ValueError("the vocabulary has units across a space")
            count[at] = np.diff(cut + 1, prepend=0)
            found.append(ids)
        rest = np.flatnonzero(~inner)
        others = self._encode([words[i].decode() for i in rest])
        count[rest] = [len(x) for x in others]
        order = np.concatenate([at, rest])
        first[order] = np.cumsum(count[order]) - count[order] + len(self.ids)
        self.parts = pa.concat_arrays([self.parts, new])
        self.first, self.count = np.concatenate([self.first, first]), np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, *found, *others])

    def _places(self, parts: pa.DictionaryArray) -> np.ndarray:
        """The number of each part among the known ones, which all become known."""
        if len(self.parts) > CACHE:
            self._forget()
        place = pc.index_in(parts.dictionary, value_set=self.parts)
        new = parts.dictionary.filter(pc.is_null(place))
        place = pc.fill_null(place, -1).to_numpy().astype(np.int64)
        place[place < 0] = len(self.parts) + np.arange(len(new))
        for at in range(0, len(new), ENCODED):
            self._learn(new.slice(at, ENCODED))
        return place[parts.indices.to_numpy()]

    def _some(self, texts: list[str]) -> Iterator[bytes]:
        raw = [b"" if any(x in t for x in self.whole) else t.encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        end = np.cumsum(size)
        joined = b"".join(raw)
        may = borders(np.frombuffer(joined, np.uint8))
        may[end[size > 0] - 1] = False  # what follows is another text
        may[(end - size)[size > 0]] = True
        cuts = np.append(np.flatnonzero(may), len(joined)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [
            None, pa.py_buffer(cuts), pa.py_buffer(joined)]).dictionary_encode()
        place = self._places(parts)
        count = self.count[place]
        stop = np.cumsum(count)
        ids = self.ids[np.repeat(self.first[place] - stop + count, count) + np.arange(count.sum())]
        last = np.append(0, stop)[np.searchsorted(cuts, end)]
        for text, a, b, n in zip(texts, np.append(0, last[:-1]).tolist(), last.tolist(), size.tolist()):
            yield ids[a:b].tobytes() if n or not text else self._encode([text])[0].tobytes()

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size > TOGETHER:
                yield from self._some(some)
                some, size = [], 0
        yield from self._some(some)


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of a vocabulary, kept as long as Spark uses the worker process again."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           size: int = SIZE) -> DataFrame:
    """``(id, start, length, ids_crc32, doc_tokens)``: full pieces, then the rest."""
    kind = docs.schema[id_col].dataType
    names = ["start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(tokenizer), array("I", [END]).tobytes()
        for batch in batches:
            rows, out = [], []
            texts = (t for at in range(0, batch.num_rows, ROWS)
                     for t in pc.fill_null(batch.column(1).slice(at, ROWS), "").to_pylist())
            for i, ids in enumerate(encoder.encode(texts)):
                ids += end
                total = len(ids) // 4
                for at in range(0, total, size):
                    part = ids[4 * at:4 * (at + size)]
                    rows.append(i)
                    out.append((at, len(part) // 4, zlib.crc32(part), total))
            numbers = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())),
                 *(pa.array(numbers[:, k]) for k in range(4))], ["id", *names])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, StructType([StructField("id", kind), *(StructField(n, LongType()) for n in names)]))


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """``(packs, lengths in them)``, by shortest pack first.

    Longest lengths first; each goes to the packs with the most room, as many of them as
    there are pieces, and to new packs once no room is left. At most two patterns change
    per step, so their number is bounded by the lengths, not by the pieces.
    """
    room: dict[int, list[tuple[int, list[int]]]] = {}
    for length in sorted(histogram, reverse=True):
        left, space = histogram[length], size
        placed: list[tuple[int, list[int]]] = []
        while left:
            while space >= length and not room.get(space):
                space -= 1
            if space < length:
                each = size // length  # new packs hold as many of this length as fit
                if left >= each:
                    placed.append((left // each, [length] * each))
                    left %= each
                if left:
                    placed.append((1, [length] * left))
                    left = 0
                break
            count, pack = room[space].pop()
            each = space // length
            if left < each:
                room[space].append((count - 1, pack)) if count > 1 else None
                placed.append((1, pack + [length] * left))
                left = 0
            else:
                used = min(count, left // each)
                if count > used:
                    room[space].append((count - used, pack))
                placed.append((used, pack + [length] * each))
                left -= used * each
        for count, pack in placed:
            room.setdefault(size - sum(pack), []).append((count, pack))
    return [x for space in sorted(room) for x in room[space]]


def slots(packs: list[tuple[int, list[int]]]) -> Slots:
    """For each length: first rank, first sequence and offset of its runs of pieces."""
    rank: dict[int, int] = {}
    out: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for count, pack in packs:
        offset = 0
        for length in pack:
            at = rank.get(length, 0)
            out.setdefault(length, []).append((at, sequence, offset))
            rank[length] = at + count
            offset += length
        sequence += count
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in out.items()}


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         size: int = SIZE) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a vocabulary file that every executor has. A NULL or empty
    text is one piece with the end id alone. Repeated rows are documents of their own; equal
    rows tie and any order of them gives equal results. NULL ids stay. Other columns of
    ``docs`` are ignored; an empty table gives no rows.
    """
    cut = common.checkpoint(pieces(docs, tokenizer, id_col, text_col, size))
    cut = cut.withColumn("chunk", F.spark_partition_id())
    counts = cut.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(
        F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    where = slots(patterns(histogram, size))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    first = counts.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "chunk").orderBy("id", "start", "ids_crc32")
    ranked = cut.withColumn("nth", F.row_number().over(inside)).join(
        first, ["length", "chunk"]).select(
        "id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("nth") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (2, 5))
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                ranks, sequences, offsets = where[int(one)]
                k = np.searchsorted(ranks, rank[at], "right") - 1
                sequence[at] = sequences[k] + rank[at] - ranks[k]
                offset[at] = offsets[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], out.names)

    out = StructType([*ranked.schema.fields[:5], StructField("sequence_id", LongType()),
                      StructField("offset", LongType())])
    return ranked.mapInArrow(place, out).withColumnRenamed("id", id_col)
