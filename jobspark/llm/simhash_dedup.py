"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments. If two fingerprints differ in at
most ``RADIUS`` = 4 bits, then some segment differs in at most one. Each segment is
indexed under all its variants with one bit masked, so two segments that differ in at
most one bit meet under some variant: an equality on (segment, masked bit, value).
What meets is verified by the full distance. Every fingerprint gives 64 rows of two longs,
whatever the data; equal texts are one fingerprint before that.

Inside a group that meets, only a spanning forest of the links is kept: a fingerprint that
is reached is never compared again, so dense groups cost about their size, not its square.
Large groups are parted once more: the bits in which they vary are dealt into ``RADIUS + 1``
blocks. Two fingerprints that link agree in a block, so only those that do are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common

SHINGLE = 4
SEED = 42
RADIUS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (first bit, bits)
SMALL = 16
LARGE = 1 << 14  # fingerprints of a group that are compared without parting it


def simhash(text: bytes | None) -> int:
    """The fingerprint as a signed long. No words (and NULL): zero."""
    words = (text or b"").lower().split()  # bytes: ASCII letters and \\x20, \\x09-\\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    first, last = (end - length), end[SHINGLE - 1:]
    if len(words) < SHINGLE:
        first, last = first[:1], end[-1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(last), 1 << 15):
        begin, stop = first[at:at + (1 << 15)].tolist(), last[at:at + (1 << 15)].tolist()
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in zip(begin, stop)),
            np.uint64, len(stop))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1,
                                bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(last), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of every row, repeated rows and NULL ids included."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(x) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, StructType([StructField("id", kind), StructField("fp", LongType())]))


def variants(fp: str = "fp") -> Column:
    """The 64 one-wildcard keys of a fingerprint; the masked bit is part of the key."""
    keys = []
    for start, bits in SEGMENTS:
        segment = F.shiftrightunsigned(F.col(fp), start).bitwiseAND(F.lit((1 << bits) - 1))
        keys += [segment.bitwiseAND(F.lit(~(1 << j))).bitwiseOR(F.lit((start + j) << 22))
                 for j in range(bits)]
    return F.array(*keys)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Within the radius. The count of bits of a signed number would be that of its size."""
    return np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS


def _forest(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever is connected within the radius inside the group."""
    left = fps
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            one = frontier.pop()
            near = _near(left, one)
            if near.any():
                found, left = left[near], left[~near]
                yield np.full(len(found), one), found
                frontier.extend(found)


def _parted(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for a large group, over those that agree in one of ``RADIUS + 1`` blocks."""
    varying = int(np.bitwise_or.reduce((fps ^ fps[0]).view(np.uint64)))
    bits = [b for b in range(64) if varying >> b & 1]
    for k in range(RADIUS + 1):
        block = fps.view(np.uint64) & np.uint64(sum(1 << b for b in bits[k::RADIUS + 1]))
        order = np.argsort(block, kind="stable")
        yield from _compared(block[order], fps[order], _forest)


def _compared(keys: np.ndarray, fps: np.ndarray, large: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links among rows sorted by key; ``large`` takes the groups of over ``LARGE``."""
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    size = np.diff(edge)
    small = np.repeat(size <= SMALL, size)
    a, ka = fps[small], keys[small]
    for k in range(1, min(SMALL, size.max(initial=0))):
        at = np.flatnonzero(ka[k:] == ka[:-k])
        if not len(at):
            break
        at = at[_near(a[at], a[at + k])]
        yield a[at], a[at + k]
    for i in np.flatnonzero(size > SMALL):
        yield from (large if size[i] > LARGE else _forest)(fps[edge[i]:edge[i + 1]])


def _links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
    """Verified links among rows sorted by key."""
    found = list(_compared(keys, fps, _parted))
    pairs = np.array([np.concatenate([x[i] for x in found]) if found else [] for i in (0, 1)],
                     np.int64).T
    pairs = np.unique(np.sort(pairs, axis=1), axis=0)
    return pa.RecordBatch.from_arrays(
        [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """``(a, b)``: links of at most ``RADIUS`` bits that connect all fingerprints (column
    ``fp``, each once) which chains of such links connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last key so far
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if held and held[-1][0][-1] == keys[0] == keys[-1]:
                held.append((keys, fps))
                continue
            cut = np.searchsorted(keys, keys[-1])
            if cut or held:
                held.append((keys[:cut], fps[:cut]))
                yield _links(*(np.concatenate(x) for x in zip(*held)))
            held = [(keys[cut:], fps[cut:])]
        if held:
            yield _links(*(np.concatenate(x) for x in zip(*held)))

    return (
        distinct.select(F.explode(variants()).alias("key"), "fp")
        .repartition("key").sortWithinPartitions("key", "fp")
        .mapInArrow(run, "a bigint, b bigint")
    )


def classes(fps: DataFrame) -> DataFrame:
    """``(fp, least, root, component_id)`` of each fingerprint of ``(id, fp)``: its smallest
    id, one root a group and the smallest id of the group."""
    groups = fps.groupBy("fp").agg(F.min("id").alias("least"))
    linked = common.components(links(groups.select("fp")))
    named = groups.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("fp", "least", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most four bits. Rows
    without words (NULL, empty, blank) have fingerprint zero and link like any other.
    Repeated rows stay; a NULL id stays NULL and names no component. Other columns of
    ``docs`` are ignored. An empty table gives an empty result.
    """
    fps = common.checkpoint(fingerprints(docs, id_col, text_col))
    return fps.join(classes(fps).drop("root", "least"), "fp").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that come first in their group.

    That is the row with the smallest id, or without one if no row of the group has any; of
    several such rows that with the smallest fingerprint; any one of rows with the same.
    Different texts under one id, or without id, each count in their own group.
    """
    found = classes(common.checkpoint(fingerprints(docs, id_col, text_col)))
    fp, root, first = (common.unused(name, docs.columns) for name in ("fp", "root", "first"))
    chosen = common.checkpoint(found.filter(F.col("least").eqNullSafe(F.col("component_id"))).groupBy("root").agg(
        F.min("fp").alias(fp), F.min("component_id").alias(first)).withColumnRenamed("root", root))
    at = docs.columns.index(text_col)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.string()).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([simhash(x) for x in texts], pa.int64())], [*batch.schema.names, fp])

    marked = docs.mapInArrow(add, StructType([*docs.schema.fields, StructField(fp, LongType())]))
    return marked.join(chosen, (marked[fp] == chosen[fp]) & marked[id_col].eqNullSafe(chosen[first])).dropDuplicates(
        [root]).select(*docs.columns)
