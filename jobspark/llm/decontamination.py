"""Benchmark decontamination with DataFrame functions only.

Texts are lower-cased runs of letters and digits, in shingles of five words. Windows of a
document that are as long as an item are compared with the item by SimHash:

1. A bitmap that grows with the items' shingles (512 KB at least, 16 MB at most) holds them.
   Documents keep their *zones*: stretches with enough such shingles, close enough to each other
   for a window of the needed similarity. All else shares too few shingles with any item. This
   step moves no row.
2. Zones of equal content are taken once, however many documents hold them, and items of equal
   content too. Shingles, compared themselves, tell of which sizes a zone can hold items and which
   items any zone can hold. Zones give their windows of these sizes. Windows and items get 64-bit
   SimHash fingerprints of their shingles, repeated ones counted as often as they occur.
3. Fingerprints are cut into ``BLOCKS`` blocks. Two that differ in at most ``RADIUS`` bits
   differ in at most ``RADIUS // BLOCKS`` in some block. Items are indexed under all values
   that near to their blocks, windows look up their own: no pair within the radius is lost.
4. Whatever is found is verified: the weighted Jaccard similarity of the shingles (smaller
   counts over larger counts) of item and window, the window cut down to its first and last
   shingle of the item, must reach ``LEAST``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from . import common

SHINGLE = 5
LEAST = 0.8
RADIUS = 19
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # (first bit, bits)
PART = 500  # shingles of an item at most; longer items are cut into equal parts
BITMAP = 1 << 16  # longs of the bitmap at least,
LARGEST = 1 << 21  # and at most, whatever the number of items
TASK_ROWS = 500  # zones or items that one task takes, about
ROOM = 64  # bits of the bitmap for a shingle, up to that size
# A window has at most as many shingles as the item, n. If the two are similar enough, it has
# LEAST * n of the item's at least, and at most this part of n that are not the item's.
FOREIGN = (1 - LEAST) / (1 + LEAST)


def words(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits; an empty array for NULL."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingles(of: Column) -> Column:
    """Hashes of all runs of five words; an empty array for fewer words."""

    def runs(one: Column) -> Column:
        every = F.transform(one, lambda h, i: F.xxhash64(
            h, *(F.get(one, i + k) for k in range(1, SHINGLE))))
        return F.slice(every, F.lit(1), F.greatest(F.size(one) - (SHINGLE - 1), F.lit(0)))

    return let(F.transform(of, lambda w: F.xxhash64(w)), runs)


def items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, part, n, content)``: the shingles of each item, long ones in equal parts."""
    whole = benchmark.select(F.col(id_col).alias("item"), shingles(
        words(F.col(text_col).cast("string"))).alias("all")).filter(F.size("all") > 0)
    parts = F.ceil(F.size("all") / PART).cast("int")
    each = F.ceil(F.size("all") / F.col("parts")).cast("int")
    return whole.withColumn("parts", parts).withColumn("each", each).select(
        "item", "all", "each", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(
        "item", "part", F.slice("all", F.col("part") * F.col("each") + 1, F.col("each")).alias("content")).select(
        "item", "part", F.size("content").alias("n"), "content").filter("n > 0")


def _bit(h: Column) -> Column:
    return F.shiftrightunsigned(h, 52).bitwiseAND(F.lit(63)).cast("int")


def longs(shingle_count: int) -> int:
    """A power of two that gives each shingle ``ROOM`` bits."""
    return min(max(BITMAP, 1 << max(0, math.ceil(shingle_count * ROOM / 64) - 1).bit_length()), LARGEST)


def bitmap(parts: DataFrame, size: int = BITMAP) -> DataFrame:
    """One row with an array of ``size`` longs. A task makes ``BITMAP`` of them."""
    held = parts.select(F.explode("content").alias("h")).select(
        F.col("h").bitwiseAND(F.lit(size - 1)).alias("place"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), _bit(F.col("h"))).alias("bit"),
    ).groupBy("place").agg(F.bit_or("bit").alias("bits"))
    every = parts.sparkSession.range(size).select(F.col("id").alias("place"))
    filled = every.join(held, "place", "left").select(
        F.floor(F.col("place") / BITMAP).alias("piece"),
        F.struct("place", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")).alias("x"))
    pieces = filled.groupBy("piece").agg(F.array_sort(F.collect_list("x")).alias("x")).select(
        F.struct("piece", F.transform("x", lambda x: x["bits"]).alias("bits")).alias("x"))
    return pieces.agg(F.array_sort(F.collect_list("x")).alias("x")).select(
        F.flatten(F.transform("x", lambda x: x["bits"])).alias("bits"))


def zones(docs: DataFrame, parts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, start, content)``: stretches of documents that can hold a window."""
    sizes = parts.agg(F.min("n"), F.max("n"), F.sum("n")).collect()[0]  # three numbers
    if sizes[0] is None:
        return docs.select(F.col(id_col).alias("id"), F.lit(0).alias("start"), F.array(
            F.lit(0).cast("bigint")).alias("content")).limit(0)
    least = math.ceil(LEAST * sizes[0] - 1e-9)
    gap = math.floor(FOREIGN * sizes[1] + 1e-9) + 1
    size = longs(sizes[2])

    def held(bits: Column, h: Column) -> Column:
        there = F.get(bits, h.bitwiseAND(F.lit(size - 1)).cast("int"))
        return F.call_function("shiftrightunsigned", there, _bit(h)).bitwiseAND(F.lit(1)) == 1

    def of(every: Column, at: Column) -> Column:
        first = F.array_compact(F.transform(at, lambda p, i: F.when(
            (i == 0) | (p - F.get(at, i - 1) > gap), i)))
        last = F.array_compact(F.transform(at, lambda p, i: F.when(
            (i == F.size(at) - 1) | (F.get(at, i + 1) - p > gap), i)))
        rich = F.filter(F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                        lambda z: z["b"] - z["a"] >= least - 1)
        return F.transform(rich, lambda z: F.struct(F.get(at, z["a"]).alias("start"), F.slice(
            every, F.get(at, z["a"]) + 1, F.get(at, z["b"]) - F.get(at, z["a"]) + 1).alias("content")))

    # A scalar subquery that is used once: the optimiser moves it there, so no row carries it
    # (used twice, it would be copied into each row).
    # An outer generator has no conditions that could be moved below it and make the shingles again.
    held_by = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                          bitmap(parts, size).scalar().alias("bits"))
    found = let(shingles(words("text")), lambda every: let(
        F.array_compact(F.transform(every, lambda h, i: F.when(held(F.col("bits"), h), i))),
        lambda at: F.when(F.size(at) >= least, of(every, at))))
    return held_by.select("id", found.alias("zones")).select("id", F.inline_outer("zones")).filter(
        "content is not null")


LANE = 16  # bits of a packed count
LANES = sum(1 << i for i in range(0, 64, LANE))


def simhash(content: str) -> Column:
    """A bit is set if it is in over half the hashes, of which there are ``PART`` at most.
    Four counts are packed into a long; none of them reaches the upper half of its lane."""
    sums = F.aggregate(
        F.col(content), F.array_repeat(F.lit(0).cast("bigint"), LANE),
        lambda acc, h: F.transform(acc, lambda x, k: x + F.call_function(
            "shiftrightunsigned", h, k).bitwiseAND(F.lit(LANES))))
    # With this added, counts above half have the last bit but one of their lane set.
    top = LANE - 2
    more = (F.lit((1 << top) - 1) - F.floor(F.size(content) / 2).cast("bigint")) * F.lit(LANES)
    bits = F.transform(sums, lambda x: F.shiftrightunsigned(x + more, top).bitwiseAND(F.lit(LANES)))
    return F.aggregate(bits, F.struct(
        F.lit(0).cast("bigint").alias("fp"), F.lit(0).alias("k")), lambda acc, x: F.struct(
        acc["fp"].bitwiseOR(F.call_function("shiftleft", x, acc["k"])).alias("fp"),
        (acc["k"] + 1).alias("k")))["fp"]


def _blocks(near: bool) -> Column:
    """Keys of a fingerprint's blocks; of all values near to them too."""

    def neighbours(key: Column, bits: int) -> Column:
        masks = [sum(1 << i for i in some) for r in range(RADIUS // len(BLOCKS) + 1)
                 for some in combinations(range(bits), r)]
        # The masks travel as text: thousands of literals would make a long plan.
        constant = F.transform(F.split(F.lit(" ".join(map(str, masks))), " "), lambda m: m.cast("int"))
        return F.transform(constant, lambda m: key.bitwiseXOR(m))

    keys = []
    for b, (start, bits) in enumerate(BLOCKS):
        value = F.shiftrightunsigned(F.col("fp"), start).bitwiseAND(F.lit((1 << bits) - 1))
        key = value.bitwiseOR(F.lit(b << 13)).cast("int")
        keys.append(neighbours(key, bits) if near else F.array(key))
    return F.concat(*keys)


def _shared(a: Column, b: Column) -> Column:
    """Size of the common part of two bags."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))

    def count(bag: Column, x: Column) -> Column:
        return F.size(F.filter(bag, lambda y: y == x))

    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(F.aggregate(
        F.array_intersect(a, b), F.lit(0),
        lambda acc, x: acc + F.least(count(a, x), count(b, x))))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, similarity)`` of every document with a window like an item.

    The best similarity counts, of an item in parts that of its best part, to six digits.
    Texts of fewer than five words, empty and NULL ones match nothing. Repeated rows of one
    id count as one document; rows with a NULL id are one document without id. Equal items
    are all reported. Other columns are ignored; an empty table on either side gives no rows.
    """
    parts = common.checkpoint(items(benchmark, item_col, item_text_col))
    found = common.checkpoint(zones(docs, parts, id_col, text_col))
    # Few rows that each make many windows or keys: dealt out before, in a number AQE leaves alone.
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism,
                math.ceil(max(found.count(), parts.count()) / TASK_ROWS))
    contents = common.checkpoint(found.select("content").distinct().repartition(tasks).select(
        F.monotonically_increasing_id().alias("zone"), "content"))

    need = F.ceil(F.lit(LEAST) * F.col("n") - 1e-9).cast("int")
    # What a window and an item share is at least ``need`` of the shingles of each.
    in_zones = contents.select("zone", F.explode("content").alias("h"))
    distinct = parts.select("n", "content").distinct().repartition(tasks)
    patterns = common.checkpoint(distinct.select(
        F.monotonically_increasing_id().alias("pattern"), "n", "content"))
    in_patterns = patterns.select("pattern", "n", F.explode("content").alias("h"))
    sizes = in_zones.join(in_patterns.select("h", "n").distinct(), "h").groupBy("zone", "n").count().filter(
        F.col("count") >= need).select("zone", "n")
    held = in_patterns.join(in_zones.select("h").distinct(), "h", "left_semi").groupBy("pattern", "n").count().filter(
        F.col("count") >= need).select("pattern")

    sized = sizes.join(contents, "zone").filter(F.size("content") >= need).repartition(tasks)
    windows = sized.select("zone", "n", "content", F.explode(F.sequence(
        F.lit(0), F.size("content") - need)).alias("s")).select(
        "zone", "n", "s", F.slice("content", F.col("s") + 1, F.col("n")).alias("window"))
    prints = windows.select("zone", "n", "s", simhash("window").alias("fp"))
    probes = prints.select("zone", "n", "s", "fp", F.explode(_blocks(False)).alias("key"))
    index = patterns.join(held, "pattern").repartition(tasks).select(
        "pattern", "n", simhash("content").alias("fp")).select(
        "pattern", "n", F.col("fp").alias("item_fp"), F.explode(_blocks(True)).alias("key"))
    # Both sides are estimated far too small, as they are exploded: never broadcast.
    near = probes.hint("merge").join(index, (probes["key"] == index["key"]) & (probes["n"] == index["n"]) & (
        F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)).select(
        "zone", probes["n"], "s", "pattern").distinct()

    # Verification, on what is near alone.
    pairs = near.join(contents, "zone").join(
        patterns.select("pattern", F.col("content").alias("wanted")), "pattern").select(
        "zone", "pattern", "wanted", F.slice("content", F.col("s") + 1, F.col("n")).alias("window"))
    common_at = F.array_compact(F.transform(
        "window", lambda h, i: F.when(F.array_contains(F.col("wanted"), h), i)))
    trimmed = pairs.withColumn("at", common_at).filter(F.size("at") > 0).select(
        "zone", "pattern", "wanted", F.slice("window", F.get("at", F.lit(0)) + 1, F.element_at(
            "at", -1) - F.get("at", F.lit(0)) + 1).alias("window"))
    shared = trimmed.select("zone", "pattern", (F.size("wanted") + F.size("window")).alias("sizes"),
                            _shared(F.col("window"), F.col("wanted")).alias("shared"))
    similar = shared.select("zone", "pattern", (F.col("shared") / (F.col("sizes") - F.col("shared"))).alias(
        "similarity")).filter(F.col("similarity") >= LEAST - 1e-9).groupBy("zone", "pattern").agg(
        F.max("similarity").alias("similarity"))
    owners = patterns.join(parts.select("item", "n", "content"), ["n", "content"]).select("pattern", "item")
    hits = similar.join(contents, "zone").join(owners, "pattern").select("content", "item", "similarity")
    return found.join(hits, "content").groupBy("id", "item").agg(
        F.round(F.max("similarity"), 6).alias("similarity")).select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "similarity")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, without contaminated documents: all rows
    of an id are one document, rows without id are documents of their own."""
    # The verdict depends on the text alone, so rows without id are known by its digest.
    key = common.unused("key", docs.columns)
    text, none = F.col(text_col).cast("string"), F.col(id_col).isNull()
    keyed = docs.withColumn(key, F.when(none, F.struct(F.lit(None).cast(docs.schema[id_col].dataType).alias(
        "id"), F.coalesce(F.sha2(text, 256), F.lit("")).alias("digest"))).otherwise(
            F.struct(F.col(id_col).alias("id"), F.lit("").alias("digest"))))
    bad = matches(keyed, benchmark, key, text_col).select(
        F.col(f"{key}.id").alias("_bad"), F.col(f"{key}.digest").alias("_digest")).distinct()
    return keyed.join(bad, F.col(f"{key}.id").eqNullSafe(bad["_bad"]) & (
        F.col(f"{key}.digest") == bad["_digest"]), "left_anti").select(*docs.columns)


# The same by brute force: all windows that begin and end with a shingle of the item.
ORACLE_SQL = """
WITH doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
  FROM documents
), item_words AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w
  FROM benchmark
), doc_shingles AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, w FROM doc_words
), d AS (
  SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS s FROM doc_shingles
), item_shingles AS (
  SELECT item_id, unnest(range(1, len(w) - 3)) AS p, w FROM item_words
), i AS (
  SELECT item_id, array_to_string(w[p:p + 4], ' ') AS s, count(*) AS c FROM item_shingles GROUP BY ALL
), sizes AS (
  SELECT item_id, sum(c) AS n FROM i GROUP BY item_id
), shared AS (
  SELECT doc_id, item_id, p, s, c, n FROM d JOIN i USING (s) JOIN sizes USING (item_id)
), windows AS (
  SELECT a.doc_id, a.item_id, a.n, a.p AS first, b.s, b.c, count(*) AS k, max(b.p) AS last
  FROM shared a JOIN shared b ON a.doc_id = b.doc_id AND a.item_id = b.item_id
    AND b.p BETWEEN a.p AND a.p + a.n - 1
  GROUP BY ALL
), scored AS (
  SELECT doc_id, item_id, first, n, sum(least(k, c)) AS m, max(last) - first + 1 AS size
  FROM windows GROUP BY doc_id, item_id, first, n
)
SELECT doc_id, item_id, round(max(m / (n + size - m)), 6) AS similarity
FROM scored GROUP BY doc_id, item_id HAVING max(m / (n + size - m)) >= 0.8 - 1e-9
"""
