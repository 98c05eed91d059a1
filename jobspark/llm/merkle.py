"""Merkle manifest of a dataset: a root over all rows, and a proof for each of them.

Leaves are grouped into one tree per source, the roots of these trees into one more tree.
Only every third level is kept (written to the shared folder, so that a lost executor costs
one level): 27 nodes of a kept level become one of the next. For the proofs the levels are
walked from the root downwards; the nodes in between are computed anew from the kept ones
below them, give their siblings and are forgotten. All of it is DataFrame functions, every
group has at most 27 rows, and a source of any share of the rows is spread like the rest.

Defined results: rows without id come first in their source and are not tampered with; rows of
one id are ordered by their leaf, so equal rows stand side by side, each with a proof of its own.
A NULL source is a tree of its own, before all others. An empty table has no root and no proof.
Other columns of any name are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

WIDTH = 3
STRIDE = 3
SPAN = WIDTH ** STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """The value with its length in bytes before it; ``-`` if there is none."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    return F.sha2(F.concat(*[field(changed.get(name, F.col(name))) for name in FIELDS]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``tree, source, doc_id, digest``: a row per document."""
    return docs.select(field(F.col("source")).alias("tree"), "source", "doc_id",
                       leaf().alias("digest"))


def without_breaks(docs: DataFrame) -> DataFrame:
    """The leaves, and in ``tampered`` those of texts that lost their line breaks wherever 2
    divides the check sum of the id."""
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return docs.select(
        field(F.col("source")).alias("tree"), "source", "doc_id", leaf().alias("digest"),
        F.when(struck & F.contains("text", F.lit("\n")),
               leaf(text=F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered"))


def number(nodes: DataFrame, *order: Column) -> DataFrame:
    """Adds the place ``pos`` of a node in its tree and the tree's number of nodes ``n``.

    Rows are dealt out by ranges of (tree, order), so that a large tree takes many tasks; only
    counts per task are added up.
    """
    names = [F.col("tree"), *order]
    placed = common.written(
        nodes.repartitionByRange(*names).sortWithinPartitions(*names)
        .withColumn("at", F.monotonically_increasing_id()), "merkle-placed")
    part = F.shiftright("at", 33).alias("part")
    tree = Window.partitionBy("tree")
    starts = placed.groupBy("tree", part).agg(F.min("at").alias("first"), F.count("*").alias("held")).select(
        F.col("tree"), "part",
        (F.coalesce(F.sum("held").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                    F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("held").over(tree).alias("n"))
    return placed.select("*", part).join(starts, ["tree", "part"]).withColumn(
        "pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def parent(array: str) -> Column:
    """The digests one level above those in column ``array``."""
    return F.transform(
        F.sequence(F.lit(0), F.expr(f"(size({array}) - 1) div {WIDTH}")),
        lambda i: F.sha2(F.array_join(F.slice(array, i * WIDTH + 1, WIDTH), ""), 256))


def levels_up() -> Column:
    """How many levels a group climbs: a whole stride while more than one group is left."""
    climb = F.lit(STRIDE)
    for k in reversed(range(STRIDE)):
        climb = F.when(F.col("n") <= WIDTH ** k, k).otherwise(climb)
    return climb


def subtrees(level: DataFrame, *carried: str) -> DataFrame:
    """Groups of 27 neighbours with the digests of their levels in ``l0`` to ``l3``."""
    groups = level.filter("n > 1").groupBy("tree", F.expr(f"pos div {SPAN}").alias("g")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", *carried))).alias("nodes"),
        F.first("n").alias("n"))
    groups = groups.withColumn("climb", levels_up()).withColumn("l0", F.col("nodes.digest"))
    for k in range(STRIDE):
        groups = groups.withColumn(f"l{k + 1}", parent(f"l{k}"))
    return groups


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The kept levels (``tree, pos, n, digest``), ``nodes`` first, until every tree has one node."""
    kept, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        top = F.coalesce(*[F.when(F.col("climb") == k, F.col(f"l{k}")[0]) for k in range(1, STRIDE + 1)])
        kept.append(common.written(subtrees(kept[-1]).select(
            "tree", F.col("g").alias("pos"),
            F.expr(f"(n + {SPAN - 1}) div {SPAN}").alias("n"), top.alias("digest")), "merkle-level"))
        most = -(-most // SPAN)
    return kept


def roots(kept: list[DataFrame]) -> DataFrame:
    """``tree, root`` of every tree."""
    found = [level.filter("n = 1").select("tree", F.col("digest").alias("root")) for level in kept]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def step(k: int, i: Column) -> Column:
    """Siblings left and right of the ancestor, ``k`` levels up, of the ``i``-th node of a group."""
    here = F.floor(i / WIDTH ** k).cast("int")
    start = F.floor(i / WIDTH ** (k + 1)).cast("int") * WIDTH
    return F.struct(F.array_join(F.slice(f"l{k}", start + 1, here - start), "").alias("left"),
                    F.array_join(F.slice(f"l{k}", here + 2, start + WIDTH - 1 - here), "").alias("right"))


def paths(kept: list[DataFrame], above: DataFrame, *carried: str) -> DataFrame:
    """``tree, pos, digest, root, path`` and ``carried`` of every node of the lowest level.

    ``path`` holds the siblings left and right of each ancestor, from the leaf upwards; ``above``
    (``tree, path, …``) is what a tree's root goes on with, its other columns are handed down.
    """
    outer = [c for c in above.columns if c not in ("tree", "path")]
    down = None
    for level, table in reversed(list(enumerate(kept))):
        extra = carried if level == 0 else ()
        ended = table.filter("n = 1").join(above, "tree").select(
            "tree", "pos", "digest", *extra, "path", F.col("digest").alias("root"), *outer)
        if down is None:
            down = ended
            continue
        own = F.transform("nodes", lambda x, i: F.struct(
            *[x[c].alias(c) for c in ("pos", "digest", *extra)],
            F.slice(F.array(*[step(k, i) for k in range(STRIDE)]), F.lit(1), F.col("climb")).alias("own")))
        groups = subtrees(table, *extra).select("tree", F.col("g").alias("pos"), own.alias("nodes"))
        groups = groups.join(down.drop("digest", *carried), ["tree", "pos"])
        if level + 1 < len(kept) - 1:
            down = common.written(down, "merkle-paths")  # a level at a time keeps plans small
        # No group is empty; the outer form keeps Spark from testing the whole expression for it.
        down = groups.select("tree", F.explode_outer("nodes").alias("x"), "path", "root", *outer).select(
            "tree", "x.pos", "x.digest", *[f"x.{c}" for c in extra],
            F.concat("x.own", "path").alias("path"), "root", *outer).union(ended)
    return down


def proofs(rows: DataFrame, *carried: str) -> DataFrame:
    """A proof for every leaf: ``doc_id, digest`` (the leaf), ``carried``, ``path``, ``subroot``, ``root``."""
    carried = ("doc_id", *carried)
    rows = common.written(rows, "merkle-leaves")  # texts are read and hashed once
    low = climb(number(rows, F.col("doc_id").asc_nulls_first(), F.col("digest")))
    sources = rows.groupBy("tree").agg(F.first("source").alias("source"))
    tops = roots(low).join(sources, "tree").select(
        F.lit("").alias("tree"), "source", F.col("tree").alias("name"), F.col("root").alias("digest"))
    high = climb(number(tops, F.col("source").asc_nulls_first()))
    whole = roots(high).first()
    nothing = rows.sparkSession.createDataFrame(
        [("", [])], "tree string, path array<struct<left:string,right:string>>")
    above = paths(high, nothing, "name").select(F.col("name").alias("tree"), "path")
    return paths(low, above, *carried).select(
        *carried, "digest", "path", F.col("root").alias("subroot"),
        F.lit(whole and whole["root"]).cast("string").alias("root"))


def fold(start: Column, path: str = "path") -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def siblings_digest(path: str = "path") -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def audit(docs: DataFrame) -> DataFrame:
    """The manifest's digests for every document, and whether its tampered form still verifies."""
    folded = proofs(without_breaks(docs), "tampered").select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root",
        siblings_digest().alias("proof_sha256"),
        fold(F.coalesce("tampered", "digest")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text in SQL; ``t``, a column of ``crc_table``, has the 256 remainders."""
    return (f"xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT),"
            " lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)")


CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda a, b: xor(a >> 1, 3988292384 * (a & 1))) ORDER BY i) AS t
  FROM range(256) r(i))"""


def _field_sql(column: str) -> str:
    return (f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')")


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(text if f == "text" else f) for f in FIELDS) + ")"


ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS (
  SELECT doc_id, {_field_sql('source')} AS tree, source, {_leaf_sql('text')} AS leaf,
         CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 2 = 0
              THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS tampered
  FROM documents, crc_table),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY tree) AS n
  FROM leaves),
low AS (
  SELECT tree, 0 AS lvl, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM low WHERE n > 1 GROUP BY tree, lvl, pos // 3, n),
subroots AS (
  SELECT tree, digest AS subroot, lvl AS height FROM low WHERE n = 1),
tops AS (
  SELECT tree, subroot, height,
         row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS top_pos, count(*) OVER () AS top_n
  FROM subroots JOIN (SELECT DISTINCT tree, source FROM leaves) USING (tree)),
high AS (
  SELECT 0 AS lvl, top_pos AS pos, top_n AS n, subroot AS digest FROM tops
  UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM high WHERE n > 1 GROUP BY lvl, pos // 3, n),
whole AS (SELECT digest AS root, lvl AS height FROM high WHERE n = 1),
steps AS (
  SELECT p.tree, p.pos AS leaf_pos, l.lvl, l.pos, (p.pos // (3 ** l.lvl)::BIGINT) AS here, l.digest
  FROM placed p JOIN low l ON l.tree = p.tree AND l.n > 1
   AND l.pos // 3 = p.pos // (3 ** (l.lvl + 1))::BIGINT
  UNION ALL
  SELECT p.tree, p.pos, t.height + h.lvl, h.pos, (t.top_pos // (3 ** h.lvl)::BIGINT), h.digest
  FROM placed p JOIN tops t ON t.tree = p.tree JOIN high h ON h.n > 1
   AND h.pos // 3 = t.top_pos // (3 ** (h.lvl + 1))::BIGINT),
runs AS (
  SELECT tree, leaf_pos, lvl,
         coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos < here), '') AS l,
         coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos > here), '') AS r
  FROM steps GROUP BY tree, leaf_pos, lvl),
folds AS (
  SELECT tree, pos, 0 AS lvl, tampered AS acc FROM placed
  UNION ALL
  SELECT f.tree, f.pos, f.lvl + 1, sha256(r.l || f.acc || r.r)
  FROM folds f JOIN runs r ON r.tree = f.tree AND r.leaf_pos = f.pos AND r.lvl = f.lvl),
proofs AS (
  SELECT tree, leaf_pos AS pos, string_agg(l || r, '' ORDER BY lvl) AS siblings FROM runs GROUP BY tree, leaf_pos)
SELECT p.doc_id, p.leaf, t.subroot, w.root, sha256(coalesce(s.siblings, '')) AS proof_sha256,
       f.acc AS folded_root, f.acc = w.root AS verified
FROM placed p JOIN tops t USING (tree) CROSS JOIN whole w
JOIN folds f ON f.tree = p.tree AND f.pos = p.pos AND f.lvl = t.height + w.height
LEFT JOIN proofs s ON s.tree = p.tree AND s.pos = p.pos
"""
