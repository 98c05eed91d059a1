"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors of one label are compared with each other. They are scaled to length one, turned
into the principal axes of all vectors, and cut into tiles of ``TILE`` vectors along the
first axis. Two tiles whose stretches on that axis lie too far apart hold no link and never
meet. The others are compared in steps: products over the leading dimensions are summed
first, the rest of a product is at most the product of both suffix norms, and a tile pair
stops, or goes on with fewer rows and columns, once no cosine can reach the threshold.
Whatever remains is decided by the cosine of the given numbers in double precision.

Equal vectors of a label are compared once and counted as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import FloatType

from . import common

LEAST = 0.93
TILE = 2048
STEPS = (4, 12, 28)  # leading dimensions after which products are bounded
SLACK = 1e-9
DIMENSIONS = 8  # vector lengths that get axes of their own; others keep theirs


def checked(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(vec_id, label, vec, usable)``: label and vector not NULL, finite, not all zero.

    Floats stay floats, half as much to move, until they are compared in double precision.
    """
    given = vectors.schema[vector_col].dataType.elementType
    kind = "float" if isinstance(given, FloatType) else "double"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(
        vector_col, lambda x: x.cast(kind)).alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    fine = F.col("label").isNotNull() & ~odd & F.exists("vec", lambda x: x != 0)
    return rows.withColumn("usable", F.coalesce(fine, F.lit(False)))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest entry first, so that nothing overflows."""
    rows = np.asarray(rows, np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _stacked(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and rows of a list column, by length of the lists."""
    lengths = np.asarray(column.value_lengths())
    values, offsets = np.asarray(column.flatten()), np.r_[0, np.cumsum(lengths)]
    out = {}
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out[int(n)] = at, values[offsets[at][:, None] + np.arange(n)]
    return out


def axes(distinct: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes by dimension, most variance first: from sums over all vectors, made
    by the tasks; numbers in the square of the dimension reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, (_, rows) in _stacked(batch.column(0)).items():
                rows = unit(rows)
                total[n] = total.get(n, 0) + rows.T @ rows
        for n, m in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, n, np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                 pa.array(m.tolist())], ["n", "i", "row"])

    common_n = distinct.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(DIMENSIONS)
    sums = distinct.select("vec").mapInArrow(run, "n int, i int, row array<double>").join(
        common_n.select("n"), "n", "left_semi").select("n", "i", F.posexplode("row").alias("j", "x")).groupBy(
        "n", "i", "j").agg(F.sum("x").alias("x")).toPandas()
    out = {}
    for n, some in sums.groupby("n"):
        matrix = np.zeros((n, n))
        matrix[some["i"], some["j"]] = some["x"]
        out[int(n)] = np.linalg.eigh((matrix + matrix.T) / 2)[1][:, ::-1]
    return out


def near(a: np.ndarray, b: np.ndarray, given_a: np.ndarray, given_b: np.ndarray,
         least: float = LEAST, steps: tuple[int, ...] = STEPS) -> np.ndarray:
    """Which rows of ``a`` and ``b`` (turned, of length one) link: a matrix of booleans.
    ``given_*`` are the rows before turning."""
    rows, cols = np.arange(len(a)), np.arange(len(b))
    partial, at = np.zeros((len(a), len(b))), 0
    left_a = np.sqrt(np.maximum(np.cumsum((a * a)[:, ::-1], 1)[:, ::-1], 0))
    left_b = np.sqrt(np.maximum(np.cumsum((b * b)[:, ::-1], 1)[:, ::-1], 0))
    links = np.zeros((len(a), len(b)), bool)
    for stop in (s for s in steps if s < a.shape[1]):
        partial = partial + a[rows, at:stop] @ b[cols, at:stop].T
        at = stop
        open_ = partial + np.outer(left_a[rows, at], left_b[cols, at]) >= least - SLACK
        some, other = open_.any(1), open_.any(0)
        rows, cols = rows[some], cols[other]
        if not len(rows):
            return links
        partial = partial[some][:, other]
    links[np.ix_(rows, cols)] = given_a[rows] @ given_b[cols].T >= least
    return links


def spanning(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of rows and columns: equal where links connect them, -1 without any link."""
    n, m = links.shape
    none = n + m
    row = np.where(links.any(1), np.arange(n), none)
    while True:
        col = np.where(links, row[:, None], none).min(0)
        low = np.minimum(row, np.where(links, col[None, :], none).min(1))
        if (low == row).all():
            return np.where(row == none, -1, row), np.where(col == none, -1, col)
        row = low


def _compare(group: pd.DataFrame, basis: dict[int, np.ndarray], least: float) -> pd.DataFrame:
    """Links of one pair of tiles: links counted per vector, and edges that connect them."""
    group = group.sort_values(["tile", "node"], ignore_index=True)
    same = group["a"].iloc[0] == group["b"].iloc[0]
    first = (group["tile"] == group["a"]).to_numpy()
    pick = [np.flatnonzero(first), np.flatnonzero(first if same else ~first)]
    given = unit(np.stack(group["vec"].to_numpy()))
    turned = given @ basis.get(given.shape[1], np.eye(given.shape[1]))
    links = near(turned[pick[0]], turned[pick[1]], given[pick[0]], given[pick[1]], least)
    if same:
        np.fill_diagonal(links, False)
        links |= links.T
    # In a tile itself rows and columns are the same vectors.
    reach = links | np.diag(links.any(1)) if same else links
    nodes, weight = group["node"].to_numpy(), group["n"].to_numpy()
    row, col = spanning(reach)
    out = [pd.DataFrame({"node": nodes[pick[0]], "links": links @ weight[pick[1]], "label": row})]
    if not same:
        out.append(pd.DataFrame({"node": nodes[pick[1]], "links": links.T @ weight[pick[0]], "label": col}))
    done = pd.concat(out)
    done = done[done["label"] >= 0]
    return pd.DataFrame({"node": done["node"], "links": done["links"].astype("int64"),
                         "other": nodes[pick[0]][done["label"].to_numpy()]})


def tiles(distinct: DataFrame, basis: dict[int, np.ndarray], size: int = TILE) -> DataFrame:
    """``(label, d, node, n, vec, x, tile)``: tiles of at most ``size`` vectors of one label
    and dimension, in the order of their place ``x`` on the first axis."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.zeros(batch.num_rows)
            for d, (at, rows) in _stacked(batch.column(4)).items():
                x[at] = unit(rows) @ basis.get(d, np.eye(d))[:, 0]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(x)], [*batch.schema.names, "x"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order; a tile ends when it is full or the label or dimension is."""
        from pyspark import TaskContext

        tile, held, last = TaskContext.get().partitionId() << 40, 0, None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            out = []
            for key in keys:
                if key != last or held == size:
                    tile, held, last = tile + 1, 0, key
                held += 1
                out.append(tile)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "tile"])

    label = distinct.schema["label"].dataType.simpleString()
    vec = distinct.schema["vec"].dataType.simpleString()
    kinds = f"label {label}, d int, node bigint, n bigint, vec {vec}, x double"
    return (
        distinct.select("label", "d", "node", "n", "vec").mapInArrow(turn, kinds)
        .repartitionByRange("label", "d", "x").sortWithinPartitions("label", "d", "x", "node")
        .mapInArrow(number, f"{kinds}, tile bigint")
    )


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", least: float = LEAST) -> DataFrame:
    """Per row: id, ``n_links`` (other rows linked directly), ``component_id`` (smallest id
    reachable over links, itself included), ``kept`` (whether the two are one).

    Rows link only under equal labels that are not NULL. Vectors that are NULL, empty or zero
    or hold a NULL, NaN or infinity link with nothing, nor do vectors of different lengths. A
    repeated row is another row, also with the same id. A NULL id names no component; its
    row is not kept. Other columns are ignored; an empty table gives no rows.
    """
    every = checked(vectors, id_col, vector_col, label_col)
    rows = common.checkpoint(every.filter("usable").drop("usable"))
    distinct = common.checkpoint(rows.groupBy("label", "vec").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("least")).select(
        F.monotonically_increasing_id().alias("node"), "label", F.size("vec").alias("d"), "vec", "n", "least"))
    basis = axes(distinct)
    tiled = common.checkpoint(tiles(distinct, basis))
    spans = tiled.groupBy("label", "d", "tile").agg(
        F.min("x").alias("low"), F.max("x").alias("high"))
    reach = math.sqrt(2 - 2 * least) + SLACK  # how far linked vectors lie apart on an axis
    a, b = spans.alias("a"), spans.alias("b")
    pairs = common.checkpoint(a.join(b, (F.col("a.label") == F.col("b.label")) & (
        F.col("a.d") == F.col("b.d")) & (F.col("a.tile") <= F.col("b.tile")) & (
        F.col("b.low") - F.col("a.high") <= reach) & (F.col("a.low") - F.col("b.high") <= reach)).select(
        F.col("a.tile").alias("a"), F.col("b.tile").alias("b")))
    used = pairs.select(F.col("a").alias("tile"), "a", "b").union(
        pairs.filter("a <> b").select(F.col("b").alias("tile"), "a", "b"))
    met = tiled.select("tile", "node", "n", "vec").join(used, "tile")
    found = common.checkpoint(met.groupBy("a", "b").applyInPandas(
        lambda group: _compare(group, basis, least), "node bigint, links bigint, other bigint"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = common.components(found.select("node", "other"), "node", "other")
    # Vectors move once to learn their rows' nodes; all else is joined without them.
    named = distinct.select("node", "n", "least").join(links, "node", "left").join(
        linked, "node", "left").withColumn("root", F.coalesce("component", "node"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = named.join(smallest, "root").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    members = rows.join(distinct.select("node", "label", "vec"), ["label", "vec"]).select("vec_id", "node")
    good = members.join(by_node, "node").select("vec_id", "n_links", "component_id")
    alone = every.filter("not usable").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.union(alone).select(
        F.col("vec_id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
