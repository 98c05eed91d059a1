"""Filtered top-k similarity search for many requests at once."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .. import domains, session
from ..functions import text
from . import block_top
from .embedding import Embedder
from .topn import first_per_key, ranked

# vector: array of numbers, sources: array of strings or NULL for all.
REQUEST_FIELDS = ["request_id", "vector", "model_name", "sources", "remote_only",
                  "minimum_salary", "location"]
_FILTERS = REQUEST_FIELDS[2:]
_NEAR = ("request_id STRING, chunk_id STRING, job_posting_id STRING, content_hash STRING, "
         "distance DOUBLE")
_CELLS = 4_000_000  # numbers in one distance block


def top_k_of(requested: int, most: int | None = None) -> int:
    """At least one, and at most ``most`` where a caller names such a bound."""
    return max(1, int(requested if most is None else min(requested, most)))


def pool_of(top_k: int) -> int:
    """Chunks drawn before duplicates of a posting fall away."""
    return max(top_k * 10, 50)


def with_defaults(requests: DataFrame) -> DataFrame:
    """Search requests with the fields of their profile filled in.

    Expects request_id, query, remote_only, minimum_salary, location and the profile
    columns target_roles, remote_preference, salary_min, locations_preferred.
    """
    roles = F.coalesce("target_roles", F.array().cast("array<string>"))
    places = F.coalesce("locations_preferred", F.array().cast("array<string>"))
    only = F.get(places, F.lit(0))
    asked = text.clean_space("query")
    place = F.when((F.size(places) == 1) & (F.lower(only) != "remote"), only)
    return requests.select(
        "request_id",
        F.when(F.size(roles) > 0,
               F.concat(asked, F.lit(". Target roles: "), F.array_join(roles, ", ")))
        .otherwise(asked).alias("search_text"),
        (F.coalesce("remote_only", F.lit(False))
         | F.coalesce(F.col("remote_preference") == "remote_only", F.lit(False))
         ).alias("remote_only"),
        F.coalesce("minimum_salary", "salary_min").cast("double").alias("minimum_salary"),
        F.coalesce(text.none_if_empty("location"), place).alias("location"),
    )


def embedded(requests: DataFrame, embedder: Embedder, model: str) -> DataFrame:
    """Requests with the vector of their ``search_text``, to be compared with the chunks
    of the same model. Missing filter columns admit everything."""
    vectored = embedder(requests, "search_text").withColumns({
        "vector": F.col("embedding").cast("array<double>"), "model_name": F.lit(model)})
    absent = {"sources": "array<string>", "remote_only": "boolean", "minimum_salary": "double",
              "location": "string"}
    return vectored.drop("embedding").withColumns({
        c: F.lit(None).cast(kind) for c, kind in absent.items() if c not in requests.columns})


def like_pattern(value: str) -> re.Pattern:
    """``%value%`` of a case-insensitive LIKE; % and _ inside keep their meaning."""
    out, escaped = [], False
    for ch in f"%{value}%":
        if escaped:
            out.append(re.escape(ch))
            escaped = False
        elif ch == "\\":
            escaped = True
        else:
            out.append({"%": ".*", "_": "."}.get(ch) or re.escape(ch))
    return re.compile("".join(out), re.IGNORECASE | re.DOTALL)


def _stack(column) -> np.ndarray:
    rows = column.to_numpy()
    if len({len(v) for v in rows}) > 1:
        raise ValueError("Vectors differ in dimension.")
    return np.concatenate(rows).astype(np.float64).reshape(len(rows), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def _wanted(sources) -> list[str]:
    return [] if sources is None else [s.lower() for s in sources if s]


class _Facts:
    """The filters on a block of candidates. Masks by value are shared by its requests."""

    def __init__(self, cand: pd.DataFrame):
        self.source = cand["source"]
        self.remote = np.fromiter((v is True or v is np.True_ for v in cand["remote"]), bool, len(cand))
        self.salary = cand["salary_max"].to_numpy(dtype="float64", na_value=np.nan)
        self.location = cand["location"].to_numpy(dtype=object)
        self._masks: dict = {}

    def _mask(self, key, make) -> np.ndarray:
        if key not in self._masks:
            if len(self._masks) >= 1000:
                self._masks.clear()
            self._masks[key] = make()
        return self._masks[key]

    def _at(self, location: str) -> np.ndarray:
        fits = like_pattern(location.strip()).fullmatch
        hit = {n: isinstance(n, str) and bool(fits(n)) for n in set(self.location)}
        return np.fromiter((hit[n] for n in self.location), bool, len(self.location))

    def admitted(self, rows: np.ndarray, sources, remote_only, salary, location) -> np.ndarray:
        """Which of some rows meet the filters, as a mask."""
        ok = np.ones(len(rows), bool)
        wanted = _wanted(sources)
        if wanted:
            ok &= self._mask(tuple(wanted), lambda: self.source.isin(wanted).to_numpy())[rows]
        if remote_only:
            ok &= self.remote[rows]
        if salary is not None and not pd.isna(salary):
            ok &= self.salary[rows] >= salary
        if location:
            ok &= self._mask(location, lambda: self._at(location))[rows]
        return ok


def _grouped(req: pd.DataFrame) -> dict:
    """model -> vector -> filters -> positions of the requests that share all of them."""
    groups: dict = {}
    for pos, row in enumerate(req[_FILTERS].itertuples(index=False)):
        key = tuple(tuple(v) if isinstance(v, (list, np.ndarray)) else
                    None if isinstance(v, float) and np.isnan(v) else v for v in row)
        vector = np.asarray(req["vector"].iloc[pos], np.float64).tobytes()
        groups.setdefault(key[0], {}).setdefault(vector, {}).setdefault(key[1:], []).append(pos)
    return groups


_CHUNK = ["id", "job_posting_id", "content_hash"]
_EMITTED = 20_000  # rows that leave a task at once


def _hits(cand: pd.DataFrame, req: pd.DataFrame, groups: dict, pool: int,
          farthest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of request and candidate, and distance, of the ``pool`` nearest candidates of
    each request by (distance, id), and no farther than ``farthest``."""
    none = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0)
    if not len(cand) or not len(req):
        return none
    by_id, facts = _order(cand["id"].to_numpy()), _Facts(cand)
    who, what, far = [], [], []
    for model, vectors in groups.items():  # models may differ in dimension
        at = np.flatnonzero((cand["model_name"] == model).to_numpy()).astype(np.int32)
        if not len(at):
            continue
        unit, each = _unit(_stack(cand["embedding"].iloc[at])), list(vectors.values())
        width = max(1, _CELLS // len(at))
        for first in range(0, len(each), width):
            part = each[first: first + width]
            wanted = _unit(_stack(req["vector"].iloc[[next(iter(x.values()))[0] for x in part]]))
            # Equal vectors are equally far, whatever the last bits of their sums.
            distance = np.round(1.0 - wanted @ unit.T, 12)
            distance[np.isnan(distance)] = np.inf  # a vector of zeros is near nothing
            for row, alike in zip(distance, part):
                for filters, members in alike.items():
                    most = np.inf if farthest is None else farthest[members].max()
                    near = np.flatnonzero((row <= most) & (row < np.inf))
                    near = near[facts.admitted(at[near], *filters)]
                    if len(near) > pool:
                        there = row[near]
                        near = near[there <= np.partition(there, pool - 1)[pool - 1]]
                        near = near[np.lexsort((by_id[at[near]], row[near]))[:pool]]
                    if len(near):
                        who.append(np.repeat(np.asarray(members, np.int32), len(near)))
                        what.append(np.tile(at[near], len(members)))
                        far.append(np.tile(row[near], len(members)))
    return (np.concatenate(who), np.concatenate(what), np.concatenate(far)) if who else none


def _order(ids: np.ndarray) -> np.ndarray:
    """The place of each id in their order."""
    out = np.empty(len(ids), np.int32)
    out[np.argsort(ids, kind="stable")] = np.arange(len(ids), dtype=np.int32)
    return out


def _rows(names: np.ndarray, chunks: pd.DataFrame, who, what, far) -> pd.DataFrame:
    out = chunks[_CHUNK].iloc[what].rename(columns={"id": "chunk_id"}).reset_index(drop=True)
    out.insert(0, "request_id", names[who])
    return out.assign(distance=far)


def _score(pool: int):
    def score(cand: pd.DataFrame, req: pd.DataFrame, farthest: dict | None = None) -> pd.DataFrame:
        names = req["request_id"].to_numpy()
        most = np.array([farthest.get(n, np.inf) for n in names]) if farthest else None
        return _rows(names, cand, *_hits(cand, req, _grouped(req), pool, most))

    return score


class _Nearest:
    """The ``pool`` nearest chunks so far of each request, by (distance, id).

    Held as numbers, each chunk once however many requests it is near to; only what leaves the
    task, a bounded number of rows at a time, is written out.
    """

    def __init__(self, requests: int, pool: int):
        self.requests, self.pool = requests, pool
        self.who, self.what, self.far = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0)
        self.chunks: pd.DataFrame | None = None
        self.farthest = np.full(requests, np.inf)

    def add(self, cand: pd.DataFrame, who: np.ndarray, what: np.ndarray, far: np.ndarray) -> None:
        if not len(who):
            return
        seen, what = np.unique(what, return_inverse=True)
        new = cand[_CHUNK].iloc[seen]
        held = 0 if self.chunks is None else len(self.chunks)
        self.chunks = new if not held else pd.concat([self.chunks, new], ignore_index=True)
        who, far = np.concatenate([self.who, who]), np.concatenate([self.far, far])
        what = np.concatenate([self.what, what.astype(np.int32) + held])
        order = np.lexsort((_order(self.chunks["id"].to_numpy())[what], far, who))
        who = who[order]
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        keep = nth < self.pool
        last = order[nth == self.pool - 1]
        order = order[keep]
        self.who, self.far = who[keep], far[order]
        # What is farther away than a full pool cannot count in later blocks.
        self.farthest[who[nth == self.pool - 1]] = far[last]
        seen, inverse = np.unique(what[order], return_inverse=True)
        self.chunks, self.what = self.chunks.iloc[seen], inverse.astype(np.int32)

    def rows(self, names: np.ndarray) -> Iterator[pd.DataFrame]:
        for at in range(0, len(self.who), _EMITTED):
            part = slice(at, at + _EMITTED)
            yield _rows(names, self.chunks, self.who[part], self.what[part], self.far[part])


def _gather(pool: int):
    def gather(frames: Iterator[pd.DataFrame], req: pd.DataFrame) -> Iterator[pd.DataFrame]:
        groups, best = _grouped(req), _Nearest(len(req), pool)
        for frame in frames:
            best.add(frame, *_hits(frame, req, groups, pool, best.farthest))
        yield from best.rows(req["request_id"].to_numpy())

    return gather


def _keep_nearest(near: pd.DataFrame, pool: int) -> pd.DataFrame:
    """The first ``pool`` rows of each request by (distance, chunk_id)."""
    near = near.sort_values(["request_id", "distance", "chunk_id"], kind="stable")
    return near[near.groupby("request_id", sort=False).cumcount() < pool]


def _farthest(best: pd.DataFrame, pool: int) -> dict:
    """The largest distance of each request that has a full pool: what is farther away in
    later blocks cannot count."""
    of = best.groupby("request_id", sort=False)["distance"].agg(["size", "max"])
    return of["max"][of["size"] >= pool].to_dict()


def _admitted(asked: pd.DataFrame, chunks: DataFrame, postings: DataFrame):
    """Drops what no request admits, so that it is neither read nor shuffled."""
    if not len(asked):
        return chunks, postings
    models = sorted(asked["model_name"].dropna().unique())
    if len(models) <= 100:
        chunks = chunks.filter(F.col("model_name").isin(models))
    named = [_wanted(x) for x in asked["sources"]]
    if all(named):
        every = sorted({s for x in named for s in x})
        if len(every) <= 1000:
            postings = postings.filter(F.col("source").isin(every))
    if (asked["remote_only"] == True).all():  # noqa: E712
        postings = postings.filter(F.col("remote"))
    if asked["minimum_salary"].notna().all():
        least = float(asked["minimum_salary"].min())
        postings = postings.filter(F.col("salary_max") >= least)
    return chunks, postings


def _or_null(df: DataFrame, column: str, kind: str) -> Column:
    there = F.col(column) if column in df.columns else F.lit(None)
    return there.cast(kind).alias(column)


_FACTS = {"source": "string", "remote": "boolean", "salary_max": "double", "location": "string"}


def _candidates(chunks: DataFrame, *more: str) -> DataFrame:
    """Chunks with a vector, and the columns that are compared; facts they lack are NULL."""
    return chunks.filter(F.col("embedding").isNotNull()).select(
        F.col("id").cast("string").alias("id"), "job_posting_id", "embedding", "model_name",
        _or_null(chunks, "content_hash", "string"),
        *[_or_null(chunks, c, kind) for c, kind in _FACTS.items()], *more)


def _nearest(near: DataFrame, pool: int) -> DataFrame:
    return ranked(near, ["request_id"], [F.col("distance"), F.col("chunk_id")], pool,
                  "pool_rank")


def _draw(asked: block_top.Asked, candidates: DataFrame, pool: int, candidate_rows: int):
    """The ``pool`` nearest of the candidate chunks. Requests that ask for the same are drawn
    once, so that tasks do not hand on the same chunks for each of them."""
    keyed = asked.frame.withColumn("_same", F.sha2(F.to_json(F.struct(*REQUEST_FIELDS[1:])), 256))
    first = keyed.groupBy("_same").agg(F.min("request_id").alias("_first"))
    owners = keyed.join(first, "_same").select("_first", "request_id").distinct()
    few = block_top.measure(asked.frame.join(first.select(F.col("_first").alias("request_id")),
                                             "request_id", "left_semi"), asked.request_rows, asked.request_bytes)
    near = _nearest(block_top.best_per_request(
        _candidates(candidates), few, _score(pool), lambda best: _keep_nearest(best, pool),
        _NEAR, "id", candidate_rows, _gather(pool)), pool)
    return owners.join(near.withColumnRenamed("request_id", "_first"), "_first").select(*near.columns)


def _facts(postings: DataFrame, fresh_only: bool) -> tuple[DataFrame, list[str]]:
    """What requests filter by, and the keys that chunks meet it on."""
    extra = ["content_hash"] if fresh_only else []
    return postings.select(
        F.col("id").alias("job_posting_id"), "source", "remote",
        F.col("salary_max").cast("double").alias("salary_max"), "location", *extra,
    ), ["job_posting_id", *extra]


# Above this many postings their facts are no safe broadcast, and joining them to the
# vectors first would move all vectors.
LATE_ROWS = 100_000


def nearest_chunks(asked: block_top.Asked, chunks: DataFrame, postings: DataFrame, pool: int,
                   *, fresh_only: bool = False, late: bool | None = None,
                   candidate_rows: int = block_top.CANDIDATE_ROWS) -> DataFrame:
    """The ``pool`` nearest chunks of each request among the postings it admits.

    With ``fresh_only`` chunks of an older text of their posting are left out. ``late``
    says whether filters are applied after a first draw; by default many postings decide.
    """
    if asked.local is not None:
        chunks, postings = _admitted(asked.local, chunks, postings)
    facts, keys = _facts(postings, fresh_only)
    if late is None:
        late = facts.count() > LATE_ROWS
    if late:
        return _late(asked, chunks, facts, keys, pool, candidate_rows)
    return _draw(asked, chunks.drop(*_FACTS).join(facts, keys), pool, candidate_rows)


def _meets_filters() -> Column:
    """The filters of a request, on rows that hold them and the posting's facts."""
    named = F.filter(F.transform("sources", lambda s: F.lower(s)), lambda s: s != "")
    place = text.strip("asked_location")
    return (
        (F.coalesce(F.size(named), F.lit(0)) <= 0) | F.array_contains(named, F.col("source"))
    ) & (~F.coalesce("remote_only", F.lit(False)) | F.col("remote")) & (
        F.col("minimum_salary").isNull() | (F.col("salary_max") >= F.col("minimum_salary"))
    ) & ((F.coalesce("asked_location", F.lit("")) == "") | F.ilike(
        "location", F.concat(F.lit("%"), place, F.lit("%"))))


def _late(asked: block_top.Asked, chunks: DataFrame, facts: DataFrame, keys: list[str],
          pool: int, candidate_rows: int, more: int = 4) -> DataFrame:
    """Draws ``more`` times the pool without looking at postings, then filters.

    Only the few drawn chunks meet their postings, so no vector is moved. The draw is
    exact for requests that still have a full pool, or whose draw took all there is; the
    others are drawn again with the filters applied first.
    """
    spark, size = chunks.sparkSession, pool * more
    open_filters = asked.frame.withColumns({
        "sources": F.lit(None).cast("array<string>"), "remote_only": F.lit(False),
        "minimum_salary": F.lit(None).cast("double"), "location": F.lit(None).cast("string")})
    drawn = _stored(spark, "drawn", _draw(
        dataclasses.replace(asked, frame=open_filters), chunks.drop(*_FACTS), size,
        candidate_rows).drop("pool_rank"))
    filters = asked.frame.select(
        "request_id", "sources", "remote_only", "minimum_salary",
        F.col("location").alias("asked_location"))
    fits = _stored(spark, "fits", drawn.join(facts, keys).join(filters, "request_id").filter(
        _meets_filters()).select(*drawn.columns))
    count = lambda df, name: df.groupBy("request_id").agg(F.count("*").alias(name))
    short = count(drawn, "taken").join(count(fits, "left"), "request_id", "left").filter(
        (F.col("taken") >= size) & (F.coalesce("left", F.lit(0)) < pool)).select("request_id")
    done = ranked(fits.join(short, "request_id", "left_anti"), ["request_id"],
                  [F.col("distance"), F.col("chunk_id")], pool, "pool_rank")
    again = block_top.measure(asked.frame.join(short, "request_id", "left_semi"),
                              asked.request_rows, asked.request_bytes)
    if not again.rows:
        return done
    return done.unionByName(_draw(
        again, chunks.drop(*_FACTS).join(facts, keys), pool, candidate_rows).select(
        *done.columns))


def _stored(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    path = session.working_dir(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def search(requests: DataFrame, chunks: DataFrame, postings: DataFrame, *, top_k: int = 5,
           most: int | None = None, pool: int | None = None, fresh_only: bool = False,
           preview_chars: int = 500, late: bool | None = None,
           candidate_rows: int = block_top.CANDIDATE_ROWS, **limits) -> DataFrame:
    """The ``top_k`` postings nearest to each request, one row each, ranked.

    The nearest chunks are drawn first, then the best chunk of each posting counts,
    so fewer than ``top_k`` postings are possible. Texts join at the very end.
    """
    k = top_k_of(top_k, most)
    # Read many times below: embedded and joined once.
    asked = block_top.measure(_stored(
        requests.sparkSession, "requests", requests.select(*REQUEST_FIELDS)), **limits)
    near = nearest_chunks(asked, chunks, postings, pool or pool_of(k),
                          fresh_only=fresh_only, late=late, candidate_rows=candidate_rows)
    return _presented(near, chunks, postings, k, preview_chars)


def _presented(near: DataFrame, chunks: DataFrame, postings: DataFrame, k: int,
               preview_chars: int) -> DataFrame:
    """The best ``k`` postings of each request's drawn chunks, with their texts."""
    best = first_per_key(near, ["request_id", "job_posting_id"],
                         [F.col("distance"), F.col("chunk_id")])
    top = ranked(
        best.withColumn("similarity", 1 - F.col("distance")),
        ["request_id"], [F.desc("similarity"), F.col("job_posting_id")], k, "base_rank"
    ).select("request_id", "job_posting_id", "chunk_id", "base_rank",
             F.round("similarity", 6).alias("similarity"))
    if "chunk_text" in chunks.columns:
        texts = chunks.select(F.col("id").cast("string").alias("chunk_id"), "chunk_text")
        top = top.join(texts, "chunk_id")
    shown = postings.select(
        F.col("id").alias("job_posting_id"), "source", "title", "company", "location",
        "remote", "salary_min", "salary_max", "salary_currency", "employment_type",
        "category", text.preview("description_text", preview_chars).alias(
            "description_preview"), "apply_url", "posted_at")
    return top.join(shown, "job_posting_id")


def rerank(results: DataFrame, feedback: DataFrame, user_col: str = "user_id", *,
           low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Results re-ordered by the user's feedback; the set of results stays.

    ``feedback`` holds one signal per (user, posting).
    """
    signal = feedback.select(user_col, "job_posting_id", "feedback")
    weight = F.lit(0.0)
    for name, value in domains.FEEDBACK_WEIGHT.items():
        weight = F.when(F.col("feedback") == name, F.lit(value)).otherwise(weight)
    base = F.coalesce("base_similarity", F.lit(0.0))
    moved = (
        results.withColumnRenamed("similarity", "base_similarity")
        .join(signal, [user_col, "job_posting_id"], "left")
        .withColumn("feedback_adjustment", weight)
        .withColumn("similarity", F.round(F.greatest(
            F.lit(low), F.least(F.lit(high), base + F.col("feedback_adjustment"))), 6))
    )
    order = Window.partitionBy("request_id").orderBy(F.desc("similarity"), F.col("base_rank"))
    return moved.withColumn("rank", F.row_number().over(order))


# ---- approximate search: inverted lists ---------------------------------------------

# The centres of the lists: a fitted model, or the vectors themselves. Either way their
# number is what the caller chose, whatever the number of chunks.
Centres = KMeansModel | Sequence[Sequence[float]]

LIST_ROWS = 20_000  # chunks of a list in one block
LIST_REQUESTS = 4_000  # requests of a list in one block


def train_lists(chunks: DataFrame, lists: int, seed: int = 7) -> KMeansModel:
    """Centres that part the vectors into lists of near ones (by cosine)."""
    points = chunks.select(array_to_vector(
        F.col("embedding").cast("array<double>")).alias("features"))
    return KMeans(k=lists, seed=seed, distanceMeasure="cosine").fit(points)


def _with_nearest(df: DataFrame, vector: str, centres: Centres, n: int, name: str) -> DataFrame:
    """Adds the numbers of the ``n`` centres nearest to a vector, nearest first; a vector
    of zeros gets the first ones, no vector NULL."""
    rows = centres.clusterCenters() if isinstance(centres, KMeansModel) else centres
    unit = _unit(np.asarray(rows, dtype=np.float64))
    schema = StructType(df.schema.fields + [StructField(name, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(vector).to_pandas()
            there = np.flatnonzero(given.notna().to_numpy())
            lists: list = [None] * len(given)
            if len(there):
                near = np.nan_to_num(_unit(_stack(given.iloc[there])) @ unit.T, nan=-2.0)
                for at, order in zip(there, np.argsort(-near, axis=1, kind="stable")[:, :n]):
                    lists[at] = order.tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lists, pa.list_(pa.int32()))],
                names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def with_list(chunks: DataFrame, centres: Centres) -> DataFrame:
    """Chunks with the number of their list. Stored by it, other lists are not read."""
    return _with_nearest(chunks, "embedding", centres, 1, "_lists").withColumn(
        "list_id", F.get("_lists", F.lit(0))).drop("_lists")


def with_probes(requests: DataFrame, centres: Centres, probes: int) -> DataFrame:
    """Requests with the ``probes`` lists whose centres are nearest."""
    return _with_nearest(requests, "vector", centres, probes, "probes")


def _blocks(asked: DataFrame, listed: DataFrame, list_rows: int,
            list_requests: int) -> DataFrame:
    """Into how many blocks the chunks and the requests of a probed list are cut: one row
    per model asked for and list."""
    key = ["model_name", "list_id"]
    count = lambda df, rows, name: df.groupBy(*key).agg(
        F.ceil(F.count("*") / rows).cast("int").alias(name))
    return count(listed, list_rows, "_chunk_blocks").join(
        count(asked, list_requests, "_request_blocks"), key)


def _in_lists(probed: DataFrame, listed: DataFrame, facts: DataFrame, keys: list[str],
              pool: int, list_rows: int, list_requests: int) -> DataFrame:
    """The ``pool`` nearest chunks of each request among those of the lists it probes.

    Requests and chunks meet by equality on (model, list), a large list in blocks of
    bounded size, so a vector travels once for each block of requests that ask for its
    list, and not at all if none does. A block keeps the ``pool`` nearest of a request.
    """
    asked = probed.select(*REQUEST_FIELDS, F.explode("probes").alias("list_id"))
    blocks = F.broadcast(_blocks(asked, listed, list_rows, list_requests))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Lists that nobody probes fall away before facts are joined.
    wanted = listed.drop(*_FACTS).join(blocks, ["model_name", "list_id"]).join(facts, keys)
    key = ["model_name", "list_id", "_cb", "_rb"]
    left = _candidates(wanted, "list_id", "_chunk_blocks", "_request_blocks").withColumn(
        "_cb", dealt("id", "_chunk_blocks")).withColumn("_rb", every("_request_blocks")).drop(
        "_chunk_blocks", "_request_blocks")
    right = asked.join(blocks, ["model_name", "list_id"]).withColumn(
        "_rb", dealt("request_id", "_request_blocks")).withColumn("_cb", every("_chunk_blocks")).drop(
        "_chunk_blocks", "_request_blocks")
    score = _score(pool)

    def run(_, cand: pd.DataFrame, req: pd.DataFrame) -> pd.DataFrame:
        return score(cand, req)

    return _nearest(
        left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, _NEAR), pool)


def approximate_search(requests: DataFrame, listed: DataFrame, postings: DataFrame,
                       centres: Centres, *, probes: int = 2, top_k: int = 5,
                       most: int | None = None, pool: int | None = None,
                       fresh_only: bool = False, preview_chars: int = 500,
                       list_rows: int = LIST_ROWS,
                       list_requests: int = LIST_REQUESTS) -> DataFrame:
    """:func:`search` over the nearest lists only; ``listed`` comes from with_list.

    Similarities are exact; what lies in other lists is missed.
    """
    k = top_k_of(top_k, most)
    facts, keys = _facts(postings, fresh_only)
    near = _in_lists(with_probes(requests.select(*REQUEST_FIELDS), centres, probes), listed,
                     facts, keys, pool or pool_of(k), list_rows, list_requests)
    return _presented(near, listed, postings, k, preview_chars)


def probed_pairs(requests: DataFrame, listed: DataFrame, centres: Centres,
                 probes: int) -> DataFrame:
    """One row: pairs of request and chunk that an approximate search compares, and all."""
    key = ["model_name", "list_id"]
    asked = with_probes(requests, centres, probes).select(
        "request_id", "model_name", F.explode("probes").alias("list_id"))
    per_list = listed.groupBy(*key).agg(F.count("*").alias("_chunks")).join(
        asked.groupBy(*key).agg(F.count("*").alias("_asked")), key)
    per_model = listed.groupBy("model_name").agg(F.count("*").alias("_chunks")).join(
        requests.groupBy("model_name").agg(F.count("*").alias("_asked")), "model_name")
    pairs = F.coalesce(F.sum(F.col("_chunks") * F.col("_asked")), F.lit(0))
    return per_list.agg(pairs.alias("compared"), F.lit(0).cast("long").alias("all_pairs")).unionByName(
        per_model.agg(F.lit(0).cast("long").alias("compared"), pairs.alias("all_pairs"))).agg(
        F.sum("compared").alias("compared"), F.sum("all_pairs").alias("all_pairs"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per request, the share of exact results that an approximate search found."""
    hit = found.select("request_id", "job_posting_id", F.lit(1).alias("_hit"))
    return exact.join(hit, ["request_id", "job_posting_id"], "left").groupBy("request_id").agg(
        F.count("*").alias("wanted"), F.count("_hit").alias("found"),
        F.round(F.count("_hit") / F.count("*"), 4).alias("recall"))
