"""Best candidates per request when the match is no equality.

Every request is compared with every candidate, but pairs exist only inside a
task, as numpy blocks; what leaves a task is at most n rows per request. Requests
of a checked size go to the tasks as a broadcast; more of them are cut into blocks
that meet blocks of candidates in a co-grouped shuffle. Both ways are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# (candidates, requests) -> rows of the output schema, at most n per request.
Score = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]
# Cuts rows that were gathered from several blocks to n per request.
Cut = Callable[[pd.DataFrame], pd.DataFrame]
# (blocks of candidates, requests) -> the same of all blocks of a task.
Gather = Callable[[Iterator[pd.DataFrame], pd.DataFrame], Iterator[pd.DataFrame]]

REQUEST_ROWS = 20_000
REQUEST_BYTES = 64 << 20
CANDIDATE_ROWS = 20_000


@dataclass(frozen=True)
class Asked:
    """Requests with their measured size; ``local`` holds them when they are few."""

    frame: DataFrame
    rows: int
    total: int
    request_rows: int
    request_bytes: int

    @cached_property
    def local(self) -> pd.DataFrame | None:
        small = self.rows <= self.request_rows and self.total <= self.request_bytes
        return self.frame.toPandas() if small else None

    @property
    def blocks(self) -> int:
        return max(ceil(self.rows / self.request_rows), ceil(self.total / self.request_bytes))


def measure(requests: DataFrame, request_rows: int = REQUEST_ROWS,
            request_bytes: int = REQUEST_BYTES) -> Asked:
    """Counts the requests and the bytes of their JSON form."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*requests.columns))))
    rows, total = requests.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return Asked(requests, rows, total, request_rows, request_bytes)


def best_per_request(
    candidates: DataFrame, asked: Asked, score: Score, cut: Cut, schema: str,
    candidate_key: str, candidate_rows: int = CANDIDATE_ROWS, gather: Gather | None = None,
) -> DataFrame:
    """Per task, the best rows of every request; cut them once more per request.

    ``gather`` takes the place of ``score`` and ``cut`` where a task sees all requests.
    """
    if asked.local is not None:
        return _broadcast(candidates, asked.local, gather or _gathered(score, cut), schema)
    return _cogrouped(candidates, asked, score, schema, candidate_key, candidate_rows)


def _gathered(score: Score, cut: Cut) -> Gather:
    def gather(frames: Iterator[pd.DataFrame], requests: pd.DataFrame) -> Iterator[pd.DataFrame]:
        best, more = None, []
        for frame in frames:
            found = score(frame, requests)
            if not len(found):
                continue
            more.append(found)
            # Few new rows wait, so that the best ones are not sorted again for each block.
            if best is None or sum(map(len, more)) > len(best) // 4:
                best = cut(pd.concat([*([] if best is None else [best]), *more], ignore_index=True))
                more = []
        if best is not None:
            yield cut(pd.concat([best, *more], ignore_index=True)) if more else best

    return gather


def _broadcast(candidates, requests, gather, schema) -> DataFrame:
    shared = candidates.sparkSession.sparkContext.broadcast(requests)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from gather(frames, shared.value)

    return candidates.mapInPandas(run, schema)


def _cogrouped(candidates, asked: Asked, score, schema, key, candidate_rows) -> DataFrame:
    requests, request_blocks = asked.frame, asked.blocks
    candidate_blocks = max(1, ceil(candidates.count() / candidate_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = candidates.withColumn(
        "_cb", F.pmod(F.xxhash64(key), F.lit(candidate_blocks)).cast("int")
    ).withColumn("_rb", every(request_blocks))
    right = requests.withColumn(
        "_rb", F.pmod(F.xxhash64("request_id"), F.lit(request_blocks)).cast("int")
    ).withColumn("_cb", every(candidate_blocks))

    def run(_, cand: pd.DataFrame, req: pd.DataFrame) -> pd.DataFrame:
        return score(cand, req)

    return (
        left.groupBy("_cb", "_rb").cogroup(right.groupBy("_cb", "_rb"))
        .applyInPandas(run, schema)
    )
