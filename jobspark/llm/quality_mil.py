"""Quality classifier: attention-based multiple-instance learning, trained here in numpy.

A document is a bag of passages of ``PASSAGE`` bytes, from the first byte to the last. Every
passage is encoded by hashed byte features and a hidden layer; a gated attention network
(tanh of one projection times the sigmoid of another) weighs the passages; the weighted mean
of their encodings is scored by a logistic layer. Only documents have labels: what passages
count is learned from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

PASSAGE = 512  # bytes
HASHED = 256  # slots of hashed byte pairs
SHAPE = 14  # features of the form of a passage
HIDDEN = 24
ATTENTION = 12
PER_LABEL = 1500  # training documents of each label at most
BAG = 40  # passages of a training document at most, spread evenly over it
THRESHOLD = 0.3
BATCH = 1 << 14  # passages that are scored at once

Model = dict[str, np.ndarray]

SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
LOWER = ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)
DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
STOP = np.isin(np.arange(256), [33, 44, 46, 58, 59, 63])
MARK = ~(SPACE | UPPER | LOWER | DIGIT | STOP)
MARK[0] = False


def cut(text: bytes) -> np.ndarray:
    """Passages from the first byte to the last; one of zeros for an empty text."""
    n = max(1, -(-len(text) // PASSAGE))
    out = np.zeros(n * PASSAGE, np.uint8)
    out[:len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, PASSAGE)


def encode(passages: np.ndarray) -> np.ndarray:
    """(n, PASSAGE) bytes to (n, HASHED + SHAPE) features, all between -1 and 1 or so."""
    n = len(passages)
    size = np.maximum(np.count_nonzero(passages, axis=1), 1).astype(np.float32)
    left, right = passages[:, :-1].astype(np.int64), passages[:, 1:].astype(np.int64)
    pair = ((left * 31 + right * 7 + (left >> 3) * right) & (HASHED - 1)) + np.arange(n)[:, None] * HASHED
    counts = np.bincount(pair.ravel(), (right > 0).ravel().astype(np.float32),
                         minlength=n * HASHED).reshape(n, HASHED)
    hashed = np.sqrt(counts / size[:, None]).astype(np.float32)
    # How much of the passage it says again: words by their hash, seen before in it.
    space = SPACE[passages] | (passages == 0)
    starts = ~space & np.concatenate([np.ones((n, 1), bool), space[:, :-1]], 1)
    words = np.maximum(starts.sum(1), 1).astype(np.float32)
    lines = (passages == 10).sum(1)
    shape = [kind[passages].sum(1) / size for kind in (UPPER, LOWER, DIGIT, STOP, MARK)]
    before = passages[:, :-1]
    shape += [
        starts.sum(1) * 4 / size, lines * 20 / size,
        (passages[:, 1:] == before).sum(1, where=passages[:, 1:] > 0) * 10 / size,
        (MARK[before] & MARK[passages[:, 1:]]).sum(1) * 5 / size,
        (MARK[before] & SPACE[passages[:, 1:]]).sum(1) * 5 / words,
        (SPACE[before] & MARK[passages[:, 1:]]).sum(1) * 5 / words,
        (UPPER[before] & UPPER[passages[:, 1:]]).sum(1) * 3 / size,
        _repeated(passages, starts, space) / words,
        size / PASSAGE,
    ]
    return np.concatenate([hashed, np.stack(shape, 1).astype(np.float32)], 1)


def _repeated(passages: np.ndarray, starts: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Words of a passage that occurred in it before, by a hash of up to eight bytes."""
    n, length = passages.shape
    padded = np.concatenate([passages, np.zeros((n, 8), np.uint8)], 1)
    blank = np.concatenate([space, np.ones((n, 8), bool)], 1)
    row, at = np.nonzero(starts)
    key, on = row.astype(np.uint64) + np.uint64(1), np.ones(len(row), bool)
    for k in range(8):
        on &= ~blank[row, at + k]
        key = np.where(on, key * np.uint64(1099511628211) + padded[row, at + k], key)
    _, first = np.unique(key, return_index=True)
    fresh = np.bincount(row[first], minlength=n)
    return starts.sum(1) - fresh


def _forward(m: Model, x: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, ...]:
    """``bag`` has the first passage of each document."""
    hidden = np.tanh(x @ m["w"] + m["b"])
    gate_t, gate_s = np.tanh(hidden @ m["v"]), 1 / (1 + np.exp(-(hidden @ m["u"])))
    score = (gate_t * gate_s) @ m["a"]
    owner = np.repeat(np.arange(len(bag)), np.diff(np.r_[bag, len(x)]))
    weight = np.exp(score - np.maximum.reduceat(score, bag)[owner])
    weight /= np.add.reduceat(weight, bag)[owner]
    mean = np.add.reduceat(hidden * weight[:, None], bag)
    logit = mean @ m["c"] + m["d"]
    return hidden, gate_t, gate_s, owner, weight, mean, logit


def fit(bags: list[np.ndarray], labels: list[int], epochs: int = 12, rate: float = 3e-3,
        batch: int = 32, seed: int = 0) -> Model:
    """Trains on features of bags by Adam; both labels weigh alike, and the logit is moved
    back to their shares of the sample at the end."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    center, scale = every.mean(0), every.std(0) + 0.02
    size = every.shape[1]
    m = {
        "w": rng.normal(0, 1 / np.sqrt(size), (size, HIDDEN)), "b": np.zeros(HIDDEN),
        "v": rng.normal(0, 0.2, (HIDDEN, ATTENTION)), "u": rng.normal(0, 0.2, (HIDDEN, ATTENTION)),
        "a": rng.normal(0, 0.2, ATTENTION), "c": rng.normal(0, 0.2, HIDDEN), "d": np.zeros(1),
    }
    m = {k: v.astype(np.float32) for k, v in m.items()}
    y = np.array(labels, np.float32)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    importance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    scaled = [((b - center) / scale).astype(np.float32) for b in bags]
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            some = order[at:at + batch]
            x = np.concatenate([scaled[i] for i in some])
            bag = np.r_[0, np.cumsum([len(scaled[i]) for i in some])[:-1]]
            hidden, gate_t, gate_s, owner, weight, mean, logit = _forward(m, x, bag)
            back = (1 / (1 + np.exp(-logit)) - y[some]) * importance[some] / len(some)
            to_mean = back[:, None] * m["c"]
            to_weight = (to_mean[owner] * hidden).sum(1)
            to_score = weight * (to_weight - np.add.reduceat(weight * to_weight, bag)[owner])
            to_gate = to_score[:, None] * m["a"]
            to_t, to_s = to_gate * gate_s * (1 - gate_t ** 2), to_gate * gate_t * gate_s * (1 - gate_s)
            to_hidden = to_mean[owner] * weight[:, None] + to_t @ m["v"].T + to_s @ m["u"].T
            to_in = to_hidden * (1 - hidden ** 2)
            grads = {
                "w": x.T @ to_in + 1e-4 * m["w"], "b": to_in.sum(0), "v": hidden.T @ to_t,
                "u": hidden.T @ to_s, "a": (gate_t * gate_s).T @ to_score, "c": mean.T @ back,
                "d": back.sum(keepdims=True),
            }
            step += 1
            for name, g in grads.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                m[name] -= (rate * (first[name] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    # The scaling becomes part of the first layer.
    m["b"] = m["b"] - (center / scale) @ m["w"]
    m["w"] = m["w"] / scale[:, None]
    m["d"] = m["d"] + np.log(share / (1 - share))
    return {k: np.asarray(v, np.float32) for k, v in m.items()}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", per_label: int = PER_LABEL) -> Model | None:
    """Learns from at most ``per_label`` labelled documents of each label, those whose ids
    hash lowest. Labels other than 0 and 1 and rows without id or text are no training rows;
    None where either label is missing, and every document then scores the share of label 1.
    """
    wanted = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(
        "id is not null and y in (0, 1)").distinct()
    by_hash = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id")
    chosen = wanted.withColumn("nth", F.row_number().over(by_hash)).filter(
        F.col("nth") <= per_label).select("id", "y")
    rows = [(r["id"], r["y"]) for r in chosen.collect()]  # twice ``per_label`` at most
    if len({y for _, y in rows}) < 2:
        return None
    small = docs.sparkSession.createDataFrame(rows, StructType(
        [StructField("id", wanted.schema["id"].dataType), StructField("y", IntegerType())]))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(
        "text is not null").join(F.broadcast(small), "id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                passages = cut(text)
                if len(passages) > BAG:
                    passages = passages[np.linspace(0, len(passages) - 1, BAG).astype(int)]
                out.append(encode(passages).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["id", "y", "bag"])

    got = texts.select("id", "text", "y").mapInArrow(
        features, StructType([*small.schema.fields, StructField("bag", BinaryType())])).collect()
    got = sorted(got, key=lambda r: (r["id"], r["y"], bytes(r["bag"])))
    if len({r["y"] for r in got}) < 2:
        return None
    return fit([np.frombuffer(r["bag"], np.float32).reshape(-1, HASHED + SHAPE) for r in got],
               [r["y"] for r in got])


def scores(model: Model | None, texts: list[bytes | None]) -> np.ndarray:
    """Probability of label 1 of whole texts; NULL as empty."""
    out = np.ones(len(texts))
    if model is None:
        return out
    bags, rows, held = [], [], 0

    def flush() -> None:
        if rows:
            sizes = [len(b) for b in bags]
            every = np.concatenate(bags)
            x = np.concatenate([encode(every[i:i + 1024]) for i in range(0, len(every), 1024)])
            logit = _forward(model, x, np.r_[0, np.cumsum(sizes)[:-1]])[-1].astype(np.float64)
            out[rows] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    for i, text in enumerate(texts):
        bags.append(cut(text or b""))
        rows.append(i)
        held += len(bags[-1])
        if held > BATCH:
            flush()
            bags, rows, held = [], [], 0
    flush()
    return out


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``(id, score, predicted)`` per row: probability of label 1, and 1 if it is at least
    ``THRESHOLD``.

    NULL and empty texts are one empty passage. Repeated rows and NULL ids stay; other columns
    are ignored; an empty table gives no rows. Without a model every row scores 1.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(model, batch.column(1).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64()),
                 pa.array((found >= THRESHOLD).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, StructType([StructField(id_col, kind), StructField("score", DoubleType()),
                         StructField("predicted", IntegerType())]))
