"""Language identification by a byte convolutional network, trained here in numpy.

Bytes are embedded, filters of several widths run over them, each filter keeps its largest
response in a window of ``WINDOW`` bytes (max pooling), and a softmax over these features
names the language. Texts are cut into such windows from the first byte to the last; the
windows' log probabilities, weighted by the bytes they hold, are averaged.

A softmax names one of the learned languages for any text. Whether a text is in one of them is
told by how sure the network is of its windows: those of other languages and of noise leave it
less sure than nearly all documents it learned from, cut to the length of the text if that is less
than a window, and hardly a part is as clear as is usual for these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 8  # of each width
EMBED = 8
UNKNOWN = "und"
PER_LANGUAGE = 400  # training documents of a language at most
LANGUAGES = 300  # learned languages at most, the most frequent ones
PER_DOCUMENT = 4  # training windows of a document at most
BLOCK = 96  # windows that are convolved at once
LESS_SURE = 0.005  # share of the learned documents of which the model is less sure than its bound
USUAL = 0.1  # share of which it is less sure than is usual
CLEAR = 0.05  # share of a text that is enough if it is as clear as is usual
LENGTHS = (1, 32, 64, 128, WINDOW)  # bytes of the texts that bounds are measured for
TELLS = 0.9  # share of the learned documents whose language must be told at a length below a window

Model = dict[str, np.ndarray]


def _mask() -> np.ndarray:
    """Filters of all widths as one matrix of the largest width, 0 beyond their own."""
    widest = max(WIDTHS)
    return np.concatenate([
        np.tile((np.arange(widest) < w)[:, None, None], (1, EMBED, FILTERS)) for w in WIDTHS],
        axis=2).reshape(widest * EMBED, -1).astype(np.float32)


def _unfold(embedded: np.ndarray) -> np.ndarray:
    """(n, L, EMBED) to (n, L - widest + 1, widest * EMBED)."""
    n, length, _ = embedded.shape
    at = length - max(WIDTHS) + 1
    flat = embedded.reshape(n, -1)
    step = flat.strides[1]
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(
        flat, (n, at, max(WIDTHS) * EMBED), (flat.strides[0], EMBED * step, step)))


def log_probabilities(model: Model, windows: np.ndarray) -> np.ndarray:
    """(n, WINDOW) bytes to (n, languages)."""
    out = np.empty((len(windows), len(model["languages"])), np.float32)
    for at in range(0, len(windows), BLOCK):
        some = windows[at:at + BLOCK]
        cols = _unfold(model["embed"][some])
        pooled = (cols.reshape(-1, cols.shape[2]) @ model["conv"]).reshape(
            len(some), -1, model["conv"].shape[1]).max(1) + model["conv_bias"]
        logits = np.maximum(pooled, 0) @ model["out"] + model["out_bias"]
        logits -= logits.max(1, keepdims=True)
        out[at:at + BLOCK] = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    return out


def cut(text: bytes) -> np.ndarray:
    """Windows from the first byte to the last; the last one is filled up with zeros."""
    n = -(-len(text) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[:len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


def fit(texts: list[bytes], languages: list[str], epochs: int = 8, rate: float = 3e-3,
        batch: int = 64, seed: int = 0) -> Model:
    """Trains on one window per text (cut or filled up to ``WINDOW`` bytes), by Adam."""
    names = sorted(set(languages))
    x = np.stack([cut(t[:WINDOW].ljust(1, b"\0"))[0] for t in texts])
    y = np.searchsorted(names, languages)
    rng, mask = np.random.default_rng(seed), _mask()
    n_filters = mask.shape[1]
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)), "conv": rng.normal(0, 0.2, mask.shape) * mask,
        "conv_bias": np.zeros(n_filters), "out": rng.normal(0, 0.2, (n_filters, len(names))),
        "out_bias": np.zeros(len(names)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    weight = (len(y) / (len(names) * np.bincount(y, minlength=len(names)))).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            some = order[at:at + batch]
            cols = _unfold(p["embed"][x[some]])
            n, length, k = cols.shape
            response = (cols.reshape(-1, k) @ p["conv"]).reshape(n, length, -1)
            best = response.argmax(1)
            pooled = np.take_along_axis(response, best[:, None], 1)[:, 0] + p["conv_bias"]
            hidden = np.maximum(pooled, 0)
            logits = hidden @ p["out"] + p["out_bias"]
            prob = np.exp(logits - logits.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(n), y[some]] -= 1
            prob *= weight[y[some], None] / n
            back = (prob @ p["out"].T) * (pooled > 0)
            chosen = cols[np.arange(n)[:, None], best]  # (n, filters, k)
            to_cols = back[:, :, None] * p["conv"].T[None]
            grad_embed = np.zeros_like(p["embed"])
            spread = x[some][np.arange(n)[:, None, None], best[:, :, None] + np.arange(max(WIDTHS))]
            np.add.at(grad_embed, spread.reshape(-1), to_cols.reshape(-1, EMBED))
            grads = {
                "embed": grad_embed, "conv": np.einsum("nf,nfk->kf", back, chosen) * mask,
                "conv_bias": back.sum(0), "out": hidden.T @ prob, "out_bias": prob.sum(0),
            }
            step += 1
            for name, g in grads.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                p[name] -= (rate * (first[name] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return {**p, "languages": np.array(names, object)}


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learns from a bounded sample: at most ``per_language`` documents of a language, those
    whose ids hash lowest, and ``PER_DOCUMENT`` windows spread evenly over each.

    Rows without language, id or text are no training rows. Without any training row the
    model has no language and calls everything ``und``. ``bounds`` of the model are, for each of
    ``LENGTHS``, the sureness that all but ``LESS_SURE`` of the learned documents reach when they
    are cut to so many bytes, and the one that all but ``USUAL`` of them reach; whole windows of a
    document count together. Lengths that no learned document has take the bounds of the one below,
    and lengths below a window at which the network does not tell the languages of ``TELLS`` of
    the learned documents themselves have 0, so that all such texts stay.
    """
    usable = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).cast("string").alias("text"),
    ).filter("id is not null and lang is not null and length(text) > 0")
    common = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    # Ids alone are ranked, and only that many per task and language are moved.
    chosen = usable.select("id", "lang").withColumn("nth", F.row_number().over(by_hash)).filter(
        F.col("nth") <= per_language).join(common.select("lang"), "lang", "left_semi")
    ids = [r["id"] for r in chosen.select("id").distinct().collect()]
    if not ids:
        return {"languages": np.array([], object)}
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], StructType(
        [StructField("id", usable.schema["id"].dataType)]))
    n = F.length("text")
    spots = [F.substring("text", F.lit(1) + (n * k / PER_DOCUMENT).cast("int"), F.lit(WINDOW))
             for k in range(PER_DOCUMENT)]
    rows = usable.join(F.broadcast(wanted), "id", "left_semi").select(
        "id", "lang", F.array_distinct(F.array(*spots)).alias("spots")).collect()
    rows = sorted(rows, key=lambda r: (r["id"], r["lang"], r["spots"]))
    pairs = [(s.encode(), r["lang"]) for r in rows for s in r["spots"] if s.strip()]
    if not pairs:
        return {"languages": np.array([], object)}
    model = fit([t for t, _ in pairs], [x for _, x in pairs])
    spots = [([s.encode() for s in r["spots"] if s.strip()], r["lang"]) for r in rows]
    return {**model, "bounds": _bounds(model, [x for x in spots if x[0]])}


def _bounds(model: Model, learned: list[tuple[list[bytes], str]]) -> np.ndarray:
    """One row for each of ``LENGTHS``, from the windows of each learned document."""
    rows: list[np.ndarray] = []
    for n in LENGTHS:
        long = [some if n == WINDOW else some[:1] for some, _ in learned if len(some[0]) >= n]
        if not long:
            rows.append(rows[-1])
            continue
        logs = log_probabilities(model, np.concatenate([cut(t[:n]) for some in long for t in some]))
        if n < WINDOW and np.mean(model["languages"][logs.argmax(1)] == np.array(
                [lang for some, lang in learned if len(some[0]) >= n], object)) < TELLS:
            rows.append(np.zeros(2))
            continue
        surest = logs.max(1)
        first = np.r_[0, np.cumsum([len(some) for some in long])[:-1]]
        sure = np.add.reduceat(np.exp(surest, dtype=np.float64), first) / [len(some) for some in long]
        rows.append(np.quantile(sure, [LESS_SURE, USUAL]))
    return np.stack(rows)


def judge(model: Model, texts: list[str | None], usual: float = 1.0) -> list[tuple[str, float, float, float]]:
    """Language, score, sureness and clear share of whole texts; ``und`` and 0 where there is
    no letter.

    The score is that of one language over all windows, so it is low where languages are mixed.
    The sureness is the mean of what each window gives its own likeliest language, the clear
    share that of the bytes in windows to which this is ``usual`` at least.
    """
    letter = regex.compile(r"\p{L}")
    out: list[tuple[str, float, float, float]] = [(UNKNOWN, 0.0, 0.0, 0.0)] * len(texts)
    if not len(model["languages"]):
        return out
    rows, held, held_bytes = [], [], 0

    def flush() -> None:
        if not rows:
            return
        sizes = np.array([len(w) for w in held])
        windows = np.concatenate(held)
        weight = np.count_nonzero(windows, axis=1).astype(np.float64)
        raw = log_probabilities(model, windows)
        logs = raw * weight[:, None]
        first = np.r_[0, np.cumsum(sizes)[:-1]]
        total = np.maximum(np.add.reduceat(weight, first), 1)
        mean = np.add.reduceat(logs, first) / total[:, None]
        prob = np.exp(mean)
        prob /= prob.sum(1, keepdims=True)
        each = np.exp(raw.max(1))
        sure, clear = (np.add.reduceat(x * weight, first) / total for x in (each, each >= usual))
        for i, k, q, s, c in zip(rows, prob.argmax(1), prob.max(1), sure, clear):
            out[i] = (str(model["languages"][k]), float(min(1.0, q)), float(s), float(c))

    for i, text in enumerate(texts):
        if not text or not letter.search(text):
            continue
        rows.append(i)
        held.append(cut(text.encode()))
        held_bytes += held[-1].size
        if held_bytes > 1 << 23:
            flush()
            rows, held, held_bytes = [], [], 0
    flush()
    return out


def classify(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of whole texts; ``und`` and 0 where there is no letter."""
    return [(lang, score) for lang, score, *_ in judge(model, texts)]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` per row; NULL ids and repeated rows stay.

    ``und`` with score 0 where the text is NULL or has no letter. Other columns of ``docs``
    are ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = classify(model, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64())],
                [id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        run, StructType([StructField(id_col, kind), StructField("lang_pred", StringType()),
                         StructField("score", DoubleType())]))


def keep_identified(docs: DataFrame, model: Model, least: float | None = None,
                    text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are in a learned language: the model is
    as sure of all their windows, or a ``CLEAR`` part of them as clear, as its bounds for texts of
    their length ask, or sure of them to ``least``. Where nothing could be learned, all rows with
    a letter are kept."""
    if not len(model["languages"]):
        return docs.filter(F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)))
    at = docs.columns.index(text_col)
    bounds = model["bounds"] if least is None else np.tile([least, 1.0], (len(LENGTHS), 1))

    def known(text: str, lang: str, sure: float, clear: float) -> bool:
        if lang == UNKNOWN:
            return False
        n = np.searchsorted(LENGTHS, len(text.encode()), "right") - 1
        return sure >= bounds[n, 0] or (LENGTHS[n] == WINDOW and clear >= CLEAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            kept = [known(text, lang, sure, clear) for text, (lang, _, sure, clear) in zip(
                texts, judge(model, texts, bounds[-1, 1]))]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
