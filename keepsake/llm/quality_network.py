"""Quality by a convolutional network over bytes.

Each byte has a small learned vector; learned filters look at WIDTH bytes at a time, from every byte of the document on.
Overlapping chunks of CHUNK such places, which together cover all of it, keep each filter's largest answer; one linear layer turns a chunk's
answers into a logit, and the mean of all chunks' logits is the document's. What a filter finds nowhere in a chunk counts
as much as what it finds, so text that says the same thing over and over differs from prose without any rule for it.

Vectors, filters and the last layer are trained jointly in numpy by Adam, on crops of a bounded sample of labelled documents; as pooling
hands a gradient to one place only, a step back costs little. A logistic curve fitted on documents set apart makes a logit a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm._shared import small_batches, take_over
from keepsake.llm.language_id import fold

DIMENSIONS, WIDTH, FILTERS = 8, 8, 32
#: Places of a chunk; the next one begins half a chunk on.
CHUNK = 512
HALF = CHUNK // 2
#: The byte that stands behind a text's end.
END = 256
#: Labelled documents of each class that are trained on at most (about), and bytes of each.
MAX_PER_CLASS, MAX_BYTES = 1500, 20_000
#: Bytes of a crop, documents of a step, steps.
CROP, BATCH, STEPS, RATE, SHORTENED = 3 * HALF, 32, 1200, 0.004, 0.2
HELD_OUT, FOLDS, THRESHOLD = 1, 3, 0.5
#: Places of a product in training: a divisor of CROP.
PRODUCT = 96
#: Places whose answers are computed at a time: a multiple of HALF whose windows fit a core's cache.
AT_ONCE = 16 * HALF


@dataclass
class Network:
    """vectors: one for each byte and END; filters: by (place, dimension) and filter; last and shift: the layer behind them; the curve to a probability."""

    vectors: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    last: np.ndarray
    shift: float
    slope: float = 1.0
    offset: float = 0.0

    def probability(self, logit: float) -> float:
        z = self.slope * logit + self.offset
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _windows(model: Network, codes: np.ndarray) -> np.ndarray:
    """A row of WIDTH vectors for each place of codes but the last WIDTH - 1."""
    flat = model.vectors[codes].reshape(-1)
    return np.lib.stride_tricks.as_strided(flat, (len(codes) - WIDTH + 1, WIDTH * DIMENSIONS), (flat.itemsize * DIMENSIONS, flat.itemsize))


def half_maxima(model: Network, data: np.ndarray) -> np.ndarray:
    """The largest answer of each filter in every half chunk of one text's bytes; an empty text has one place, behind its end."""
    many = max(1, len(data))
    out = np.empty(((many + HALF - 1) // HALF, FILTERS), dtype=np.float32)
    for start in range(0, many, AT_ONCE):
        end = min(many, start + AT_ONCE)
        codes = np.full(end - start + WIDTH - 1, END, dtype=np.int16)
        own = data[start : end + WIDTH - 1]
        codes[: len(own)] = own
        answers = _windows(model, codes) @ model.filters
        whole = (end - start) // HALF
        first = start // HALF
        if whole:
            out[first : first + whole] = answers[: whole * HALF].reshape(whole, HALF, FILTERS).max(axis=1)
        if whole * HALF < end - start:
            out[first + whole] = answers[whole * HALF :].max(axis=0)
    return out


def logit(model: Network, data: np.ndarray) -> float:
    """The mean of the logits of a text's chunks."""
    most = half_maxima(model, data)
    if len(most) > 1:
        most = np.maximum(most[:-1], most[1:])
    return float((np.maximum(most + model.bias, 0) @ model.last).mean(dtype=np.float64)) + model.shift


def _crops(texts: list[np.ndarray], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A crop of each text as codes, END behind it, and its number of bytes (one at least). A share SHORTENED of them is as short as a short text may be."""
    codes = np.full((len(texts), CROP + WIDTH - 1), END, dtype=np.int16)
    size = np.ones(len(texts), dtype=np.int64)
    for k, t in enumerate(texts):
        start = int(rng.integers(0, max(1, len(t) - CROP + 1)))
        if rng.random() < SHORTENED:
            t = t[: start + int(rng.integers(16, CROP))]
        own = t[start : start + CROP + WIDTH - 1]
        codes[k, : len(own)] = own
        size[k] = max(1, min(CROP, len(t) - start))
    return codes, size


def _start(rng: np.random.Generator) -> Network:
    draw = lambda shape, by: rng.normal(0, by, shape).astype(np.float32)
    return Network(draw((END + 1, DIMENSIONS), 0.5), draw((WIDTH * DIMENSIONS, FILTERS), 1 / math.sqrt(WIDTH * DIMENSIONS)), np.zeros(FILTERS, dtype=np.float32), draw(FILTERS, 0.3), 0.0)


def _step(model: Network, codes: np.ndarray, size: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """The slopes of the mean loss by vectors, filters, bias, last and shift."""
    rows, halves = len(codes), CROP // HALF
    seen = model.vectors[codes]
    size_of = seen.itemsize
    windows = np.lib.stride_tricks.as_strided(seen, (rows, CROP, WIDTH * DIMENSIONS), (seen.strides[0], size_of * DIMENSIONS, size_of))
    # products of this size are one thread's work to any BLAS; larger ones cost the driver more in threads than in sums
    answers = (np.ascontiguousarray(windows).reshape(-1, PRODUCT, WIDTH * DIMENSIONS) @ model.filters).reshape(rows, CROP, FILTERS)
    answers[np.arange(CROP)[None, :] >= size[:, None]] = -np.inf
    split = answers.reshape(rows, halves, HALF, FILTERS)
    at = split.argmax(axis=2)
    most = np.take_along_axis(split, at[:, :, None, :], axis=2)[:, :, 0, :]
    at = at + (np.arange(halves) * HALF)[None, :, None]
    left, right = most[:, :-1], most[:, 1:]
    first = left >= right
    pooled, place = np.where(first, left, right), np.where(first, at[:, :-1], at[:, 1:])
    there = np.maximum(1, -(-size // HALF) - 1)  # chunks of a crop
    share = (np.arange(halves - 1)[None, :] < there[:, None]) / there[:, None]
    hidden = np.where(share[:, :, None] > 0, pooled + model.bias, 0.0)
    live = (hidden > 0) & (share[:, :, None] > 0)
    hidden = np.where(live, hidden, 0.0)
    z = np.einsum("rkf,f,rk->r", hidden, model.last, share) + model.shift
    back = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / rows
    to_last = np.einsum("r,rk,rkf->f", back, share, hidden)
    to_hidden = np.where(live, back[:, None, None] * share[:, :, None] * model.last, 0.0)
    r, k, f = np.nonzero(to_hidden)
    slopes = to_hidden[r, k, f].astype(np.float32)
    where = place[r, k, f][:, None] + np.arange(WIDTH)
    used = codes[r[:, None], where]
    seen = model.vectors[used].reshape(len(r), -1)
    to_filters = np.zeros_like(model.filters)
    for one in range(FILTERS):
        own = f == one
        to_filters[:, one] = slopes[own] @ seen[own]
    to_vectors = np.zeros_like(model.vectors)
    np.add.at(to_vectors, used.reshape(-1), (slopes[:, None] * model.filters.T[f]).reshape(-1, DIMENSIONS))
    return [to_vectors, to_filters, to_hidden.sum(axis=(0, 1)), to_last, np.array([back.sum()])]


def fit(texts: list[bytes], good: list[int], seed: int = 11, steps: int = STEPS) -> Network | None:
    """A network, or None where one of the classes has no text. The same texts in the same order give the same network."""
    y = np.array(good)
    own = [np.flatnonzero(y == c) for c in (0, 1)]
    if min(map(len, own)) == 0:
        return None
    rng = np.random.default_rng(seed)
    data = [np.frombuffer(t, dtype=np.uint8) for t in texts]
    own = [rng.permutation(x) for x in own]
    apart = np.concatenate([x[: len(x) // 5] for x in own])
    train = [x[len(x) // 5 :] for x in own]
    model = _start(rng)
    values = [model.vectors, model.filters, model.bias, model.last, np.zeros(1)]
    means, squares = [np.zeros(v.shape) for v in values], [np.zeros(v.shape) for v in values]
    for step in range(1, steps + 1):
        some = np.concatenate([rng.choice(x, BATCH // 2) for x in train])
        codes, size = _crops([data[i] for i in some], rng)
        rate = RATE * min(1.0, step / 30) * (0.5 + 0.5 * math.cos(math.pi * step / steps))
        for v, m, s, g in zip(values, means, squares, _step(model, codes, size, y[some]), strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(v.dtype)
        model.shift = float(values[4][0])
    check = apart if len({*y[apart]}) == 2 else np.concatenate(train)
    model.slope, model.offset = _curve(np.array([logit(model, data[i]) for i in check]), y[check])
    return model


def _curve(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and offset of a logistic curve whose classes weigh the same, with a little ridge, by Newton's method on scaled logits."""
    mid, wide = float(logits.mean()), float(logits.std()) or 1.0
    x = np.stack([(logits - mid) / wide, np.ones(len(y))], axis=1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.array([1.0, 0.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 1e-3 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(bend, slope), -2, 2)
    w[0] = max(w[0], 1e-3)
    return float(w[0] / wide), float(w[1] - w[0] * mid / wide)


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_per_class: int = MAX_PER_CLASS, max_bytes: int = MAX_BYTES) -> tuple[list[bytes], list[int]]:
    """Labelled texts outside the held-out fold: of each class about max_per_class with the least hash of their key.

    A key labelled more than once is good if all its labels say so; null labels and keys don't count. A text over max_bytes teaches nothing (it is
    scored all the same). The driver holds 2 * max_per_class * max_bytes at most, and the keys that are broadcast number about 2 * max_per_class.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in own.where("quality IN (0, 1)").groupBy("quality").count().collect()}
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), F.lit(1 << 30))
    chosen = F.lit(False)
    for c, n in counts.items():
        chosen = chosen | ((F.col("quality") == c) & (place < math.ceil(min(1.0, max_per_class / n) * (1 << 30))))
    rows = docs.where(F.octet_length(docs[text]) <= max_bytes).select(docs[key].alias("doc_id"), docs[text].cast("binary").alias("text"))
    found = rows.join(F.broadcast(own.where(chosen)), "doc_id").withColumn("place", F.xxhash64("doc_id", "text")).orderBy("place", "doc_id", "text").limit(3 * max_per_class)
    held = sorted((r["doc_id"], bytes(r["text"]), r["quality"]) for r in found.toLocalIterator())
    return [t for _, t, _ in held], [c for _, _, c in held]


def score(docs: DataFrame, model: Network | None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, held_out, score, predicted; one row per row of docs.

    Every text is scored whole, block by block, so that memory doesn't follow its length. A null text is empty, and an empty text has the score of
    one place behind an end. Without a model every score is 0.5. Repeated rows are scored each by itself, alike; a null key counts as not held
    out. Other columns are ignored, an empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("quality", lambda: None)
        own = held.value
        for batch in batches:
            texts = batch.column(1)
            scores = np.full(len(texts), 0.5)
            if own is not None:
                for k, t in enumerate(texts):
                    data = np.frombuffer(t.as_buffer() if t.is_valid else b"", dtype=np.uint8)
                    scores[k] = own.probability(logit(own, data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].cast("binary").alias("text")).mapInArrow(run, f"key {kind}, score double")
    return rows.select(F.col("key").alias(key), F.coalesce(fold(F.col("key"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """score() of all docs by a network that is fitted on a bounded sample of the labelled ones."""
    return score(docs, fit(*sample(docs, labels, key, text)), key, text)
