"""Toxicity by subword bags.

A word is the average of the embeddings of its character n-grams (hashed to a table of buckets), a text the average of its
most telling words, and a linear softmax over that average tells toxic texts from others. Table and softmax are
trained jointly in numpy by Adagrad, so that a misspelling or an inflection that was never seen lies where its n-grams
put it. The words that count may stand anywhere in a text, and several different ones say more than one that may be
chance. Long runs without white space are split into words and slices, all of which count.

Only documents are labelled. Training begins with single words under their document's label; then the TOP words that the
model itself ranks highest stand for each document, and of a clean one also those behind them and a few at random. The
toxic documents whose words look least so are left out of a round.
A logistic curve turns a logit into a probability; it is fitted on logits of documents by models that haven't seen them.

As everything is linear, a word's part in the logit is one number, which a worker computes once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm._shared import give_back, kept_rows, small_batches, take_over, text_slices, with_column
from keepsake.llm.language_id import fold

BUCKETS, DIMENSIONS, SHORTEST, LONGEST_GRAM = 1 << 16, 8, 3, 5
#: Words of a text that are judged together; models that calibrate; rounds of training; random words of a text that training begins with, and of a clean text in later rounds.
TOP, FITS, ROUNDS, RATE, FIRST_WORDS, CLEAN_WORDS = 3, 3, 4, 0.3, 12, 4
#: What a toxic text weighs in the curve where a clean one weighs 1, the classes being of one size.
TOXIC_WEIGHT = 1.5
BATCH, LEAST_STEPS = 256, 60
#: Share of the toxic documents that a round leaves out, those without words that look it: labels can be wrong.
DOUBTFUL = 0.1
#: Documents that must share an n-gram for it to be learned.
LEAST_DOCUMENTS = 6
#: Labelled documents of each class that are trained on at most (about), characters of the longest, and characters of a class together.
MAX_PER_CLASS, MAX_CHARACTERS, CLASS_CHARACTERS = 1500, 200_000, 20_000_000
HELD_OUT, FOLDS, THRESHOLD = 1, 3, 0.7
REMEMBERED, LONGEST = 300_000, 64
#: Words whose n-grams are taken together.
TOGETHER = 20_000
EDGES = ".,;:!?\"'()[]{}<>|/\\#*$%&-_~`"
#: Runs of text over LONGEST characters are split at punctuation; slices of what has none, and how far they are apart.
BETWEEN, SLICE, STEP = re.compile(r"[!-/:-@\[-`{-~\u00a1-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2010-\u205e\u3001-\u3003\u3008-\u301f\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+"), 12, 4


def words(text: str) -> list[str]:
    """The runs of a text between white space; what is longer than LONGEST characters is split at punctuation, and what stays longer is cut
    into overlapping slices. A blank at an end of a slice says that the word goes on there.
    """
    runs = text.split()
    if not runs or len(max(runs, key=len)) <= LONGEST:
        return runs
    return [p for r in runs for p in ([r] if len(r) <= LONGEST else _pieces(r))]


def _pieces(run: str) -> list[str]:
    out = []
    for w in filter(None, BETWEEN.split(run)):
        if len(w) <= LONGEST:
            out.append(w)
            continue
        for k in range(0, len(w) - SLICE + STEP, STEP):
            out.append(f"{' ' if k else ''}{w[k : k + SLICE]}{' ' if k + SLICE < len(w) else ''}")
    return out or [""]


def grams(run: str) -> list[int]:
    """Buckets of the n-grams of one word of words(), in lower case, without punctuation at its ends."""
    word = f"<{run.strip(EDGES).lower()}>"
    if " " in word:
        word = word.replace("< ", "").replace(" >", "")
    raw = [word[i : i + n] for n in range(SHORTEST, LONGEST_GRAM + 1) for i in range(len(word) - n + 1)] or [word]
    return [zlib.crc32(g.encode("utf-8")) % BUCKETS for g in raw]


def _checksums() -> np.ndarray:
    """What the register of CRC-32 becomes for each low byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _checksums()


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """grams() of all words at a time: the number of its word and the bucket of each n-gram, in no order.

    The checksum of each place's n-gram is carried on from that of its shorter one, for all places together; a character goes in as its UTF-8
    bytes.
    """
    marked = [f"<{w.strip(EDGES).lower()}>" for w in words]
    marked = [w.replace("< ", "").replace(" >", "") if " " in w else w for w in marked]
    size = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    total = len(codes)
    codes = np.concatenate([codes, np.zeros(LONGEST_GRAM, dtype=np.uint32)])
    more = [codes >= x for x in (0x80, 0x800, 0x10000)]
    many = 1 + sum(x.astype(np.int8) for x in more)
    low = lambda shift: (codes >> np.uint32(shift)) & np.uint32(0x3F) | np.uint32(0x80)
    first = np.select([~more[0], ~more[1], ~more[2]], [codes, 0xC0 | codes >> 6, 0xE0 | codes >> 12], 0xF0 | codes >> 18).astype(np.uint32)
    # byte k of a character: those behind the first have six bits each
    raw = [first] + [np.choose(np.maximum(many - 1 - k, 0), [low(0), low(6), low(12)]).astype(np.uint32) for k in range(1, int(many.max()))]
    word = np.repeat(np.arange(len(marked), dtype=np.int32), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(total)
    crc = np.full(total, 0xFFFFFFFF, dtype=np.uint32)
    of, buckets = [], []
    for n in range(1, LONGEST_GRAM + 1):
        here = slice(n - 1, n - 1 + total)
        for k, b in enumerate(raw):
            after = _CRC[(crc ^ b[here]) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
            crc = np.where(many[here] > k, after, crc) if k else after
        if n >= SHORTEST:
            fits = left >= n
            of.append(word[fits])
            buckets.append(((crc[fits] ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)).astype(np.int32))
    short = np.flatnonzero(size < SHORTEST)  # has no n-gram and counts as one itself
    of.append(short.astype(np.int32))
    buckets.append(np.array([zlib.crc32(marked[i].encode("utf-8")) % BUCKETS for i in short.tolist()], dtype=np.int32))
    return np.concatenate(of), np.concatenate(buckets)


@dataclass
class Model:
    """part: what each bucket adds to a word's logit; bias; and the curve from the highest logit to the score."""

    part: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, highest: float) -> float:
        z = self.slope * highest + self.shift
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def highest(parts: np.ndarray, bias: float) -> float:
    """The logit of a text's TOP most toxic different words together (of all, where it has fewer), given its words' parts; a text without words has the bias alone."""
    if not len(parts):
        return bias
    different = np.unique(parts)[-TOP:]
    return bias + float(different.sum()) / len(different)


class _Words:
    """The different words of the training texts with their n-grams, one after another."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        self.docs = [np.array([number.setdefault(r, len(number)) for r in words(t)], dtype=np.int64) for t in texts]
        every, flat, length = list(number), [], []
        for k in range(0, len(every), TOGETHER):
            of, buckets = gram_buckets(every[k : k + TOGETHER])
            flat.append(buckets[np.argsort(of, kind="stable")])
            length.append(np.bincount(of))
        self.length = np.concatenate(length).astype(np.int64) if length else np.zeros(0, dtype=np.int64)
        self.flat = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)
        self.start = np.cumsum(self.length) - self.length

    def shared(self, docs: np.ndarray) -> np.ndarray:
        """1 for each bucket that words of at least LEAST_DOCUMENTS of docs have, else 0."""
        count = np.zeros(BUCKETS, dtype=np.int64)
        for i in docs:
            count[np.unique(self.of(np.unique(self.docs[i]))[0])] += 1
        return (count >= LEAST_DOCUMENTS).astype(np.float64)

    def parts(self, by_bucket: np.ndarray) -> np.ndarray:
        """What each word adds to a logit, by what each bucket does."""
        return np.add.reduceat(by_bucket[self.flat], self.start) / self.length if len(self.start) else np.zeros(0)

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the given words, and for each the place of its word."""
        n = self.length[words]
        ends = np.cumsum(n)
        inside = np.arange(ends[-1]) - np.repeat(ends - n, n)
        return self.flat[np.repeat(self.start[words], n) + inside], np.repeat(np.arange(len(words)), n)


def fit(texts: list[str], toxic: list[int], seed: int = 7, rounds: int = ROUNDS) -> Model | None:
    """A model, or None where one of the classes has no text. The same rows in the same order give the same model.

    The model learns from all texts. Its curve is that of logits which FITS models give that have not seen a text.
    """
    labels = np.array(toxic)
    kept = np.array([i for i, t in enumerate(texts) if t.split()], dtype=np.int64)
    if len(set(labels[kept])) < 2:
        return None
    words = _Words(texts)
    rng = np.random.default_rng(seed)
    turn = np.zeros(len(texts), dtype=np.int64)
    for c in (0, 1):
        own = rng.permutation(kept[labels[kept] == c])
        turn[own] = np.arange(len(own)) % FITS
    logits = np.full(len(texts), np.nan)
    for k in range(FITS):
        train, rest = kept[turn[kept] != k], kept[turn[kept] == k]
        if len(set(labels[train])) == 2:
            part, bias = _parts(words, train, labels, rng, rounds)
            by_word = words.parts(part)
            logits[rest] = [highest(by_word[words.docs[i]], bias) for i in rest]
    part, bias = _parts(words, kept, labels, rng, rounds)
    check = kept[~np.isnan(logits[kept])]
    if len(set(labels[check])) < 2:  # too few texts to leave any out
        check, by_word = kept, words.parts(part)
        logits[kept] = [highest(by_word[words.docs[i]], bias) for i in kept]
    model = Model(part, bias, *curve(logits[check], labels[check]))
    del words
    give_back()  # the driver stands beside a JVM that needs the room
    return model


def _parts(words: _Words, train: np.ndarray, labels: np.ndarray, rng: np.random.Generator, rounds: int) -> tuple[np.ndarray, float]:
    """What each bucket adds to a logit, and the bias, learned from some of the texts."""
    # what training never meets stays 0 and says nothing; so does what too few documents share, by which they could only be learned by heart
    table, soft, bias = np.zeros((BUCKETS, DIMENSIONS)), rng.normal(0, 1, (DIMENSIONS, 2)) / math.sqrt(DIMENSIONS), np.zeros(2)
    shared = words.shared(train)
    seen = [np.full(table.shape, 1e-8), np.full(soft.shape, 1e-8), np.full(bias.shape, 1e-8)]

    def step(rows: np.ndarray, y: np.ndarray) -> None:
        """One step of Adagrad on bags of words: rows of up to TOP words, -1 where a bag has fewer."""
        there = rows >= 0
        own, size = rows[there], there.sum(axis=1)
        buckets, word = words.of(own)
        n = words.length[own]
        vectors = np.add.reduceat(table[buckets], np.cumsum(n) - n, axis=0) / n[:, None]
        hidden = np.add.reduceat(vectors, np.cumsum(size) - size, axis=0) / size[:, None]
        z = hidden @ soft + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        to_words = np.repeat((p @ soft.T) / size[:, None], size, axis=0) / n[:, None]
        used, where = np.unique(buckets, return_inverse=True)
        to_table = shared[used, None] * np.stack([np.bincount(where, to_words[word, d], len(used)) for d in range(DIMENSIONS)], axis=1)
        seen[0][used] += to_table * to_table
        table[used] -= RATE * to_table / np.sqrt(seen[0][used])
        for what, past, slope in ((soft, seen[1], hidden.T @ p), (bias, seen[2], p.sum(axis=0))):
            past += slope * slope
            what -= RATE * slope / np.sqrt(past)

    def epochs(rows: list[np.ndarray], y: np.ndarray) -> None:
        """Two, or as many as make LEAST_STEPS steps. Both classes weigh the same: the smaller one's bags come again."""
        bags = np.full((len(rows), TOP), -1, dtype=np.int64)
        for k, r in enumerate(rows):
            bags[k, : len(r)] = r
        order = [np.flatnonzero(y == c) for c in (0, 1)]
        most = max(map(len, order))
        for _ in range(max(2, math.ceil(LEAST_STEPS * BATCH / (2 * most)))):
            at = rng.permutation(np.concatenate([np.resize(rng.permutation(o), most) for o in order]))
            for k in range(0, len(at), BATCH):
                step(bags[at[k : k + BATCH]], y[at[k : k + BATCH]])

    def some(i: int, many: int) -> list[np.ndarray]:
        return [words.docs[i][k : k + 1] for k in rng.integers(0, len(words.docs[i]), many)]

    rows, of = [], []
    for i in train:
        rows += (own := some(i, FIRST_WORDS))
        of += [labels[i]] * len(own)
    epochs(rows, np.array(of))
    for _ in range(rounds):
        part, rows, of = words.parts(table @ (soft[:, 1] - soft[:, 0])), [], []
        found = {i: highest(part[words.docs[i]], 0.0) for i in train if labels[i]}
        least = float(np.quantile(list(found.values()), DOUBTFUL))
        for i in train:
            if labels[i] and found[i] < least:
                continue
            own = np.unique(words.docs[i])
            own = own[np.argsort(-part[own], kind="stable")]
            bags = [own[:TOP]] if labels[i] else [own[:TOP], *([own[TOP : 2 * TOP]] if len(own) > TOP else []), *some(i, CLEAN_WORDS)]
            rows += bags
            of += [labels[i]] * len(bags)
        epochs(rows, np.array(of))
    return table @ (soft[:, 1] - soft[:, 0]), float(bias[1] - bias[0])


def curve(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and shift of a logistic curve with a little ridge, by Newton's method on scaled logits. The classes weigh 1 and TOXIC_WEIGHT, whatever their sizes."""
    mid, wide = float(logits.mean()), float(logits.std()) or 1.0
    x = np.stack([(logits - mid) / wide, np.ones(len(y))], axis=1)
    weight = np.where(y == 1, TOXIC_WEIGHT / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum()))
    weight /= weight.sum()
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 1e-4 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        w = w - np.clip(np.linalg.solve(bend, slope), -2, 2)
    w[0] = max(w[0], 1e-3)
    return float(w[0] / wide), float(w[1] - w[0] * mid / wide)


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_per_class: int = MAX_PER_CLASS, max_characters: int = MAX_CHARACTERS, class_characters: int = CLASS_CHARACTERS) -> tuple[list[str], list[int]]:
    """Labelled texts outside the held-out fold: of each class about max_per_class with the least hash of their key.

    A key labelled twice is toxic if one of its labels says so; null labels and keys don't count; texts that are null or
    longer than max_characters teach nothing (they are scored all the same). They are taken in the order of the hashes until a
    class has class_characters. The keys that are broadcast number about 2 * max_per_class, and the driver holds
    2 * class_characters.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1 << 30))
    chosen = F.lit(False)
    for c, n in counts.items():
        chosen = chosen | ((F.col("toxic") == c) & (place < math.ceil(min(1.0, max_per_class / n) * (1 << 30))))
    rows = docs.where(F.length(docs[text]) <= max_characters).select(docs[key].alias("doc_id"), docs[text].alias("text"))
    found, sizes = [], dict.fromkeys(counts, 0)
    for r in rows.join(F.broadcast(own.where(chosen)), "doc_id").orderBy(place, "doc_id", "text").toLocalIterator():
        sizes[r["toxic"]] += len(r["text"])
        if sizes[r["toxic"]] <= class_characters:
            found.append((r["doc_id"], r["text"], r["toxic"]))
    found.sort()
    return [t for _, t, _ in found], [c for _, _, c in found]


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, held_out, score, predicted; one row per row of docs.

    Null and empty texts have the score of no words; without a model every score is 0. Every text is scored whole, however long, also what has no white
    space (see words()). Repeated rows are scored each by itself, alike; a null key counts as not held out. Other columns are ignored, an
    empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer.of(held.value)
        for keys, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([keys, pa.array(scorer.scores(texts), pa.float64())], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, score double")
    return rows.select(F.col("key").alias(key), F.coalesce(fold(F.col("key"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def with_score(docs: DataFrame, model: Model | None, column: str, text: str = "text") -> DataFrame:
    """All columns of docs, then column with the score; one row per row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def worker():
        scorer = Scorer.of(held.value)
        return lambda texts: pa.array(scorer.scores(texts), pa.float64())

    return with_column(docs, column, "double", text, worker)


def harmless(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below threshold; all columns. Null and empty texts score as no words do; without a model all rows stay."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def worker():
        scorer = Scorer.of(held.value)
        return lambda texts: [x < threshold for x in scorer.scores(texts)]

    return kept_rows(docs, text, worker)


class Scorer:
    """Scores texts one by one and remembers the parts of words."""

    last: Scorer | None = None

    def __init__(self, model: Model | None):
        self.model = model
        self.known: dict[str, float] = {}

    @classmethod
    def of(cls, model: Model | None) -> Scorer:
        """The worker's scorer, made anew for another model."""
        take_over("toxicity", cls.forget)
        same = cls.last is not None and (cls.last.model is model or model is not None and cls.last.model is not None and model.bias == cls.last.model.bias and np.array_equal(model.part, cls.last.model.part))
        if not same:
            cls.last = cls(model)
        cls.last.model = model
        return cls.last

    @classmethod
    def forget(cls) -> None:
        cls.last = None

    def learn(self, words: list[str]) -> None:
        for k in range(0, len(words), TOGETHER):
            some = words[k : k + TOGETHER]
            of, buckets = gram_buckets(some)
            self.known.update(zip(some, (np.bincount(of, self.model.part[buckets]) / np.bincount(of)).tolist(), strict=True))

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.model is None:
            return [0.0] * len(texts)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        cut = [words(t or "") for t in texts]
        self.learn(list({w for own in cut for w in own} - self.known.keys()))
        part = self.known.__getitem__
        return [self.model.score(highest(np.fromiter(map(part, own), dtype=np.float64, count=len(own)), self.model.bias)) for own in cut]

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def detect(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """score() of all docs by a model that is fitted on a bounded sample of the labelled ones."""
    return score(docs, fit(*sample(docs, labels, key, text)), key, text)
