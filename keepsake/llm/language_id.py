"""Language identification by cross-parsing.

For each language a suffix automaton holds all substrings of its labelled text. A text is parsed against each: from where
the last phrase ended, the next is the longest match that the automaton knows (at least one character), across words.
Text of a language falls into few long phrases of its own automaton and many short ones of others. Phrases times the
logarithm of the automaton's text length estimate the cross entropy (Ziv and Merhav, 1993); the least wins.

What is learned and parsed is running text: lower case, with one blank for whatever stands between two runs of letters, as
UTF-8 bytes, so that every script has a small alphabet. An automaton is laid out as one array of steps, and the pieces of
many texts take each step together. A text is parsed in pieces of PIECE bytes; all of it counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm._shared import give_back, kept_rows, small_batches, take_over, text_slices, with_column

UNKNOWN = "und"
#: What is learned of a language at most: rows (about), the characters of a row, bytes; and the bytes of all languages together, of
#: which each has its equal share where there are many. CELLS bounds the arrays of steps (4 bytes each) that a worker holds.
MAX_ROWS, ROW_CHARACTERS, MAX_BYTES, ALL_BYTES, CELLS = 400, 2_000, 64_000, 8_000_000, 40_000_000
#: Bytes of a text that are parsed as one.
PIECE = 1024
#: A text is foreign when its best language needs more than FOREIGN times the bits a byte of that language's own labelled text, and SLACK
#: bits besides, the price of ten phrases: a few odd strings in a short text prove nothing.
FOREIGN, SLACK = 2.5, 170
HOLDOUT, FOLDS = 0, 5


#: Each byte of ASCII as it is learned: letters in lower case, a blank for the others.
PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in bytes(range(256)).lower())


def running(text: str | None) -> bytes:
    """The letters of a text in lower case, runs of them with a blank between and around; empty without a letter."""
    if not text:
        return b""
    if not text.isascii():
        text = text.lower()
        other = [c for c in set(text) if c > "\x7f" and not c.isalpha()]
        if len(other) > 50:
            text = re.sub(f"[{re.escape(''.join(other))}]+", " ", text)
        else:
            for c in other:
                text = text.replace(c, " ")
    runs = text.encode("utf-8", "replace").translate(PLAIN).split()
    return b" " + b" ".join(runs) + b" " if runs else b""


class SuffixAutomaton:
    """All substrings of text (bytes or str); every state is a dictionary of its transitions, the root is state 0."""

    def __init__(self, text: bytes | str):
        self.states: list[dict] = [{}]
        link, length, last = [-1], [0], 0
        states = self.states
        for c in text:
            new = len(states)
            states.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in states[p]:
                states[p][c] = new
                p = link[p]
            if p >= 0:
                q = states[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(states)
                    states.append(dict(states[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and states[p].get(c) == q:
                        states[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new

    def phrases(self, text: bytes | str) -> int:
        """Phrases of the greedy parse: each the longest match from where it starts, or one unknown character."""
        states, at, count = self.states, 0, 0
        for c in text:
            further = states[at].get(c)
            if further is None:
                count += at != 0
                further = states[0].get(c)
                if further is None:
                    count += 1
                    further = 0
            at = further
        return count + (at != 0)

    def steps(self, classes: np.ndarray, kinds: int) -> np.ndarray:
        """What a byte of each class does in each state, as 4 * kinds * next state + phrases that end; classes: byte -> its class, 0 if unknown."""
        out = np.zeros((len(self.states), kinds), dtype=np.int32)
        many = np.fromiter(map(len, self.states), dtype=np.int64, count=len(self.states))
        total = int(many.sum())
        by = np.fromiter(chain.from_iterable(self.states), dtype=np.int64, count=total)
        out[np.repeat(np.arange(len(out)), many), classes[by]] = np.fromiter(chain.from_iterable(x.values() for x in self.states), dtype=np.int32, count=total)
        missing = out == 0  # nothing leads back to the root
        ended = np.where(missing, (np.arange(len(out)) != 0)[:, None].astype(np.int32) + (out[0] == 0), 0)
        return (4 * kinds * np.where(missing, out[0], out) + ended).astype(np.int32).ravel()


def alphabet(learned: dict[str, bytes]) -> list[int]:
    return sorted({b for t in learned.values() for b in set(t)})


def fitted(learned: dict[str, bytes]) -> dict[str, bytes]:
    """As much of each language's text as CELLS has room for: an automaton has up to two states a byte, each with a cell for each kind of byte."""
    most = max(1, CELLS // (2 * (len(alphabet(learned)) + 1) * max(1, len(learned))))
    return {x: t[:most] for x, t in learned.items()}


class CrossParser:
    """learned: language -> its running text. Languages beyond what CELLS has room for are learned from less text each."""

    def __init__(self, learned: dict[str, bytes]):
        self.languages = sorted(learned)
        learned = fitted(learned)
        used = alphabet(learned)
        self.kinds = len(used) + 1
        self.classes = np.zeros(256, dtype=np.uint8 if self.kinds < 256 else np.int64)
        self.classes[used] = np.arange(1, self.kinds)
        self.tables = [SuffixAutomaton(learned[x]).steps(self.classes, self.kinds) for x in self.languages]
        self.bits = [math.log2(len(learned[x]) + 1) for x in self.languages]

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns); every piece is parsed by itself."""
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        many = -(-size // PIECE)
        total = int(many.sum())
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        if not total:
            return out
        of = np.repeat(np.arange(len(texts)), many)
        inside = (np.arange(total) - np.repeat(np.cumsum(many) - many, many)) * PIECE
        start = np.repeat(np.cumsum(size) - size, many) + inside
        length = np.minimum(PIECE, size[of] - inside)
        order = np.argsort(-length, kind="stable")
        start, length, of = start[order], length[order], of[order]
        flat = np.concatenate([self.classes[np.frombuffer(b"".join(texts), dtype=np.uint8)], np.zeros(PIECE, dtype=self.classes.dtype)])
        most = int(length[0])
        alive = len(length) - np.searchsorted(length[::-1], np.arange(most), side="right")
        columns = np.lib.stride_tricks.sliding_window_view(flat, PIECE)[start, :most].T.copy()
        for k, table in enumerate(self.tables):
            at, count = np.zeros(total, dtype=np.int32), np.zeros(total, dtype=np.int64)
            for row, n in zip(columns, alive.tolist(), strict=True):
                step = table[at[:n] + row[:n]]
                count[:n] += step & 3
                at[:n] = step >> 2
            out[:, k] = np.bincount(of, count + (at != 0), len(texts)).astype(np.int64)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, int]]:
        """(language, score, bits, bytes) of each text.

        The score is the share by which the winner's entropy is below the next one's (1 where only one language is known), bits the
        winner's entropy over the text's bytes. Ties go to the smaller name, with score 0. A null text, one without a letter, and every
        text where nothing was learned is "und" with score 0 and no bits.
        """
        if not self.languages:
            return [(UNKNOWN, 0.0, 0.0, 0)] * len(texts)
        raw = [running(t) for t in texts]
        entropy = self.phrases(raw) * np.array(self.bits)
        best = np.argmin(entropy, axis=1)
        least = entropy[np.arange(len(raw)), best]
        entropy[np.arange(len(raw)), best] = np.inf
        other = entropy.min(axis=1)
        score = np.where(np.isinf(other), 1.0, 1.0 - least / np.where(other > 0, other, 1.0))
        return [(self.languages[b], s, e, len(r)) if r else (UNKNOWN, 0.0, 0.0, 0) for r, b, s, e in zip(raw, best.tolist(), score.tolist(), least.tolist(), strict=True)]


def fold(key: Column, folds: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % folds


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> dict[str, bytes]:
    """The running text of each labelled language, from rows whose key isn't in the held-out fold.

    Of a language about max_rows rows, those with the least hash of their key (the share follows from the language's count),
    with at most ROW_CHARACTERS of each, are strung together in that order up to max_bytes, or up to an equal share of ALL_BYTES where
    there are many languages. No language is left out. Null languages, texts and keys teach nothing. The driver gets
    max_rows * ROW_CHARACTERS characters a language at most, in turn, and keeps ALL_BYTES.
    """
    rows = docs.where(docs[key].isNotNull() & docs[lang].isNotNull() & docs[text].isNotNull() & (fold(docs[key], FOLDS) != HOLDOUT))
    counts = rows.groupBy(F.col(lang).alias("lang")).count().collect()
    if not counts:
        return {}
    most = min(max_bytes, max(1, ALL_BYTES // len(counts)))
    max_rows = max(8, math.ceil(max_rows * most / max_bytes))
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("language")), F.lit(1 << 30))
    shares = docs.sparkSession.createDataFrame([(x["lang"], math.ceil(min(1.0, max_rows / x["count"]) * (1 << 30))) for x in counts], f"_lang {docs.schema[lang].dataType.simpleString()}, _share long")
    taken = rows.join(F.broadcast(shares), (F.col(lang) == F.col("_lang")) & (place < F.col("_share")))
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for r in taken.select(F.col(lang).alias("lang"), F.substring(F.col(text), 1, ROW_CHARACTERS).alias("text"), place.alias("place"), F.col(key).alias("key")).orderBy("place", "key", "text").toLocalIterator():
        own = running(r["text"])[: most - sizes.get(r["lang"], 0)]
        if own:
            held.setdefault(r["lang"], []).append(own)
            sizes[r["lang"]] = sizes.get(r["lang"], 0) + len(own)
    return fitted({x: b"".join(parts) for x, parts in held.items()})


@lru_cache(maxsize=1)
def _made(learned: tuple[tuple[str, bytes], ...]) -> CrossParser:
    parser = CrossParser(dict(learned))
    give_back()  # what the automata took before they became arrays
    return parser


def _parser(learned: tuple[tuple[str, bytes], ...]) -> CrossParser:
    """One for each Python worker, while that works on it."""
    take_over("languages", _made.cache_clear)
    return _made(learned)


def with_language(docs: DataFrame, learned: dict[str, bytes], column: str, text: str = "text") -> DataFrame:
    """All columns of docs, then column, a struct (lang_pred, score, bits, bytes) as CrossParser.predict() gives it; one row per row of docs.

    Nothing is shuffled. What the workers get, the learned text, has ALL_BYTES at most.
    """
    held = docs.sparkSession.sparkContext.broadcast(tuple(sorted(learned.items())))

    def worker():
        parser = _parser(held.value)
        kinds = (("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64()), ("bytes", pa.int64()))
        return lambda texts: pa.StructArray.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*parser.predict(texts), strict=True), kinds, strict=True)], [n for n, _ in kinds])

    return with_column(docs, column, "lang_pred string, score double, bits double, bytes long", text, worker)


def own_bits(learned: dict[str, bytes]) -> dict[str, float]:
    """Bits a byte that each language's own text needs: its second half, parsed by an automaton of the first."""
    out = {}
    for x, text in learned.items():
        first, second = text[: len(text) // 2], text[len(text) // 2 :]
        if first:
            parser = CrossParser({x: first})
            out[x] = float(parser.phrases([second])[0, 0]) * parser.bits[0] / len(second)
    return out


def spoken(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", foreign: float = FOREIGN) -> DataFrame:
    """The rows of docs whose text is in one of its labelled languages; all columns.

    Rejected are texts without a letter (null and empty ones too) and foreign ones, which no learned language explains: even the
    predicted one needs more than foreign times the bits a byte that its own text needs, and SLACK bits besides. Where nothing is
    labelled no language is known, and every text is rejected. Ties, rows with null keys and repeated rows are judged by their texts alone.
    """
    learned = learn(docs, key, text, lang)
    held = docs.sparkSession.sparkContext.broadcast((tuple(sorted(learned.items())), {x: foreign * bits for x, bits in own_bits(learned).items()}))

    def worker():
        parser, limits = _parser(held.value[0]), held.value[1]
        return lambda texts: [lang != UNKNOWN and bits <= limits.get(lang, math.inf) * size + SLACK for lang, _, bits, size in parser.predict(texts)]

    return kept_rows(docs, text, worker)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, held_out, lang_pred, score: learned from the docs outside the held-out fold, predicted for all whole texts.

    Null and empty texts and texts without a letter are "und" with score 0. A null key is never learned from and counts as
    not held out. Repeated rows are predicted each by itself, ties go to the smaller name. Other columns are ignored; an empty table gives an
    empty one.
    """
    learned = tuple(sorted(learn(docs, key, text, lang).items()))
    held = docs.sparkSession.sparkContext.broadcast(learned)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(held.value)
        for keys, texts in text_slices(batches):
            found = parser.predict(texts)
            yield pa.RecordBatch.from_arrays([keys, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double")
    return rows.select(F.col("key").alias(key), F.coalesce(fold(F.col("key"), FOLDS) == HOLDOUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
