"""Exact token counts at every prefix, by dynamic programming.

Of the tokens that end at a place of a word, exactly one is the last token of the encoding of the word up to there:
the one that stands unmerged behind the last token of the encoding up to its start. So the count at a place is one
more than the count at that start, and each place is settled from places before it, with no merging. Whether two
tokens stand unmerged side by side follows from the merges at their common border.

A text's words are those of the tokenizer's pattern; counts of a text are sums over its words, and cutting a text
changes no word but those at the cut: a run of white space at the end is one word, and an apostrophe with too little behind it
is no contraction. So PrefixCounts has the count of every prefix of a text from one pass, and what fits a budget, or what a
truncated text has, is looked up there and not encoded again. prefix_counts() keeps them as a column.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm._shared import small_batches, take_over, text_slices
from keepsake.llm.bpe import byte_characters

# Fixed value: the pattern of byte-level BPE files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
NEVER = 1 << 60
#: Words and runs that a worker remembers at most, and the longest of them.
REMEMBERED, LONGEST = 400_000, 64


class PrefixCounter:
    """Counts for a byte-level BPE tokenizer file without a normaliser."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or model["end_of_word_suffix"] or model["ignore_merges"]:
            raise ValueError(f"{path} isn't a plain byte-level BPE file")
        raw = {c: bytes([b]) for b, c in enumerate(byte_characters())}
        vocab = model["vocab"]
        self.tokens = {b"".join(map(raw.__getitem__, t)): i for t, i in vocab.items()}
        self.longest = max(map(len, self.tokens))
        self.merges: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            pair = vocab[a], vocab[b]
            self.merges[pair] = rank
            self.made.setdefault(vocab[a + b], (*pair, rank))
        self.words = regex.compile(PATTERN).findall
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.runs = regex.compile(r"\s{2,}").finditer
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one side of a token while it is merged: (token, rank of the merge that ends it), last the token itself."""
        found = self.edges.get((token, side))
        if found is None:
            chain, at = [], token
            while at in self.made:
                chain.append((at, self.made[at][2]))
                at = self.made[at][side]
            chain.append((at, -1))
            found = [(chain[k][0], chain[k - 1][1] if k else NEVER) for k in range(len(chain) - 1, -1, -1)]
            self.edges[token, side] = found
        return found

    def stand_apart(self, a: int, b: int) -> bool:
        """Whether a and b side by side are the encoding of their bytes.

        Merges happen by rank, the leftmost first. Until one crosses the border, each token grows as it would alone.
        One crosses when its rank is below that of the next merge to the border's left and not above that to its right.
        """
        left, right = self.edge(a, 1), self.edge(b, 0)
        i = j = 0
        while True:
            (x, next_left), (y, next_right) = left[i], right[j]
            crossing = self.merges.get((x, y), NEVER)
            if crossing < next_left and crossing <= next_right and crossing < NEVER:
                return False
            if next_left == next_right == NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def by_byte(self, raw: bytes) -> list[int]:
        """Token counts of raw[:0], raw[:1], ... of one word.

        Only one token can be the last, so any order of trying finds it; short ones are tried first, which needs few steps a byte.
        """
        n, get, apart, longest = len(raw), self.tokens.get, self.apart, self.longest
        last, counts = [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                t = get(raw[start:end])
                if t is None:
                    continue
                if start:
                    pair = last[start], t
                    fits = apart.get(pair)
                    if fits is None:
                        if len(apart) > 4 * REMEMBERED:
                            apart.clear()
                        fits = apart[pair] = self.stand_apart(*pair)
                    if not fits:
                        continue
                last[end], counts[end] = t, counts[start] + 1
                break
        return counts

    def of_word(self, word: str) -> bytes:
        """Counts of the prefixes of one word by characters, from its first character on, as 32-bit numbers; in cut contractions the apostrophe stands alone."""
        if word in CONTRACTIONS:
            counts = [1, *([1 + self.by_byte(word[1:2].encode())[-1]] if len(word) > 2 else []), self.by_byte(word.encode())[-1]]
        else:
            counts = self.by_byte(word.encode("utf-8"))[1:]
            if not word.isascii():
                ends = np.cumsum([len(c.encode("utf-8")) for c in word]) - 1
                return np.array(counts, dtype=np.uint32)[ends].tobytes()
        return np.array(counts, dtype=np.uint32).tobytes()

    def plain(self, text: str) -> np.ndarray:
        """Counts of text[:1], text[:2], ... of a text without added tokens."""
        words, known = self.words(text), self.known
        if not words:
            return np.zeros(0, dtype=np.int64)
        if len(known) > REMEMBERED:
            known.clear()
        long = {}
        for w in set(words):
            if w not in known:
                (known if len(w) <= LONGEST else long)[w] = self.of_word(w)
        look = (lambda w: known.get(w) or long[w]) if long else known.__getitem__
        inside = np.frombuffer(b"".join(map(look, words)), dtype=np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        last = inside[np.cumsum(size) - 1]
        counts = inside + np.repeat(np.cumsum(last) - last, size)
        for run in self.runs(text):
            a, z = run.span()
            counts[a:z] = (counts[a - 1] if a else 0) + np.frombuffer(self.of_word(run.group()), dtype=np.uint32)
        return counts

    def counts(self, text: str | None) -> np.ndarray:
        """Counts of text[:0], text[:1], ... of a whole text; an added token inside it is one, a part of one is text like any other."""
        text = text or ""
        if not any(x in text for x in self.added):
            return np.concatenate([[0], self.plain(text)]).astype(np.int64)
        out, at, word = np.zeros(len(text) + 1, dtype=np.int64), 0, 0
        for part in self.at_added.split(text):
            end = at + len(part)
            if part in self.added:
                # cut inside, it goes on the word before: the counts of that stretch have those of all cuts
                out[at + 1 : end] = out[word] + self.counts(text[word : end - 1])[at - word + 1 :]
                out[end] = out[at] + 1
                word = end
            elif part:
                out[at + 1 : end + 1] = out[at] + self.plain(part)
                word = end - len(self.words(part)[-1])
            at = end
        return out


class PrefixCounts:
    """The counts of one text at all its prefixes: count(n) of its first n characters, fit(limit) the longest prefix within a budget."""

    def __init__(self, counter: PrefixCounter, text: str | None):
        self.at = counter.counts(text)

    def count(self, n: int) -> int:
        return int(self.at[min(max(n, 0), len(self.at) - 1)])

    def fit(self, limit: int) -> int:
        """Characters of the longest prefix with at most limit tokens; 0 where none has so few. One more character can lower a count, so the last one counts."""
        if self.at[-1] <= limit:
            return len(self.at) - 1
        found = np.flatnonzero(self.at <= limit)
        return int(found[-1]) if len(found) else 0


@lru_cache(maxsize=1)
def _prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counter(path: str) -> PrefixCounter:
    """One for each Python worker, while that works on it."""
    take_over("token counts", _prefix_counter.cache_clear)
    return _prefix_counter(path)


def _mapped(docs: DataFrame, path: str, key: str, text: str, schema: str, made: Callable[[list[str], list[PrefixCounts]], list[pa.Array]]) -> DataFrame:
    """key and what made gives for the prefix counts of consecutive texts; one row per row of docs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for keys, texts in text_slices(batches):
            texts = [t or "" for t in texts]
            columns = made(texts, [PrefixCounts(counter, t) for t in texts])
            yield pa.RecordBatch.from_arrays([keys, *columns], ["key", *(x.split()[0] for x in schema.split(", "))])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, {schema}").withColumnRenamed("key", key)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit and fits_chars, the length of the longest prefix within the limit; one row per row of docs.

    Null texts count as empty, with no token. Null or repeated keys pass through, other columns are left out. Work is per
    row: nothing is shuffled, and what a worker remembers is bounded; words over LONGEST characters are counted whole, but not
    remembered, and a text takes memory in proportion to its length. An empty table gives an empty one.
    """

    def made(texts: list[str], counts: list[PrefixCounts]) -> list[pa.Array]:
        n = [int(c.at[-1]) for c in counts]
        return [pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array([c.fit(limit) for c in counts], pa.int64())]

    return _mapped(docs, path, key, text, "n_bytes long, n_tokens long, over_limit boolean, fits_chars long", made)


def prefix_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and counts, an array with the tokens of the first 0, 1, ... characters of the text; edges as in count_tokens().

    Stored, it answers tokens_at() and longest_within() for any cut and any budget, by look-ups in the JVM.
    """

    def made(texts: list[str], counts: list[PrefixCounts]) -> list[pa.Array]:
        flat = np.concatenate([c.at for c in counts]) if counts else np.zeros(0)
        ends = np.cumsum([0, *(len(c.at) for c in counts)])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))]

    return _mapped(docs, path, key, text, "counts array<int>", made)


def tokens_at(counts: Column, n: Column) -> Column:
    """Tokens of the first n characters, from an array of prefix_counts(); beyond the text those of all of it."""
    return F.get(counts, F.least(F.greatest(n, F.lit(0)), F.size(counts) - 1).cast("int"))


def longest_within(counts: Column, limit: Column) -> Column:
    """Characters of the longest prefix with at most limit tokens, from an array of prefix_counts(); 0 where none has so few."""
    return F.greatest(F.lit(0), F.array_max(F.transform(counts, lambda c, n: F.when(c <= limit, n).otherwise(F.lit(0)))))


def truncated(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text (the longest prefix with at most limit tokens) and n_tokens; edges as in count_tokens(), a null text gives an empty one."""

    def made(texts: list[str], counts: list[PrefixCounts]) -> list[pa.Array]:
        cut = [c.fit(limit) for c in counts]
        return [pa.array([t[:n] for t, n in zip(texts, cut, strict=True)], pa.string()), pa.array([c.count(n) for c, n in zip(counts, cut, strict=True)], pa.int64())]

    return _mapped(docs, path, key, text, "text string, n_tokens long", made)
