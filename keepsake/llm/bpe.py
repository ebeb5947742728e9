"""Byte-pair encoding by a segment tree over adjacent pair ranks.

The leaves of a word's tree are the ranks of its adjacent pairs, with the place behind the rank, so that the root is
the leftmost pair of lowest rank. A merge changes three leaves (the pair itself, the one before, the one behind), each
in as many steps as the tree is high, until the root says that no pair can be merged. merge_word() does that for one
word of any length; merge_words() holds the trees of many short words as the rows of one array and takes a step of all
of them at a time.

Words are those of the tokenizer file: text is split at added tokens, normalised (NFC, lower case), cut at white space,
and each run is cut by the file's pattern. A run's ids don't depend on its neighbours, so that a bounded dictionary of
runs spares most of the work.
"""

from __future__ import annotations

import json
import struct
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from keepsake.llm._shared import small_batches, take_over, text_slices

NONE = 1 << 62
#: Longer words have a tree of their own.
SHORT = 64
#: Runs that a worker remembers at most, and the longest of them.
REMEMBERED, LONGEST = 1_500_000, 64
#: Words whose trees are worked on together.
TOGETHER = 8192


def byte_characters() -> list[str]:
    """The printable character of each byte: itself for visible Latin-1 characters, else the next ones from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in visible}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(visible))
    return [out[b] for b in range(256)]


def merge_word(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """symbols after all merges of pairs (pair -> rank, merged id), leftmost of the lowest rank first."""
    n = len(symbols)
    if n < 2:
        return list(symbols)
    ids, size = list(symbols), 1
    while size < n - 1:
        size *= 2
    behind, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def leaf(i: int) -> int:
        found = pairs.get((ids[i], ids[behind[i]])) if behind[i] < n else None
        return found[0] * n + i if found else NONE

    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = leaf(i)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k //= 2
        while k:
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least
            k //= 2

    while tree[1] < NONE:
        i = tree[1] % n
        j = behind[i]
        ids[i] = pairs[ids[i], ids[j]][1]
        behind[i] = behind[j]
        if behind[j] < n:
            before[behind[j]] = i
        if j < size:
            put(j, NONE)
        if i < size:
            put(i, leaf(i))
        if before[i] >= 0:
            put(before[i], leaf(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = behind[i]
    return out


class PairTable:
    """Pair ranks and merged ids for arrays of ids, by binary search of sorted keys."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([(a << 32) | b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks, self.merged = (np.array([v[k] for v in pairs.values()], dtype=np.int64)[order] for k in (0, 1))

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE where there is no such pair) and merged ids."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.merged[at]


def merge_words(flat: np.ndarray, length: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """merge_word() of words of at most SHORT symbols, their trees worked on together.

    flat has the words' symbols one after another, length how many each has; so has the result.
    """
    n = int(length.max(initial=0))
    if n < 2:
        return flat, length
    size = 1
    while size < n:
        size *= 2
    rows = len(length)
    ids = np.zeros((rows, size + 1), dtype=np.int64)
    ids[np.arange(size + 1) < length[:, None]] = flat
    behind = np.tile(np.arange(1, size + 2), (rows, 1))
    before = np.tile(np.arange(-1, size), (rows, 1))
    rank, _ = table.find(ids[:, :size], ids[:, 1:])
    places = np.arange(size)
    rank[places >= length[:, None] - 1] = NONE
    tree = np.full((rows, 2 * size), NONE, dtype=np.int64)
    tree[:, size:] = np.where(rank < NONE, rank * size + places, NONE)
    k = size
    while k > 1:
        k //= 2
        tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])

    def put(r: np.ndarray, i: np.ndarray, value: np.ndarray | int) -> None:
        at = size + i
        tree[r, at] = value
        at = at // 2
        while at[0]:
            tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])
            at = at // 2

    def leaves(r: np.ndarray, i: np.ndarray) -> np.ndarray:
        j = behind[r, i]
        found, _ = table.find(ids[r, i], ids[r, np.minimum(j, size)])
        return np.where((j < length[r]) & (found < NONE), found * size + i, NONE)

    live = np.flatnonzero(tree[:, 1] < NONE)
    gone = np.zeros((rows, size + 1), dtype=bool)
    while len(live):
        i = tree[live, 1] % size
        j = behind[live, i]
        ids[live, i] = table.find(ids[live, i], ids[live, j])[1]
        gone[live, j] = True
        after = behind[live, j]
        behind[live, i] = after
        before[live, np.minimum(after, size)] = i
        put(live, j, NONE)
        put(live, i, leaves(live, i))
        left = before[live, i]
        some = left >= 0
        if some.any():
            put(live[some], left[some], leaves(live[some], left[some]))
        live = live[tree[live, 1] < NONE]
    kept = (np.arange(size + 1) < length[:, None]) & ~gone
    return ids[kept], kept.sum(axis=1)


class WordBPE:
    """Encoder and decoder for a tokenizer file of the kind "lower-cased words with an end mark"."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        if kinds != ["NFC", "Replace", "Lowercase"] or split.get("type") != "Split" or spec["decoder"] is not None or model["continuing_subword_prefix"]:
            raise ValueError(f"{path} isn't a lower-casing word tokenizer without a decoder")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in self.vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.space = regex.compile(r"\p{White_Space}+")
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.table = PairTable(self.pairs)
        characters = byte_characters()
        self.inner = np.array([self.vocab[c] for c in characters], dtype=np.int64)
        self.last = np.array([self.vocab[c + self.end] for c in characters], dtype=np.int64)
        self.runs: dict[str, bytes] = {}

    def symbols(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all bytes of the pieces, the last of each with the end mark, and how many each piece has."""
        length = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ids, ends = self.inner[flat], np.cumsum(length) - 1
        ids[ends] = self.last[flat[ends]]
        return ids, length

    def encode_pieces(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """The pieces, in another order, with their ids as little-endian 32-bit numbers."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            raw = p.encode("utf-8")
            if len(raw) > SHORT:
                yield p, packed(np.array(merge_word(self.symbols([raw])[0].tolist(), self.pairs)))
            else:
                by_size.setdefault((len(raw) - 1).bit_length(), []).append((p, raw))
        for group in by_size.values():
            for k in range(0, len(group), TOGETHER):
                part = group[k : k + TOGETHER]
                ids, length = merge_words(*self.symbols([raw for _, raw in part]), self.table)
                whole, ends = packed(ids), (4 * np.cumsum(length)).tolist()
                yield from ((p, whole[a:b]) for (p, _), a, b in zip(part, [0, *ends], ends, strict=False))

    def learn(self, runs: Iterable[list[str]]) -> dict[str, bytes]:
        """Sees to it that the ids of short runs are remembered; returns those of the others."""
        if len(self.runs) > self.remembered:
            self.runs.clear()
        known = self.runs
        different: set[str] = set()
        for some in runs:
            different.update(some)
        new = [r for r in different if r not in known]
        cut = {r: self.pieces(r) for r in new if not r.isalpha()}
        pieces = {p for ps in cut.values() for p in ps if p not in known}
        pieces.update(r for r in new if r not in cut)
        fresh = dict(self.encode_pieces(list(pieces)))
        known.update((p, b) for p, b in fresh.items() if len(p) <= LONGEST)
        long = {p: b for p, b in fresh.items() if len(p) > LONGEST}
        for r, ps in cut.items():
            ids = b"".join([known[p] if p in known else long[p] for p in ps])
            (known if len(r) <= LONGEST else long)[r] = ids
        return long

    def cut(self, text: str) -> list[str]:
        """White-space-free runs of the normalised text."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # alone it has a final form, which the file's normaliser doesn't know
                text = text.replace("Σ", "σ")
            text = text.lower()
        else:
            text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python only
            return [r for r in self.space.split(text) if r]
        return text.split()

    def parts(self, text: str) -> list[list[str] | int]:
        """Lists of runs, and between them the ids of added tokens."""
        if "<|" not in text:
            return [self.cut(text)]
        return [self.added[x] if x in self.added else self.cut(x) for x in self.at_added.split(text) if x]

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text (null: none), as little-endian unsigned 32-bit numbers."""
        cut = [self.parts(t or "") for t in texts]
        long = self.learn(p for ps in cut for p in ps if isinstance(p, list))
        short, either = self.runs.__getitem__, _Beside(self.runs, long).__getitem__

        def ids(part: list[str] | int) -> bytes:
            if isinstance(part, int):
                return struct.pack("<I", part)
            try:
                return b"".join(map(short, part))
            except KeyError:  # one of its runs is too long to be remembered
                return b"".join(map(either, part))

        for ps in cut:
            yield b"".join(map(ids, ps))

    def encode(self, text: str | None) -> list[int]:
        return unpacked(next(self.encode_batch([text]))).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The file names no decoder: its tokens as they stand, with spaces between them."""
        return " ".join(map(self.tokens.__getitem__, ids))


class _Beside:
    """Two dictionaries as one, without a copy of either: the second has what the first lacks."""

    def __init__(self, first: dict[str, bytes], second: dict[str, bytes]):
        self.first, self.second = first, second

    def __getitem__(self, run: str) -> bytes:
        found = self.first.get(run)
        return self.second[run] if found is None else found


def packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def unpacked(raw: bytes) -> array:
    out = array("I", raw)
    if sys.byteorder == "big":
        out.byteswap()
    return out


@lru_cache(maxsize=1)
def _word_bpe(path: str, remembered: int) -> WordBPE:
    return WordBPE(path, remembered)


def word_bpe(path: str, remembered: int = REMEMBERED) -> WordBPE:
    """One for each Python worker, while that works on it."""
    take_over("bpe", _word_bpe.cache_clear)
    return _word_bpe(path, remembered)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array<int>) and decoded, the text that the ids give back; one row per row of docs.

    Null texts count as empty, with no ids. Null or repeated keys pass through, other columns are left out. Work is per
    row: nothing is shuffled, and a worker holds a few million characters and a bounded dictionary at a time.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for keys, texts in text_slices(batches):
            ids = [unpacked(raw) for raw in bpe.encode_batch(texts)]
            yield pa.RecordBatch.from_arrays([keys, pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], ["key", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """encode() as digests: key, n_tokens, ids_sha256, decoded_sha256, made where the ids are, so that no list travels.

    A null text is empty and has the digests of no bytes. Texts are taken whole, a text over AT_ONCE bytes by itself. One row per row of docs, repeated rows and null
    keys too; other columns are ignored, an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for keys, texts in text_slices(batches):
            n, a, b = [], [], []
            for raw in bpe.encode_batch(texts):
                n.append(len(raw) // 4)
                a.append(sha256(raw).hexdigest())
                b.append(sha256(bpe.decode(unpacked(raw)).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
