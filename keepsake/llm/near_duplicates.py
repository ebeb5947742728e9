"""Near-duplicate documents by MinHash with tensored banding.

A document is its set of word shingles. GROUPS groups of ROWS minhashes each are computed; the key of a table combines
two groups, so that GROUPS * (GROUPS - 1) / 2 tables of 2 * ROWS minhashes come from only GROUPS * ROWS of them. Two sets
of Jaccard similarity s meet in a table if at least two groups agree; at s = 0.8 that fails once in 20,000 pairs.
Every link is confirmed on full sets, as 64-bit hashes of whole shingles.

Sets that are equal are one node. Most nodes share no group with another one and leave before table keys are made.
Within a bucket pairs are not spelled out: nodes that verified links have joined need no further link, so rounds
propose one partner for each node from another component of its buckets, confirm, and merge components. When rounds
find little more, the nodes of a bucket that are outside its largest component are compared with all others, in blocks.
No link that could join two components is skipped, and a group of n near copies costs about n confirmations and, for k
nodes that stay outside, k * n comparisons.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm._shared import small_batches, superseded, take_over, text_slices, written

SHINGLE, PERCENT = 4, 80
GROUPS, ROWS = 18, 3
#: Parts that a frequent key's rows are dealt to, at least.
SALTS = 16
#: Rounds at most; a round that confirms a smaller share of its proposals is the last.
MAX_ROUNDS, ENOUGH_PERCENT = 6, 10
#: Rows of the loops' tables that are worth a file, and rows of the table of buckets that a node has (about).
ROWS_A_FILE, ROWS_A_NODE = 200_000, 60
#: A bucket is put in order in as many parts as all nodes would make of this size.
ROWS_A_PART = 20_000
#: Members of components that are compared pair by pair; of larger ones, shingles of members and of questioners that meet at a time.
SMALL, BLOCK, ASKED = 16, 1 << 17, 1 << 18
#: Nodes of a bucket that are compared at a time; one-bit minhashes, and differing ones of a pair at most.
BUCKET_BLOCK, BITS, FAR = 2048, 512, 96
#: Nodes whose numbers are broadcast at most, to leave out the sets of others.
KNOWN = 500_000
REMEMBERED, LONGEST = 400_000, 64
#: Multipliers are drawn once from a fixed seed.
_RNG = np.random.default_rng(20_260_101)
_WORD = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_TIMES = _RNG.integers(1, 1 << 63, GROUPS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, GROUPS * ROWS, dtype=np.uint64) * np.uint64(2)
_OF_GROUP = _RNG.integers(1, 1 << 63, (GROUPS, ROWS), dtype=np.uint64) | np.uint64(1)
_BIT_TIMES = _RNG.integers(1, 1 << 63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BIT_PLUS = _RNG.integers(0, 1 << 63, BITS, dtype=np.uint64) * np.uint64(2)
_words: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the different shingles of a text's words, A-Z in lower case; of fewer words the whole sequence is one."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    known = _words
    if len(known) > REMEMBERED:
        known.clear()
    long = {}
    for w in set(words):
        if w not in known:
            (known if len(w) <= LONGEST else long)[w] = word_hash(w)
    look = (known | long if len(long) > 1_000 else {**{w: known[w] for w in set(words) if w in known}, **long}) if long else known
    h = np.fromiter(map(look.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(size, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out += mixed(h[k : len(h) - n + 1 + k] * _WORD[k]) * _WORD[size + k]
    return np.unique(mixed(out + np.uint64(n)))


def group_hashes(values: np.ndarray) -> np.ndarray:
    """One number for each group of minhashes of a set that isn't empty."""
    least = np.full(GROUPS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(values), 4096):
        least = np.minimum(least, (values[k : k + 4096, None] * _TIMES + _PLUS).min(axis=0))
    return mixed((mixed(least.reshape(GROUPS, ROWS)) * _OF_GROUP).sum(axis=1, dtype=np.uint64))


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (size of the set), print (128 bits that stand for the set) and groups of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("near duplicates", _words.clear)
        for keys, texts in text_slices(batches):
            n, marks, groups = [], [], []
            for t in texts:
                s = shingles(t)
                n.append(len(s))
                marks.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                groups.append(group_hashes(s).view(np.int64) if len(s) else np.zeros(0, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, groups)]), pa.int32()), pa.array(np.concatenate(groups) if groups else []))
            yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(marks, pa.binary()), lists], ["doc_id", "n", "print", "groups"])

    return docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")).mapInArrow(run, "doc_id long, n long, print binary, groups array<long>")


def in_several(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Rows whose key occurs in several rows. Keys are counted with partial sums; what is joined is salted, so that a frequent key spreads.

    Spark takes the salted keys for as few as they were before and would broadcast SALTS times as many: they are merged, here and below.
    """
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS))
    often = rows.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_s"))
    return rows.join(often.hint("merge"), (F.col(key) == F.col("_k")) & (salt == F.col("_s")), "left_semi")


def table_rows(nodes: DataFrame) -> DataFrame:
    """key, t, node, n: a row for each table t in which the node can meet another one; from node, n, groups."""
    spread = nodes.select("node", "n", F.posexplode("groups").alias("g", "h"))
    met = in_several(spread, "h", "node").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("g", "h"))).alias("met")).where(F.size("met") > 1)
    pairs = F.expr(f"flatten(transform(met, (x, i) -> transform(slice(met, i + 2, size(met)), y -> named_struct('key', xxhash64(x.h, y.h), 't', x.g * {GROUPS} + y.g))))")
    return in_several(met.select("node", "n", F.explode(pairs).alias("p")).select("p.key", "p.t", "node", "n"), "key", "node")


def full_sets(docs: DataFrame, nodes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """node, print, values (the set's hashes as bytes) of the given nodes: (node, print)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("near duplicates", _words.clear)
        for keys, texts in text_slices(batches):
            sets = [shingles(t) for t in texts]
            yield pa.RecordBatch.from_arrays([keys, pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "made", "values"])

    own = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")).join(nodes.select(F.col("node").alias("key")).distinct(), "key", "left_semi")
    made = own.mapInArrow(run, "node long, made binary, values binary")
    return made.join(nodes.select("node", F.col("print").alias("made")), ["node", "made"], "left_semi").dropDuplicates(["node", "made"]).select("node", "values")


def of_nodes(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The sets of the given nodes, or all sets where those are too many to be broadcast (KNOWN, counted): the join that follows finds them then.

    A set is thousands of times as large as its node's number, so sets that nobody asks for shouldn't be shuffled.
    """
    own = nodes.select("node").distinct()
    return sets.join(F.broadcast(own), "node", "left_semi") if own.count() <= KNOWN else sets


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. pairs are read several times: a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                common = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first, second = (of_nodes(sets, pairs.select(F.col(k).alias("node"))).select(F.col("node").alias(k), F.col("values").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def merged(labels: DataFrame, links: DataFrame, files: int) -> DataFrame:
    """labels (node, label) after the components that links (a, b) join have become one; a label is the least node of its component.

    Each step every label takes the least label next to it, pointers are followed a few times, and links between
    equal labels go; the others are links between labels, fewer each time. labels is given up for the table that is returned.
    """
    left, right = (labels.select(F.col("node").alias(k), F.col("label").alias(v)) for k, v in (("a", "u"), ("b", "v")))
    rest = written(links.join(left, "a").join(right, "b").where("u <> v").select("u", "v").distinct(), "links", files)
    while not rest.isEmpty():
        both = rest.union(rest.select("v", "u"))
        near = written(both.groupBy(F.col("u").alias("old")).agg(F.min("v").alias("v")).select("old", F.least("old", "v").alias("new")), "pointers", files)
        to = near
        for _ in range(3):
            again = to.select(F.col("old").alias("new"), F.col("new").alias("far"))
            to = to.join(again, "new", "left").select("old", F.coalesce("far", "new").alias("new"))
        to = written(to, "pointers", files)
        older, used = labels, rest
        labels = written(labels.join(to, labels["label"] == to["old"], "left").select("node", F.coalesce("new", "label").alias("label")), "labels", files)
        u, v = to.select(F.col("old").alias("u"), F.col("new").alias("x")), to.select(F.col("old").alias("v"), F.col("new").alias("y"))
        rest = written(rest.join(u, "u").join(v, "v").where("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v")).distinct(), "links", files)
        superseded(older, used, near, to)
    superseded(rest)
    return labels


def similar_size(a: str, b: str, percent: int = PERCENT):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def proposals(rows: DataFrame, turn: int, parts: int = SALTS) -> DataFrame:
    """For each node of rows (key, node, n, label) at most one partner of another component that it is next to in most buckets.

    Buckets are ordered by size in the first turn and by a hash of the turn in later ones, in parts; the first of
    each part stands next to the first of the part before.
    """
    salt = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(parts))
    order = F.col("n") if turn == 0 else F.xxhash64("node", F.lit(-turn))
    item = F.struct(order.alias("o"), "node", "n", "label")
    placed = rows.select("key", salt.alias("salt"), item.alias("item"))
    near = placed.withColumn("other", F.lag("item").over(Window.partitionBy("key", "salt").orderBy("item")))
    heads = placed.groupBy("key", "salt").agg(F.min("item").alias("item"))
    heads = heads.withColumn("other", F.lag("item").over(Window.partitionBy("key").orderBy("item")))
    both = near.select("item", "other").union(heads.select("item", "other")).where("other IS NOT NULL AND item.label <> other.label")
    both = both.select(F.col("item.node").alias("b"), F.col("other.node").alias("a"), F.col("item.n").alias("nb"), F.col("other.n").alias("na")).where(similar_size("na", "nb"))
    counted = both.groupBy("b", "a").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy("b").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def mixed_buckets(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (key, t, node, n) with their labels, of buckets that hold several components."""
    own = rows.select("key", "t", "node", "n").join(labels, "node")
    several = own.groupBy("key").agg(F.min("label").alias("_l"), F.max("label").alias("_m")).where("_l <> _m").select(F.col("key").alias("_k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_s"))
    return own.join(several.hint("merge"), (F.col("key") == F.col("_k")) & (F.pmod(F.xxhash64("node"), F.lit(SALTS)) == F.col("_s")), "left_semi")


def with_bits(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, marks (the groups) and bits (BITS one-bit minhashes) of the given nodes, as bytes; made from their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups, bits = [], []
            for v in b.column("values"):
                s = np.frombuffer(v.as_buffer(), dtype=np.uint64)
                groups.append(group_hashes(s).tobytes())
                bits.append(one_bit(s).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(groups, pa.binary()), pa.array(bits, pa.binary())], ["node", "marks", "bits"])

    return sets.join(nodes.select("node").distinct(), "node", "left_semi").mapInArrow(run, "node long, marks binary, bits binary")


def one_bit(values: np.ndarray) -> np.ndarray:
    """One bit of each of BITS minhashes, as bytes. Two sets agree in a bit with probability (1 + similarity) / 2."""
    least = np.full(BITS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(values), 2048):
        least = np.minimum(least, (values[k : k + 2048, None] * _BIT_TIMES + _BIT_PLUS).min(axis=0))
    return np.packbits((mixed(least) >> np.uint64(17) & np.uint64(1)).astype(np.uint8))


def open_pairs(rows: DataFrame, described: DataFrame, counts: DataFrame) -> DataFrame:
    """(a, b, label): what is left to compare in buckets that hold several components; from key, t, node, n, label.

    Nodes of a bucket's largest component need no comparison with each other: the others, its strays, ask all. So a bucket of n nodes with k
    strays costs k * n comparisons. Two nodes of small components are a pair (a, b), reported by the first bucket in which they
    meet. A node and a large component (more than SMALL members) are a question (a, label), for all of its members. Pairs whose sizes
    exclude a link are left out, and so are pairs whose one-bit minhashes differ in more than FAR bits, which nodes of the
    similarity that counts do once in a billion times. Large buckets are cut in blocks, and their strays in parts; each block meets each part by itself.
    """
    shares = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    blocks, parts = (F.greatest(F.lit(1), F.ceil(x / F.lit(BUCKET_BLOCK))).cast("long") for x in (F.sum("c"), F.sum("c") - F.max("c")))
    sizes = shares.groupBy("key").agg(blocks.alias("blocks"), parts.alias("parts"), F.max_by("label", F.struct("c", "label")).alias("most"))
    placed = rows.join(sizes, "key")
    own = [F.pmod(F.xxhash64("node"), F.col(c)) for c in ("blocks", "parts")]
    member = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.struct(own[0].alias("block"), k.alias("part"), F.lit(False).alias("asks")))
    asker = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(k.alias("block"), own[1].alias("part"), F.lit(True).alias("asks")))
    placed = placed.withColumn("at", F.explode(F.when(F.col("label") == F.col("most"), member).otherwise(F.concat(member, asker))))
    large = counts.where(F.col("c") > SMALL).select("label", F.lit(True).alias("large"))
    placed = placed.join(large, "label", "left").join(described, "node")
    placed = placed.select("key", "at.block", "at.part", "at.asks", (F.col("label") != F.col("most")).alias("stray"), "t", "node", "n", "label", F.coalesce("large", F.lit(False)).alias("large"), "marks", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            # the last block of a batch may go on in the next one
            whole = pa.Table.from_batches([*held, b]).combine_chunks()
            keys = np.stack([whole.column(c).to_numpy() for c in ("key", "block", "part")], axis=1)
            last = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = whole.slice(cut).to_batches()
            if cut:
                yield compared(whole.slice(0, cut), keys[:cut])
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield compared(whole, np.stack([whole.column(c).to_numpy() for c in ("key", "block", "part")], axis=1))

    dealt = placed.repartition("key", "block", "part").sortWithinPartitions("key", "block", "part")
    return dealt.mapInArrow(run, "a long, b long, label long")


def compared(rows: pa.Table, keys: np.ndarray) -> pa.RecordBatch:
    """open_pairs() of whole blocks, which lie one behind another."""
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    ends = np.r_[starts[1:], len(keys)]
    node, n, label, tables = (rows.column(c).to_numpy() for c in ("node", "n", "label", "t"))
    asks, stray, large = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "stray", "large"))
    marks, bits = (np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=np.uint64).reshape(len(keys), -1) for c in ("marks", "bits"))
    a, b, of = [], [], []
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        at = np.arange(s, e)
        left, right = at[asks[s:e]], at[~asks[s:e]]
        for k in range(0, len(left), 256):
            x = left[k : k + 256]
            fits = (label[x, None] != label[None, right]) & (100 * np.minimum(n[x, None], n[None, right]) >= PERCENT * np.maximum(n[x, None], n[None, right]))
            fits &= ~stray[None, right] | (node[x, None] < node[None, right])  # of two strays the smaller asks
            p, q = np.nonzero(fits)
            p, q = x[p], right[q]
            near = np.concatenate([np.bitwise_count(bits[p[i : i + 65_536]] ^ bits[q[i : i + 65_536]]).sum(axis=1) <= FAR for i in range(0, len(p), 65_536)] or [np.zeros(0, dtype=bool)])
            p, q = p[near], q[near]
            ask = large[p] | large[q]
            one, two = p[ask], q[ask]
            swap = ~large[two]  # the large one is asked; of two large ones the second
            one, two = np.where(swap, two, one), np.where(swap, one, two)
            if len(one):
                unique = np.unique(np.stack([node[one], label[two]], axis=1), axis=0)
                a.append(unique[:, 0])
                b.append(np.full(len(unique), -1))
                of.append(unique[:, 1])
            p, q = p[~ask], q[~ask]
            agree = marks[p] == marks[q]
            first = np.argmax(agree, axis=1)
            agree[np.arange(len(p)), first] = False
            here = first * GROUPS + np.argmax(agree, axis=1) == tables[s]
            p, q = p[here], q[here]
            a.append(node[p])
            b.append(node[q])
            of.append(np.full(len(p), -1))
    out = [np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (a, b, of)]
    none = out[1] == -1
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64(), mask=none), pa.array(out[2], pa.int64(), mask=~none)], ["a", "b", "label"])


def answers(left: DataFrame, labels: DataFrame, sets: DataFrame, tested: DataFrame | None) -> DataFrame:
    """Confirmed links of open_pairs().

    Pairs are compared as they are. Of a large component, members of BLOCK shingles at a time meet questioners of ASKED
    shingles: one pass over a sorted index of the block's values counts what a questioner has in common with every member.
    """
    pairs = left.where("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    few = confirmed(written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs"), sets)
    large = written(left.where("b IS NULL").select("a", "label").distinct(), "questions")
    sized = sets.select("node", F.expr("octet_length(values) DIV 8").alias("n"))
    many = large.join(sized, F.col("a") == F.col("node")).groupBy("label").agg(F.sum("n").alias("q"))
    whole = labels.join(large.select("label").distinct(), "label", "left_semi").join(sized, "node").groupBy("label").agg(F.sum("n").alias("c"))
    shape = many.join(whole, "label").select("label", F.ceil(F.col("c") / BLOCK).cast("long").alias("blocks"), F.ceil(F.col("q") / ASKED).cast("long").alias("parts"))

    def spread(df: DataFrame, node: str, count: str, own: str, other_count: str, other: str) -> DataFrame:
        placed = df.join(shape, "label").withColumn(own, F.pmod(F.xxhash64(node), F.col(count)))
        placed = placed.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_count) - 1)))
        held = of_nodes(sets, df.select(F.col(node).alias("node"))).select(F.col("node").alias(node), F.col("values").alias(f"of_{own}"))
        return placed.join(held, node).select("label", "block", "part", F.col(node).alias("node"), F.col(f"of_{own}").alias("values"))

    asking = spread(large.select("label", "a"), "a", "parts", "part", "blocks", "block")
    asked = spread(labels.join(shape.select("label"), "label", "left_semi").select("label", F.col("node").alias("b")), "b", "blocks", "block", "parts", "part")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            own = [np.frombuffer(v, dtype=np.uint64) for v in right.column("values").to_pylist()]
            size = np.array([len(x) for x in own])
            values = np.concatenate(own)
            order = np.argsort(values, kind="stable")
            values, member = values[order], np.repeat(np.arange(len(own)), size)[order]
            names = right.column("node").to_numpy()
            for node, v in zip(left.column("node").to_pylist(), left.column("values").to_pylist(), strict=True):
                x = np.frombuffer(v, dtype=np.uint64)
                start, end = np.searchsorted(values, x), np.searchsorted(values, x, side="right")
                n = end - start
                total = int(n.sum())
                at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(total)
                common = np.bincount(member[at], minlength=len(own))
                linked = names[100 * common >= PERCENT * (size + len(x) - common)]
                a += [node] * len(linked)
                b += linked.tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    keys = ["label", "block", "part"]
    many = asking.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, "a long, b long").where("a <> b")
    return few.union(many)


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of docs.

    Texts without a word (null, empty) have no shingle and link with nothing. A row with a null doc_id can't be named by a link: it
    takes no part, with a null component, and is kept. Rows that repeat a doc_id are judged each by its own text. Other columns are
    ignored; an empty table gives an empty one. A text of any length is taken whole, one row at a time. Texts are read twice, the second time those of nodes that met another one.
    """
    small_batches(docs.sparkSession)
    drawn = written(sketches(docs, key, text), "sketches")
    named = drawn.where("n > 0 AND doc_id IS NOT NULL")
    nodes = written(named.groupBy("print").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("groups").alias("groups")), "nodes")
    rows = written(table_rows(nodes.select("node", "n", "groups")), "tables")
    labels = rows.select("node").distinct().withColumn("label", F.col("node"))
    moved = None
    if not rows.isEmpty():
        labels = written(labels, "labels")
        count = labels.count()
        # the loops' tables are small beside the texts; files for their rows, whatever the shuffles are cut into
        files, row_files = (max(drawn.sparkSession.sparkContext.defaultParallelism, math.ceil(x * count / ROWS_A_FILE)) for x in (1, ROWS_A_NODE))
        sets = written(full_sets(docs, nodes.join(labels, "node", "left_semi").select("node", "print"), key, text), "sets")
        tested, held = None, rows
        for turn in range(MAX_ROUNDS):
            mixed_rows = written(mixed_buckets(rows, labels), "mixed", row_files)
            superseded(held)
            held, rows = mixed_rows, mixed_rows.select("key", "t", "node", "n")
            if mixed_rows.isEmpty():
                break
            pairs = proposals(mixed_rows, turn, max(SALTS, math.ceil(count / ROWS_A_PART)))
            pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs", files)
            links = written(confirmed(pairs, sets), "confirmed", files)
            tested = pairs if tested is None else tested.union(pairs)
            found = links.count()
            if found:
                labels = merged(labels, links, files)
            superseded(links)
            if turn and 100 * found < pairs.count() * ENOUGH_PERCENT:
                break
        last = written(mixed_buckets(rows, labels), "mixed", row_files)
        superseded(held)
        if not last.isEmpty():
            counts = written(labels.groupBy("label").agg(F.count(F.lit(1)).alias("c")), "counts", files)
            left = written(open_pairs(last, with_bits(sets, last), counts), "open")
            links = written(answers(left, labels, sets, tested), "confirmed")
            superseded(counts, left)
            labels = merged(labels, links, files)
            superseded(links)
        superseded(last, sets)
        moved = labels.where("node <> label")
    found = nodes.select("print", "node", "copies")
    found = found.join(moved, "node", "left") if moved is not None else found.withColumn("label", F.lit(None).cast("long"))
    found = found.where("copies > 1 OR label IS NOT NULL").select(F.col("print").alias("of"), F.coalesce("label", "node").alias("component"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("part"))
    whole = drawn.join(found.hint("merge"), (drawn["print"] == found["of"]) & (F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)) == found["part"]), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose component has a document with a smaller doc_id; all columns, whatever their names.

    Rows with a null doc_id stay. Of rows that repeat both doc_id and text one stays; only rows of such ids are shuffled
    for that. An empty table stays empty.
    """
    own = "_id"
    while own in {c.lower() for c in docs.columns}:
        own += "_"
    found = written(components(docs, key, text), "components")
    gone = found.where("NOT kept").select(F.col("doc_id").alias(own)).distinct()
    kept = docs.join(gone, docs[key] == F.col(own), "left_anti")
    again = found.where("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(own)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(own)
    if again.isEmpty():
        return kept
    once = kept.join(again, kept[key] == F.col(own), "left_semi").dropDuplicates([key, text])
    return kept.join(again, kept[key] == F.col(own), "left_anti").unionByName(once)


def tables_of(groups: int = GROUPS) -> list[tuple[int, int]]:
    """The pairs of groups that make a table's key."""
    return list(combinations(range(groups), 2))
