"""Exact top-k inner products over an impact-ordered index, score at a time.

Components are turned into integers, floor(SCALE * x). For each dimension a block of vectors keeps its postings ordered by impact, in
segments of equal quantised impact. A query processes segments by descending contribution, whichever dimension they
belong to; a query's negative component reads its dimension from the other end. After each level the vectors that have gathered
most are scored exactly, which gives a score that the k-th best reaches at least; every other vector is bounded by what it has gathered and
what its unmet dimensions could add at most, each no more than its next segment. Processing stops only on proof: all but the possible members lie
below that score, and to score those costs less than to read on. They are then scored exactly.

How early that is depends on the data: where few components are large, one posting in a hundred is read; where vectors lie in all directions
alike, more than half are, and the more vectors a block has, the fewer.

Vectors are cut into blocks. A block's index is made once in a task, and some thousands of queries run through it in the order of the
shuffle; of each meeting only k rows a query remain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
#: Impacts in a segment differ by less than this; levels on either side of 0 that a query's contributions are processed in.
STEP, LEVELS = 8, 8
#: Vectors of a block (about), and queries that run through its index in one task (about).
BLOCK, QUERIES = 16_384, 8_192


class ImpactIndex:
    """Postings of one block: for each dimension, vectors in descending order of impact, with the starts of segments."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = np.ascontiguousarray(vectors, dtype=np.int64)
        level = np.floor_divide(self.vectors, STEP)
        self.order, self.impact, self.tops, self.ends, self.bottoms = [], [], [], [], []
        self.read = self.rescored = 0
        for d in range(self.vectors.shape[1]):
            order = np.argsort(-self.vectors[:, d], kind="stable")
            impact, of = self.vectors[order, d], level[order, d]
            cut = np.flatnonzero(np.r_[of[1:] != of[:-1], True]) + 1
            self.order.append(order)
            self.impact.append(impact)
            self.ends.append(cut)
            self.tops.append(impact[np.r_[0, cut[:-1]]] if len(impact) else impact)
            self.bottoms.append(impact[cut - 1] if len(impact) else impact)

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of the k best vectors and of all that tie with the last of them. read becomes the postings that were processed, rescored the vectors."""
        n, dims = self.vectors.shape
        query = query.astype(np.int64)
        self.read, self.rescored = 0, 0
        used = [d for d in range(dims) if query[d]]
        if n <= 8 * k or not used:
            return self._best(np.arange(n), query, k)
        # a segment's largest contribution; for a negative component the segments are read from the last to the first
        bound = {d: query[d] * (self.tops[d] if query[d] > 0 else self.bottoms[d][::-1]) for d in used}
        done = dict.fromkeys(used, 0)
        # the gathered score, and in its lowest bits in how many dimensions a vector is still unmet
        bits = len(used).bit_length()
        packed = np.full(n, len(used), dtype=np.int64)
        proof = None
        levels = self._levels(max((int(b[0]) for b in bound.values()), default=0), min((int(b[-1]) for b in bound.values()), default=0))
        for turn, threshold in enumerate(levels):
            for d in used:
                at, to = done[d], int(np.searchsorted(-bound[d], -threshold, side="right"))
                if to <= at:
                    continue
                ends = self.ends[d]
                if query[d] > 0:
                    a, z = (int(ends[at - 1]) if at else 0), int(ends[to - 1])
                else:
                    last = len(ends)
                    a, z = (int(ends[last - to - 1]) if to < last else 0), int(ends[last - at - 1])
                self.read += z - a
                packed[self.order[d][a:z]] += (query[d] * self.impact[d][a:z] << bits) - 1
                done[d] = to
            # those that have gathered most are scored: a member's score is no less than the k-th best of them
            gathered = packed >> bits
            some = np.argpartition(gathered, n - 4 * k)[n - 4 * k :]
            self.rescored += len(some)
            best = int(np.partition(self.vectors[some] @ query, 3 * k)[3 * k])
            proof = best if proof is None else max(proof, best)
            # what is unmet adds no more than the next segment of its dimension
            rest = [int(bound[d][done[d]]) for d in used if done[d] < len(bound[d])]
            unmet, most, all_ = packed & ((1 << bits) - 1), max(rest, default=0), sum(x for x in rest if x > 0)
            possible = np.flatnonzero(gathered + (np.minimum(unmet * most, all_) if most > 0 else unmet * most) >= proof)
            if not rest or len(possible) * dims <= self._ahead(query, bound, done, levels[turn + 1]):
                break
        self.rescored += len(possible)
        return self._best(possible, query, k)

    def _ahead(self, query: np.ndarray, bound: dict[int, np.ndarray], done: dict[int, int], threshold: int) -> int:
        """Postings that lie before the next level: where to score the possible members costs less than to read them, a search ends."""
        out = 0
        for d, at in done.items():
            to, ends = int(np.searchsorted(-bound[d], -threshold, side="right")), self.ends[d]
            if to > at:
                last = len(ends)
                a, z = (at, to) if query[d] > 0 else (last - to, last - at)
                out += int(ends[z - 1]) - (int(ends[a - 1]) if a else 0)
        return out

    @staticmethod
    def _levels(high: int, low: int) -> list[int]:
        """Descending thresholds from the largest contribution to the least; dense around 0, where most postings lie."""
        share = np.linspace(1, 0, LEVELS, endpoint=False)[1:] ** 2
        return sorted({*(int(high * x) for x in share), 0, *(int(low * x) for x in share[::-1]), low}, reverse=True)

    def _best(self, places: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores = self.vectors[places] @ query
        if len(places) > k:
            kept = scores >= np.partition(scores, len(places) - k)[len(places) - k]
            places, scores = places[kept], scores[kept]
        return places, scores


def integers(embedding: Column) -> Column:
    """floor(SCALE * x) of each component as a double; null for vectors that are null, empty or hold null or non-finite components."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when((F.size(embedding) > 0) & finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", embedding: str = "embedding", block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query holds for, the k rows with the largest inner product, but its own key; ties go to the smaller key.

    Vectors are compared with those of the same length. Null, ragged or non-finite vectors and null keys take no part;
    rows that repeat a key are each a candidate, and a repeated query is asked once for each of its different vectors
    (its rows are ranked together). Other columns are ignored. Fewer than k candidates give fewer rows, an empty table none.
    A task holds the vectors of a block and some thousands of queries; each query goes to every block, as an exact answer needs, and where there are
    more queries a block is several tasks' work.
    """
    rows = vectors.select(vectors[key].cast("long").alias("id"), integers(vectors[embedding]).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.withColumn("dims", F.size("v"))
    sizes = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("asked").alias("asked")).first()
    blocks, parts = (max(1, math.ceil(x / most)) for x, most in ((sizes["rows"], block), (sizes["asked"], queries)))
    turn = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    place = lambda many, of: F.pmod(F.xxhash64("id", F.lit(of)), F.lit(many)).cast("int")
    asked = rows.where("asked").select("dims", "id", "v").distinct().select("dims", turn(blocks).alias("block"), place(parts, "query").alias("part"), F.lit(1).alias("asks"), "id", "v")
    held = rows.select("dims", place(blocks, "vector").alias("block"), turn(parts).alias("part"), F.lit(0).alias("asks"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held_parts, index, ids, order = None, [], None, None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dims", "block", "part", "asks")], axis=1)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True]) if len(keys) else []
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                part, place = batch.slice(a, z - a), tuple(keys[a, :3])
                if place != now:
                    now, held_parts, index = place, [], None
                if not keys[a, 3]:  # vectors come before the queries of their block
                    held_parts.append((part.column("id").to_numpy(), matrix(part.column("v"))))
                elif held_parts:
                    if index is None:
                        ids, index = np.concatenate([x for x, _ in held_parts]), ImpactIndex(np.concatenate([v for _, v in held_parts]))
                        order = np.argsort(ids, kind="stable")
                    yield found(index, ids, ids[order], part)

    def found(index: ImpactIndex, ids: np.ndarray, in_order: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for q, vector in zip(part.column("id").to_numpy(), matrix(part.column("v")), strict=True):
            repeats = int(np.searchsorted(in_order, q, side="right") - np.searchsorted(in_order, q, side="left"))
            places, scores = index.search(vector, min(len(ids), k + repeats))
            own = ids[places] != q
            near, scores = ids[places][own], scores[own]
            best = np.lexsort((near, -scores))[:k]
            out.append(np.stack([np.full(len(best), q), near[best], scores[best]]))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in np.concatenate(out, axis=1)], ["query_id", "vec_id", "score"])

    # a partition a block, whatever the shuffles of the session are cut into
    dealt = held.union(asked).repartition(blocks * parts, "dims", "block", "part").sortWithinPartitions("dims", "block", "part", "asks", "id")
    near = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of one length as the rows of an array."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def brute_force(ids: Iterator[int], vectors: np.ndarray, queries: Iterator[int], k: int) -> list[tuple[int, int, int, int]]:
    """What top_k() returns, by scoring every pair; for tests."""
    ids = list(ids)
    out = []
    for q in queries:
        v = vectors[ids.index(q)]
        ranked = sorted((-int(np.dot(v, w)), i) for i, w in zip(ids, vectors, strict=True) if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)]
    return out


def oracle(divisor: int, k: int) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {divisor} = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= {k}"""
