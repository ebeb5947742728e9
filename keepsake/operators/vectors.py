"""Vectors in cells around pivots: an exact threshold join, and a stored index with exact and probed search.

Pivots are the centres of a bounded sample (spherical k-means); each vector lies in the cell of its nearest pivot. Angles obey the
triangle inequality: whatever is within an angle of a vector lies in cells whose pivot is not farther from it than that angle and the cell's
radius together, and not farther behind the plane halfway between two pivots than the chord. Everything else never meets.

Null vectors, empty ones, ones with a null or non-finite component and ones of length 0 take no part. A cosine has two vectors of
the same number of components; others have nothing to do with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.operators.graph import held

#: Bounds of the sample: rows, and components of all together. Bounds of the pivots.
SAMPLE_ROWS, SAMPLE_VALUES, MAX_CELLS = 16_384, 4_000_000, 1024
#: Vectors that meet at a time in the stored index, and those that ask them.
MEMBERS, VISITORS = 2048, 8192
#: In the threshold join vectors go to a group of cells at once. Groups that all vectors would make (about), vectors of a group at least, and their components at most.
GROUPS, GROUP_ROWS, GROUP_VALUES = 8, 8192, 4_000_000
#: What rounding may take from an angle.
SLACK = 1e-6


def usable(embedding: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(embedding) > 0) & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each number of components in a list column without nulls."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        v = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), int(n))
        v = v / np.abs(v).max(axis=1, keepdims=True)  # so that no square leaves the doubles
        yield rows, v / np.linalg.norm(v, axis=1, keepdims=True)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def pivots(vectors: DataFrame, cells: int, key: str = "id", embedding: str = "v", rounds: int = 8) -> dict[int, np.ndarray]:
    """Unit pivots by number of components: at most cells for each, from the usable vectors with the least hash of their key (a bounded sample).

    A number of components that the sample lacks has no pivot: its vectors are one cell.
    """
    first = vectors.select(F.size(embedding).alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").limit(16).collect()
    out = {}
    for n, count in ((r["n"], r["count"]) for r in first):
        most = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // n))
        share = min(1.0, 1.5 * most / count)
        own = vectors.where(F.size(embedding) == n).where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 20)) <= math.ceil(share * (1 << 20))).select(F.col(embedding).cast("array<double>").alias("v"), F.xxhash64(key, F.lit(17)).alias("h"))
        rows = own.orderBy("h", "v").limit(most).select("v").toArrow().column("v").combine_chunks()
        sample = np.concatenate([u for _, u in _units(rows)]) if len(rows) else np.zeros((0, n))
        sample = np.unique(sample, axis=0)
        own_cells = min(cells, max(1, len(sample) // 4))
        centres = sample[np.random.default_rng(5).permutation(len(sample))[:own_cells]]
        for _ in range(rounds):
            near = (sample @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, sample)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
        if len(centres):
            out[int(n)] = centres
    return out


def in_cells(vectors: DataFrame, of: dict[int, np.ndarray], key: str = "id", embedding: str = "v") -> DataFrame:
    """id, n (components), cell, angle (to the cell's pivot), unit (the unit vector's doubles as bytes) of all usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, units in _units(b.column(1)) if b.num_rows else ():
                n = units.shape[1]
                cell, angle = np.zeros(len(rows), dtype=np.int32), np.zeros(len(rows))
                if n in of:
                    near = units @ of[n].T
                    cell = near.argmax(axis=1).astype(np.int32)
                    angle = _angle(near[np.arange(len(rows)), cell])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), n, dtype=np.int32)), pa.array(cell), pa.array(angle), pa.array([u.tobytes() for u in units], pa.binary())], ["id", "n", "cell", "angle", "unit"])

    own = vectors.where(usable(F.col(embedding))).select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    return own.mapInArrow(run, "id long, n int, cell int, angle double, unit binary")


def radii(placed: DataFrame) -> dict[tuple[int, int], tuple[float, int]]:
    """(n, cell) -> (largest angle, members): a row for each cell, of which there are at most MAX_CELLS for each of at most 16 numbers of components, and one for each other number."""
    own = placed.where("n IS NOT NULL").groupBy("n", "cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("members"))
    return {(r["n"], r["cell"]): (r["radius"], r["members"]) for r in own.toLocalIterator()}


def group_size(count: int, n: int) -> int:
    """Vectors of n components that a group holds at most, and visitors of it that meet them at a time: a share of all, so that a vector goes to no more groups where there are more of them, within what a worker holds."""
    return max(1, min(max(GROUP_ROWS, math.ceil(count / GROUPS)), GROUP_VALUES // n))


def grouped(known: dict[tuple[int, int], tuple[float, int]], count: int) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(n, cell) -> (group, its blocks, visitors of a part): cells one behind another, as many as a group holds; a cell that is larger is a group of several blocks."""
    out, held_n, group, size = {}, None, -1, 0
    for (n, cell), (_, members) in sorted(known.items()):
        most = group_size(count, n)
        if n != held_n or size + members > most:
            held_n, group, size = n, group + 1, 0
        size += members
        out[n, cell] = group, math.ceil(members / most), most
    return out


def visits(placed: DataFrame, of: dict[int, np.ndarray], reach: dict[int, np.ndarray], groups: dict[tuple[int, int], tuple[int, int, int]], threshold: float) -> DataFrame:
    """placed with the cells that each vector has to meet, by group: its own, and of those behind it (cell > its own) the ones that may hold a vector at or above threshold."""
    limit = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
    chord = 2 * math.sin(limit / 2) if limit < math.pi else 2.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = {n: np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2) for n, c in of.items()}
        places = {n: np.array([groups.get((n, c), (-1, 0, 0))[0] for c in range(len(centres))]) for n, centres in of.items()}
        for b in batches:
            if not b.num_rows:
                continue
            sizes, cells, raw = b.column("n").to_numpy(), b.column("cell").to_numpy(), b.column("unit")
            meet: list[list[dict]] = [[] for _ in cells]
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                if n not in of:
                    for r in rows:
                        meet[r] = [{"group": groups[int(n), int(cells[r])][0], "cells": [int(cells[r])]}]
                    continue
                near = np.frombuffer(b"".join(raw.take(pa.array(rows)).to_pylist())).reshape(len(rows), n) @ of[n].T
                own = cells[rows]
                behind = near[np.arange(len(rows)), own][:, None] - near
                possible = (_angle(near) <= limit + reach[n][None, :] + SLACK) & (behind <= (chord + SLACK) * np.maximum(apart[n][own], 1e-12))
                possible &= (np.arange(near.shape[1])[None, :] > own[:, None]) & (places[n] >= 0)[None, :]
                possible[np.arange(len(rows)), own] = True
                for r, some in zip(rows, possible, strict=True):
                    found = np.flatnonzero(some)
                    where = places[n][found]
                    cuts = np.flatnonzero(where[1:] != where[:-1]) + 1  # groups are in the order of cells
                    meet[r] = [{"group": int(groups[int(n), int(part[0])][0]), "cells": part.tolist()} for part in np.split(found, cuts)]
            kind = pa.list_(pa.struct([("group", pa.int32()), ("cells", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(meet, kind)], [*b.schema.names, "meets"])

    return placed.select("id", "n", "cell", "unit").mapInArrow(run, "id long, n int, cell int, unit binary, meets array<struct<group: int, cells: array<int>>>")


def similar_pairs(vectors: DataFrame, threshold: float, id_column: str = "vec_id", embedding: str = "embedding", cells: int | None = None) -> DataFrame:
    """a < b and similarity (cosine, rounded to 6 places) of all pairs at or above threshold, by cells (see above for what takes no part).

    A vector is sent to the groups of cells that may hold a partner and meets there those cells alone; groups and their visitors meet in blocks of bounded size, so that a cell with a
    third of all rows is many tasks' work. Where vectors lie in all directions alike and the threshold is low, no cell can be ruled out, and every
    two blocks meet once. Of a group of copies every pair is a row: see similar_classes() for groups of many.
    """
    left, right = meetings(vectors, threshold, id_column, embedding, cells)
    least = threshold if threshold > -1 else -math.inf  # opposite vectors, whose product rounding may carry beyond -1

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        found = [pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})]
        if one.num_rows and two.num_rows:
            ids, home = [x.column("id").to_numpy() for x in (one, two)], one.column("home").to_numpy()
            sides = [np.frombuffer(b"".join(x.column("unit").to_pylist())).reshape(x.num_rows, -1) for x in (one, two)]
            lists = one.column("cells").combine_chunks()
            asked = lists.flatten().to_numpy()
            asking = np.repeat(np.arange(one.num_rows), lists.value_lengths().to_numpy())
            order = np.argsort(asked, kind="stable")
            asked, asking = asked[order], asking[order]
            cell = two.column("cell").to_numpy()
            for here in np.unique(cell):
                members = np.flatnonzero(cell == here)
                visitors = asking[np.searchsorted(asked, here) : np.searchsorted(asked, here, side="right")]
                unit, names = sides[1][members].T, ids[1][members]
                for k in range(0, len(visitors), 512):
                    some = visitors[k : k + 512]
                    scores = sides[0][some] @ unit
                    p, q = np.nonzero(scores >= least)
                    a, b = ids[0][some][p], names[q]
                    keep = np.where(home[some][p] == here, a < b, a != b)
                    found.append(pa.table({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": np.round(scores[p, q][keep], 6)}))
        return pa.concat_tables(found)

    keys = ["group", "block", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "a long, b long, similarity double")


def meetings(vectors: DataFrame, threshold: float, id_column: str = "vec_id", embedding: str = "embedding", cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(visitors, members) with group, block, part: who meets whom. Visitors have home, the cell that they are members of, and cells, those of the group that they meet."""
    rows = vectors.where(usable(F.col(embedding))).select(F.col(id_column).alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    count = rows.count()
    of = pivots(rows, max(1, min(MAX_CELLS, cells or math.ceil(count / MEMBERS))))
    placed = held(in_cells(rows, of))
    known = radii(placed)
    reach = {n: np.array([known.get((n, c), (-math.pi, 0))[0] for c in range(len(centres))]) for n, centres in of.items()}
    groups = grouped(known, count)
    met = held(visits(placed, of, reach, groups, threshold))
    visitors = met.select("id", F.col("cell").alias("home"), "unit", F.explode("meets").alias("_m")).select("id", "home", "unit", F.col("_m.group").alias("group"), F.col("_m.cells").alias("cells"))
    sizes = {group: (blocks, most) for group, blocks, most in groups.values()}
    spark = vectors.sparkSession
    limits = spark.createDataFrame([(g, b, m) for g, (b, m) in sizes.items()], "group int, blocks int, most int")
    homes = spark.createDataFrame([(n, c, g) for (n, c), (g, _, _) in groups.items()], "n int, cell int, group int")
    parts = visitors.groupBy("group").agg(F.count(F.lit(1)).alias("_c"))
    shape = held(parts.join(limits, "group").select("group", "blocks", F.ceil(F.col("_c") / F.col("most")).cast("int").alias("parts")))
    turn = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    place = lambda many: F.pmod(F.xxhash64("id"), F.col(many)).cast("int")
    left = visitors.join(shape, "group").withColumn("part", place("parts")).withColumn("block", turn("blocks")).select("group", "block", "part", "id", "home", "cells", "unit")
    right = met.select("id", "n", "cell", "unit").join(homes, ["n", "cell"]).join(shape, "group").withColumn("block", place("blocks")).withColumn("part", turn("parts")).select("group", "block", "part", "id", "cell", "unit")
    return left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own: both come from one table


def comparisons(vectors: DataFrame, threshold: float, id_column: str = "vec_id", embedding: str = "embedding", cells: int | None = None) -> int:
    """How many scores similar_pairs() computes; without any cell ruled out that is about half the square of the number of vectors, and a cell's own square."""
    left, right = meetings(vectors, threshold, id_column, embedding, cells)
    keys = ["group", "block", "part", "cell"]
    sizes = [x.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)) for x, name in ((left.withColumn("cell", F.explode("cells")), "l"), (right, "r"))]
    return sizes[0].join(sizes[1], keys).agg(F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("n")).first()["n"]


def similar_classes(vectors: DataFrame, threshold: float, id_column: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(membership: id, class_id, copies; pairs: a, b, similarity between classes). A class is all rows with the same components, named by its smallest id.

    Copies aren't spelled out in pairs: two rows are similar if their classes are a pair or the same one.
    """
    rows = vectors.where(usable(F.col(embedding)) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(embedding).alias("v"))
    classes = held(rows.groupBy("v").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies")))
    several = classes.where("copies > 1").select(F.col("v"), "class_id", "copies")
    members = rows.join(several, "v", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"))
    return members, similar_pairs(classes, threshold, "class_id", "v")


def link_counts(vectors: DataFrame, threshold: float, id_column: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, class_id, links: with how many other rows each usable vector's cosine is at or above threshold."""
    members, pairs = similar_classes(vectors, threshold, id_column, embedding)
    pairs, members = held(pairs), held(members)
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"))
    both = pairs.select("a", "b").union(pairs.select("b", "a")).join(sizes.withColumnRenamed("class_id", "b"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("copies").alias("others"))
    own = members.join(both, "class_id", "left")
    return own.select("id", "class_id", (F.coalesce("others", F.lit(0)) + F.when(F.lit(threshold <= 1), F.col("copies") - 1).otherwise(0)).cast("bigint").alias("links"))


# --- the stored index ---


def write_index(vectors: DataFrame, path: str, id_column: str = "vec_id", embedding: str = "embedding", cells: int | None = None, rows_a_file: int = 250_000) -> None:
    """Stores an inverted file: path/cells, a folder for each cell with its vectors, and path/pivots, a row for each cell with pivot, radius and members.

    It holds the usable vectors of the most frequent number of components; all of them, whatever the sample for the pivots. cells: about the root of
    the number of vectors, if not given. A cell with many vectors is many files.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(embedding))).select(F.col(id_column).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if most is None:
        raise ValueError("no usable vector")
    of = {n: c for n, c in pivots(rows.where(F.size("v") == most["n"]), max(1, min(MAX_CELLS, cells or math.isqrt(most["count"])))).items() if n == most["n"]}
    placed = held(in_cells(rows.where(F.size("v") == most["n"]), of))
    n = most["n"]
    spread = placed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    counts = radii(placed)
    deal = max(1, math.ceil(most["count"] / rows_a_file))
    spread.repartition(max(deal, min(len(counts), spark.sparkContext.defaultParallelism)), "cell", *(["salt"] if deal > len(counts) else [])).sortWithinPartitions("cell", "id").select("id", "angle", "unit", "cell").write.option("maxRecordsPerFile", rows_a_file).partitionBy("cell").parquet(f"{path}/cells")
    rows = [(c, [float(x) for x in of[n][c]], float(counts[n, c][0]), counts[n, c][1]) for c in range(len(of[n])) if (n, c) in counts]
    spark.createDataFrame(rows, "cell int, pivot array<double>, radius double, members long").coalesce(1).write.parquet(f"{path}/pivots")


class Index:
    """A stored index as a reader sees it: its pivots are in memory (MAX_CELLS at most), its vectors are not."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows = spark.read.schema("id long, angle double, unit binary, cell int").parquet(f"{path}/cells")
        held_pivots = spark.read.parquet(f"{path}/pivots").orderBy("cell").toArrow().combine_chunks()
        self.cells, self.radius, self.members = (held_pivots.column(c).to_numpy() for c in ("cell", "radius", "members"))
        self.pivots = held_pivots.column("pivot").combine_chunks().flatten().to_numpy().reshape(len(self.cells), -1)

    def _probe(self, probe: list[float]) -> np.ndarray:
        p = np.array([math.nan if x is None else x for x in probe], dtype=np.float64)
        if p.shape != self.pivots.shape[1:] or not np.isfinite(p).all() or not p.any():
            raise ValueError(f"a probe has {self.pivots.shape[1]} finite components that are not all 0")
        p = p / np.abs(p).max()
        return p / np.linalg.norm(p)

    def order(self, probe: np.ndarray) -> np.ndarray:
        """Places of the cells, the nearest pivot first."""
        return np.argsort(-(self.pivots @ probe), kind="stable")

    def scores(self, probe: np.ndarray, places: np.ndarray) -> DataFrame:
        """id and score (cosine, rounded to 6 places) of the vectors in those cells: other folders are not read."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v = np.frombuffer(b"".join(b.column(1).to_pylist())).reshape(b.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(v @ probe, 6))], ["id", "score"])

        own = self.rows.where(F.col("cell").isin([int(c) for c in self.cells[places]]))
        return own.select("id", "unit").mapInArrow(run, "id long, score double")

    def probed(self, probe: list[float], k: int, cells: int) -> DataFrame:
        """id, score, rank of the k best in the nearest cells: fast, and as good as calibrated() says."""
        p = self._probe(probe)
        return best(self.scores(p, self.order(p)[:cells]), k)

    def nearest(self, probe: list[float], k: int, first: int = 4) -> DataFrame:
        """id, score, rank of the k best of all vectors. The first cells give a k-th score; then every cell is read whose radius doesn't prove that it holds none as good."""
        p = self._probe(probe)
        order = self.order(p)
        some = best(self.scores(p, order[:first]), k).collect()
        least = min((r["score"] for r in some), default=-1.0) if len(some) == k else -2.0
        bound = np.cos(np.maximum(0.0, _angle(self.pivots @ p) - self.radius - SLACK))
        return best(self.scores(p, np.flatnonzero(bound >= least - 2e-6)), k)

    def search(self, queries: DataFrame, k: int, cells: int | None = None, id_column: str = "vec_id", embedding: str = "embedding", others: bool = True) -> DataFrame:
        """query_id, id, score, rank for every query, from its nearest cells (from all, if cells is None). others: a query is no answer to itself.

        Queries are usable vectors of the index's number of components; others give no row. Queries and cells meet in blocks; each keeps k of a query.
        """
        many, pivot, names = len(self.cells) if cells is None else min(cells, len(self.cells)), self.pivots, self.cells

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for rows, units in _units(b.column(1)) if b.num_rows else ():
                    near = np.argsort(-(units @ pivot.T), axis=1, kind="stable")[:, :many]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([u.tobytes() for u in units], pa.binary()), pa.array(names[near].tolist(), pa.list_(pa.int32()))], ["query_id", "probe", "cells"])

        def meet(one: pa.Table, two: pa.Table) -> pa.Table:
            out = [pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
            if one.num_rows and two.num_rows:
                ids, asking = two.column("id").to_numpy(), one.column("query_id").to_numpy()
                order = np.argsort(ids, kind="stable")
                sides = [np.frombuffer(b"".join(x.column(c).to_pylist())).reshape(x.num_rows, -1) for x, c in ((one, "probe"), (two, "unit"))]
                ids, members = ids[order], sides[1][order]
                for i in range(0, len(asking), 512):
                    scores = np.round(sides[0][i : i + 512] @ members.T, 6)
                    if others:
                        scores[asking[i : i + 512][:, None] == ids[None, :]] = -np.inf
                    top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    value = np.take_along_axis(scores, top, axis=1)
                    q, j = np.nonzero(value > -np.inf)
                    out.append(pa.table({"query_id": asking[i : i + 512][q], "id": ids[top[q, j]], "score": value[q, j]}))
            return pa.concat_tables(out)

        own = queries.where(usable(F.col(embedding)) & (F.size(embedding) == pivot.shape[1])).select(F.col(id_column).cast("long").alias("query_id"), F.col(embedding).cast("array<double>").alias("v"))
        asked = held(own.mapInArrow(choose, "query_id long, probe binary, cells array<int>"))
        blocks = {int(c): math.ceil(m / MEMBERS) for c, m in zip(names, self.members, strict=True)}
        block_of = F.create_map(*(F.lit(x) for pair in blocks.items() for x in pair))
        parts = max(1, math.ceil(asked.count() / VISITORS))
        left = asked.select("query_id", "probe", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), F.explode("cells").alias("cell"))
        left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.element_at(block_of, F.col("cell")) - 1)))
        right = self.rows.select("id", "unit", "cell", F.pmod(F.xxhash64("id"), F.element_at(block_of, F.col("cell"))).cast("int").alias("block"))
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        keys = ["cell", "block", "part"]
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).alias("rank")
        return met.select("query_id", "id", "score", rank).where(F.col("rank") <= k)

    def calibrated(self, k: int = 10, recall: float = 0.95, sample: int = 200) -> int:
        """The least number of cells with which at least that share of the true k best is found, over a sample of the index's own vectors."""
        own = self.rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample).select("id", "unit", F.col("cell").alias("home"))
        asked = own.toArrow().combine_chunks()
        units = np.frombuffer(b"".join(asked.column("unit").to_pylist())).reshape(asked.num_rows, -1)
        turn = np.empty((len(units), len(self.cells)), dtype=np.int64)
        np.put_along_axis(turn, np.argsort(-(units @ self.pivots.T), axis=1, kind="stable"), np.arange(len(self.cells))[None, :], axis=1)
        queries = self.rows.sparkSession.createDataFrame(pa.table({"vec_id": asked.column("id"), "embedding": pa.array(list(units), pa.list_(pa.float64()))}))
        found = self.search(queries, k).join(self.rows.select("id", "cell"), "id").select("query_id", "cell").collect()
        row, column = {i: r for r, i in enumerate(asked.column("id").to_pylist())}, {int(c): j for j, c in enumerate(self.cells)}
        turns = np.sort([turn[row[r["query_id"]], column[r["cell"]]] for r in found])
        return int(turns[max(0, math.ceil(recall * len(turns)) - 1)]) + 1 if len(turns) else len(self.cells)


def best(scores: DataFrame, k: int) -> DataFrame:
    """id, score, rank of the k best; ties go to the smaller id."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), F.asc("id")))
    return scores.orderBy(F.desc("score"), F.asc("id")).limit(k).withColumn("rank", rank)
