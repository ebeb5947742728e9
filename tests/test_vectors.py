"""Cells of vectors: the threshold join and the stored index against plain loops."""

import math

import numpy as np
import pytest

from keepsake.operators import vectors

ODD = [(9001, None), (9002, []), (9003, [0.0] * 8), (9004, [1.0, None] + [0.0] * 6), (9005, [math.nan] + [1.0] * 7), (9006, [math.inf] + [1.0] * 7)]
SCHEMA = "vec_id long, embedding array<double>, cell int, unit string"


def clustered(seed, groups, each, noise, size=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    return np.concatenate([c + noise * rng.normal(size=(each, size)) for c in centres])


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x") for i, v in rows], SCHEMA)


def plain_pairs(rows, threshold):
    units = [(i, np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float))) for i, v in rows if v is not None and len(v) and None not in list(v) and np.isfinite(np.array(v, dtype=float)).all() and np.any(v)]
    return {(min(i, j), max(i, j)) for k, (i, u) in enumerate(units) for j, w in units[k + 1 :] if len(u) == len(w) and u @ w >= threshold}


@pytest.mark.parametrize(("threshold", "cells"), [(0.95, 12), (0.7, 7), (0.2, 5), (-1.0, 3), (0.999, None)])
def test_pairs_are_those_of_a_plain_loop(spark, threshold, cells):
    rows = list(enumerate(clustered(1, 8, 12, 0.15)))
    rows += [(200 + k, v) for k, v in enumerate(np.random.default_rng(2).normal(size=(20, 3)))]  # of another length
    rows += [(300, rows[0][1]), (301, rows[0][1] * 5), (302, -rows[0][1]), (303, rows[0][1] * 1e-120), *ODD]
    df = table(spark, rows)
    got = vectors.similar_pairs(df, threshold, cells=cells).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) and {(r.a, r.b) for r in got} == plain_pairs(rows, threshold)


def test_far_cells_never_meet(spark):
    rows = list(enumerate(clustered(3, 20, 30, 0.02)))
    df = table(spark, rows)
    assert {(r.a, r.b) for r in vectors.similar_pairs(df, 0.97, cells=20).collect()} == plain_pairs(rows, 0.97)
    assert vectors.comparisons(df, 0.97, cells=20) < 0.2 * len(rows) ** 2 / 2
    assert vectors.comparisons(df, -1.0, cells=20) >= len(rows) ** 2 / 2


def test_copies_are_classes_and_count_as_links(spark):
    base = clustered(4, 3, 5, 0.1)
    rows = [(k, base[k % 15]) for k in range(15)] + [(100 + k, base[0]) for k in range(400)] + [(600, base[0] * 2), *ODD]
    got = {r.id: (r.class_id, r.links) for r in vectors.link_counts(table(spark, rows), 0.9).collect()}
    pairs = plain_pairs(rows, 0.9)
    want = {i: 0 for i, v in rows if i < 9000}
    for a, b in pairs:
        want[a] += 1
        want[b] += 1
    assert {i: n for i, (_, n) in got.items()} == want
    assert got[100][0] == 0 and got[600][0] == 600
    members, links = vectors.similar_classes(table(spark, rows), 0.9)
    assert members.count() == len(want) and links.count() < 200


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = list(enumerate(clustered(5, 25, 60, 0.2, 16)))
    place = f"file://{tmp_path_factory.mktemp('index')}/vectors"
    vectors.write_index(table(spark, [*rows, *ODD]), place)
    return rows, vectors.Index(spark, place)


def truth(rows, probe, k, leave=None):
    m = np.array([v for _, v in rows])
    score = np.round(m @ probe / np.linalg.norm(m, axis=1) / np.linalg.norm(probe), 6)
    return sorted(((-s, i) for (i, _), s in zip(rows, score, strict=True) if i != leave))[:k]


def test_nearest_is_exact_and_leaves_folders_unread(spark, index):
    rows, stored = index
    for probe in (rows[7][1], np.random.default_rng(6).normal(size=16)):
        got = stored.nearest(probe.tolist(), 9).collect()
        assert [(-r.score, r.id) for r in sorted(got, key=lambda r: r["rank"])] == [(pytest.approx(s, abs=2e-6), i) for s, i in truth(rows, probe, 9)]
    few = stored.probed(rows[7][1].tolist(), 9, 3)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan
    with pytest.raises(ValueError):
        stored.nearest([1.0], 3)


def test_calibrated_recall_on_other_queries(spark, index):
    rows, stored = index
    cells = stored.calibrated(10, 0.95)
    assert cells <= len(stored.cells) / 3
    queries = [(i, v) for i, v in rows if i % 20 == 0]
    found = stored.search(table(spark, [*queries, *ODD]), 10, cells).collect()
    hits = sum((r.query_id, r.id) in want for want in [{(i, j) for i, v in queries for _, j in truth(rows, v, 10, i)}] for r in found)
    assert hits >= 0.95 * 10 * len(queries)
    every = stored.search(table(spark, queries[:5]), 10).collect()
    for i, v in queries[:5]:
        assert [r.id for r in sorted((r for r in every if r.query_id == i), key=lambda r: r["rank"])] == [j for _, j in truth(rows, v, 10, i)]


def test_one_vector_and_none(spark, tmp_path):
    vectors.write_index(table(spark, [(1, [1.0, 2.0]), *ODD[:2]]), f"file://{tmp_path}/one")
    assert [(r.id, r.score) for r in vectors.Index(spark, f"file://{tmp_path}/one").nearest([2.0, 4.0], 5).collect()] == [(1, 1.0)]
    with pytest.raises(ValueError):
        vectors.write_index(table(spark, ODD), f"file://{tmp_path}/none")
    assert vectors.similar_pairs(table(spark, ODD), 0.5).collect() == [] and vectors.link_counts(table(spark, []), 0.5).collect() == []


def test_recall_of_the_registered_query(spark):
    import os

    from keepsake.plans import catalogue

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    own = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    found = {(r.query_id, r.id) for r in catalogue.QUERIES["knn_probed"](spark, d).collect()}
    want = {(i, j) for i, v in own if i % 20 == 0 for _, j in truth(own, v, 10, i)}
    assert len(found & want) >= 0.9 * len(want) > 0


def test_a_vector_goes_to_groups_of_cells_not_to_each(spark):
    """Where no cell is ruled out, what moves follows the vectors and the bounded number of groups, not the cells."""
    rows = list(enumerate(np.random.default_rng(9).normal(size=(600, 8))))
    left, right = vectors.meetings(table(spark, rows), -1.0, cells=20)
    assert left.count() == right.count() == 600
    assert vectors.comparisons(table(spark, rows), -1.0, cells=20) < 0.6 * 600**2
    many = {(64, c): (1.0, 2048) for c in range(1000)}
    assert max(g for g, _, _ in vectors.grouped(many, 2_048_000).values()) < 1000 / 30
    assert vectors.grouped({(8, 0): (1.0, 50_000), (8, 1): (1.0, 10)}, 50_010) == {(8, 0): (0, 7, 8192), (8, 1): (1, 1, 8192)}
