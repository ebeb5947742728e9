"""Queries and operators do the whole job: nothing is left out by filters on ids, caps on depth or cuts of texts.
"""

import glob
import os

import pytest

from keepsake import schema
from keepsake.operators import graph, hashes, joins, search
from keepsake.plans import api, catalogue, queries_search

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def rows_of(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def rows_of_sql(sql):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found = con.sql(sql)
    at = [found.columns.index(c) for c in sorted(found.columns)]
    return sorted(tuple(r[k] for k in at) for r in found.fetchall())


@tables
def test_during_span_takes_all_orders_and_line_items(spark):
    want = rows_of_sql("""
    WITH s AS (SELECT o_orderkey AS span, o_custkey % 50 AS person, epoch_us(o_orderdate) // 1000000 AS start, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE epoch_us(o_orderdate) // 1000000 + 86400 * (o_orderkey % 5 + 1) END AS finish FROM orders),
    p AS (SELECT l_orderkey, l_linenumber, l_suppkey % 50 AS person, epoch_us(l_shipdate) // 1000000 AS sec FROM lineitem)
    SELECT l_orderkey, l_linenumber, coalesce(span, -1) AS span FROM p LEFT JOIN s ON s.person = p.person AND sec >= start AND (finish IS NULL OR sec < finish)""")
    pairs = [r for r in want if r[2] >= 0]
    assert sorted((r.l_linenumber, r.l_orderkey, r.span) for r in catalogue.QUERIES["during_span"](spark, SF).collect()) == sorted(pairs)
    around = catalogue.QUERIES["spans_around"](spark, SF).collect()
    assert sorted((r.l_orderkey, r.l_linenumber) for r in around) == rows_of_sql("SELECT l_orderkey AS a, l_linenumber AS b FROM lineitem")
    assert sum(r.spans_around for r in around) == len(pairs) > 0
    inside = catalogue.QUERIES["points_inside"](spark, SF).collect()
    assert sorted(r.span for r in inside) == [r[0] for r in rows_of_sql("SELECT o_orderkey FROM orders")] and sum(r.points_inside for r in inside) == len(pairs)


@tables
def test_hamming_pairs_takes_all_parts(spark):
    want = rows_of_sql("SELECT a.p_partkey AS a, b.p_partkey AS b, bit_count(xor(a.p_partkey * 2654435761 % 1048576, b.p_partkey * 2654435761 % 1048576))::INT AS distance FROM part a JOIN part b ON a.p_partkey < b.p_partkey WHERE bit_count(xor(a.p_partkey * 2654435761 % 1048576, b.p_partkey * 2654435761 % 1048576)) <= 6")
    assert rows_of(catalogue.QUERIES["hamming_pairs"](spark, SF)) == want and want


def test_hamming_pairs_match_a_plain_loop(spark):
    import random

    rng = random.Random(5)
    values = [rng.randrange(1 << 9) for _ in range(120)] + [7, 7, 0, 511]
    df = spark.createDataFrame(list(enumerate(values)), "id long, h long")
    for most in (0, 1, 3, 4):
        want = sorted((a, b, (x ^ y).bit_count()) for a, x in enumerate(values) for b, y in enumerate(values) if a < b and (x ^ y).bit_count() <= most)
        assert rows_of(hashes.hamming_pairs(df, 9, most)) == want and want


def test_pairs_of_hashes_with_many_near_ones_are_spelled_out_where_they_are_written(spark, monkeypatch):
    """No pair is gathered, written or joined again; copies, tiles, turns of a frequent hash, null ids and ids of text."""
    import random

    rng = random.Random(9)
    values = [rng.randrange(1 << 9) for _ in range(150)] + [3] * 40 + [3 + (1 << 9)]
    rows = [*((f"{k:04d}", h) for k, h in enumerate(values)), (None, 3), ("x", None)]
    df = spark.createDataFrame(rows, "id string, h long")
    near = lambda most: sorted((a, b, d) for k, (a, x) in enumerate(rows[:-2]) for b, y in rows[k + 1 : -2] if (d := ((x ^ y) & 511).bit_count()) <= most)
    for most, least, asking in ((2, 1 << 22, hashes.ASKING), (3, 1, hashes.ASKING), (2, 1, (4, 16))):
        monkeypatch.setattr(hashes, "LEAST", least)
        monkeypatch.setattr(hashes, "ASKING", asking)
        pairs = hashes.hamming_pairs(df, 9, most)
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "FlatMapGroupsInArrow" in plan
        assert rows_of(pairs) == near(most)
    assert hashes.hamming_pairs(df.limit(0), 9, 3).collect() == []
    for most in (2, 9):
        assert rows_of(hashes.hamming_pairs(spark.createDataFrame([(5, 1), (4, 1), (6, 0)], "id long, h long"), 1, most)) == [(4, 5, 0), (4, 6, 1), (5, 6, 1)]


def test_hashes_of_64_bits_match_a_plain_loop(spark):
    import random

    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(12)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 12))) for b in base for _ in range(12)]
    values = [x - (1 << 64) if x >> 63 else x for x in [*base, *near, 0, -1 & (1 << 64) - 1, *[base[0]] * 200]]
    rows = [*enumerate(values), (None, 5), (9999, None)]
    df = spark.createDataFrame([(i, h, "x") for i, h in rows], "id long, h long, class_id string")
    apart = lambda x, y: ((x ^ y) & (1 << 64) - 1).bit_count()
    for most in (0, 3, 10):
        got = {r.id: (r.class_id, r.links) for r in hashes.link_counts(df, 64, most).collect()}
        assert got == {i: (values.index(h), sum(apart(h, x) <= most for x in values) - 1) for i, h in enumerate(values)}
    for parts in (hashes.segments(64, 10, 10**3), hashes.segments(64, 10, 10**9), [(0, 32, 5), (32, 32, 4)]):
        assert sum(r + 1 for _, _, r in parts) == 11 and sum(n for _, n, _ in parts) <= 64
    assert len(hashes.segments(64, 10, 10**9)) < len(hashes.segments(64, 10, 10**3))
    assert hashes.link_counts(df.limit(0), 64, 10).collect() == []


def test_values_are_spelled_out_inside_blocks(spark, monkeypatch):
    """What moves has a few rows for each hash, not one for each value within a segment's radius; blocks of any size find the same."""
    import random

    rng = random.Random(8)
    values = [rng.getrandbits(24) for _ in range(600)]
    values += [v ^ (1 << rng.randrange(24)) ^ (1 << rng.randrange(24)) for v in values]
    df = spark.createDataFrame([(f"{i:04d}", h) for i, h in enumerate(values)], "id string, h long")
    want = {i: sum((h ^ x).bit_count() <= 5 for x in values) - 1 for i, h in enumerate(values)}
    for block, parts in ((1 << 20, None), (50, None), (300, [(0, 24, 5)]), (50, [(0, 12, 2), (12, 12, 2)])):
        monkeypatch.setattr(hashes, "BLOCK", block)
        monkeypatch.setattr(hashes, "TABLE_BITS", 12)
        members, pairs = hashes.near_classes(df, 24, 5, parts=parts)
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
        assert "CoGroup" in plan and "Join" not in plan
        of = {r.id: r.class_id for r in members.collect()}
        got = {(r.a, r.b) for r in pairs.collect()}
        links = {i: sum((min(of[f"{i:04d}"], of[f"{j:04d}"]), max(of[f"{i:04d}"], of[f"{j:04d}"])) in got or of[f"{i:04d}"] == of[f"{j:04d}"] for j in range(len(values)) if j != i) for i in range(0, len(values), 40)}
        assert links == {i: want[i] for i in links}


def test_hashes_of_pictures(spark):
    """Perceptual hashes of pictures and of the same ones a little brighter and with noise are links; others are not."""
    import numpy as np

    from keepsake.functions import models

    rng = np.random.default_rng(3)
    smooth = lambda: np.kron(rng.normal(size=(4, 4)), np.ones((16, 16))) * 40 + 128
    pictures = [smooth() for _ in range(8)]
    every = pictures + [p * 1.05 + rng.normal(size=p.shape) for p in pictures]
    df = spark.createDataFrame([(i, bytearray(p.astype("float32").tobytes())) for i, p in enumerate(every)], "id long, content binary")
    hashed = df.select("id", models.perceptual_hash(df["content"], lambda raw: np.frombuffer(raw, dtype="float32").reshape(64, 64)).alias("h"))
    got = {r.id: r.links for r in hashes.link_counts(hashed, 64, 10).collect()}
    assert got == dict.fromkeys(range(16), 1)


def test_trees_of_any_depth_keep_all_nodes(spark):
    n = 300
    rows = [(i, i - 1 if i else None, str(i)) for i in range(n)] + [(1000 + i, i, "leaf") for i in range(n)] + [(5000, 5001, "x"), (5001, 5002, "y"), (5002, 5000, "z"), (5003, 5002, "tail")]
    df = spark.createDataFrame(rows, "n int, p int, name string")
    path = lambda i: "/".join(map(str, range(i + 1)))
    want = [(i, 0, i, path(i)) for i in range(n)] + [(1000 + i, 0, i + 1, path(i) + "/leaf") for i in range(n)]
    assert sorted((r.node, r.root, r.depth, r.path) for r in graph.tree(df, "n", "p", "name").collect()) == want
    assert sorted((r.node, r.root, r.depth) for r in graph.tree(df, "n", "p").collect()) == [x[:3] for x in want]


def test_merge_chains_of_any_length_end_at_the_last_person(spark):
    n = 300
    ring = [(1000 + i, 1000 + (i + 1) % 6) for i in range(6)] + [(2000, 2001), (2001, 2000)]
    rows = [(i, i - 1 if i else None) for i in range(n)] + ring + [(3000, 1003)] + [(3001 + i, 3000 + i) for i in range(150)] + [(9, 8000)]
    rows = [r for r in rows if r != (9, 8)]
    df = spark.createDataFrame(rows, "n int, into int")
    want = {i: 0 if i < 9 else 8000 for i in range(n)} | dict.fromkeys(range(1000, 1006), 1000) | {2000: 2000, 2001: 2000} | dict.fromkeys(range(3000, 3151), 1000)
    got = graph.canonical(df, "n", "into").collect()
    assert len(got) == len(want) and {r.node: r.canonical for r in got} == want


@tables
@pytest.mark.parametrize("few", [0, search.FEW])
def test_hybrid_rrf_fuses_whole_rankings(spark, monkeypatch, few):
    import numpy as np

    monkeypatch.setattr(search, "FEW", few)

    docs, vectors = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "embeddings"))
    words = sorted((-r.score, r.id) for r in search.word_scores(docs, "doc_id", "text", queries_search.WORDS).collect())
    near = sorted((-r.score, r.id) for r in search.vector_scores(vectors, "vec_id", "embedding", queries_search.PROBE).collect())
    w, v = ({i: k for k, (_, i) in enumerate(x, 1)} for x in (words, near))
    assert max(len(w), len(v)) > 100
    got = catalogue.QUERIES["hybrid_rrf"](spark, SF).collect()
    assert len(got) == len(w.keys() | v.keys()) and all((r.word_rank, r.vector_rank) == (w.get(r.id), v.get(r.id)) for r in got)
    assert np.allclose([r.score for r in got], [(0.3 / (60 + w[r.id]) if r.id in w else 0) + (0.7 / (60 + v[r.id]) if r.id in v else 0) for r in got], atol=1e-9)


def test_search_knowledge_counts_ranks_beyond_a_hundred(spark):
    # id 0 is 12th by vectors and 101st by words; id 1 is first by vectors and has no word
    near = [1, *range(200, 210), 0]
    rows = [(i, "no" if i else "word", [1.0, 0.01 * k]) for k, i in enumerate(near)] + [(1000 + i, "word " * 2, None) for i in range(100)]
    corpus = spark.createDataFrame(rows, "id int, content string, embedding array<double>")
    got = {r.id: r for r in api.search_knowledge(corpus, ["word"], [1.0, 0.0], 10).collect()}
    assert (got[0].word_rank, got[0].vector_rank) == (101, 12) and got[0].score > got[1].score


@tables
def test_conversation_returns_whole_texts(spark):
    want = rows_of_sql("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 5")
    assert rows_of(catalogue.QUERIES["conversation"](spark, SF)) == want and max(len(r[2]) for r in want) > 40


def test_many_edges_at_once_are_those_of_each_alone(spark):
    """Null and unknown references, repeated targets and edges without a row; one join, however many edges."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 7), (2, 7), (3, None), (4, 9), (5, 8), (6, 7)], "k int, r int")
    targets = spark.createDataFrame([(7,), (8,), (8,), (10,), (None,)], "id int")
    edges = [(f"{e.table}.{e.column}", F.when(F.col("k") > n % 7, F.col("r")), F.col("id") + n % 2) for n, e in enumerate(schema.EDGES)]
    got = joins.edge_totals(rows, edges, targets)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2
    found = {r.edge: (r.rows, r.matched, r.total) for r in got.collect()}
    for (name, ref, own), e in zip(edges, schema.EDGES, strict=True):
        alone = joins.follow(rows.select("k", ref.alias(e.column)), e.table, e.column, targets.select(own.alias("id")))
        assert found[name] == tuple(alone.agg(F.count(F.lit(1)), F.count("to_id"), F.coalesce(F.sum("to_id"), F.lit(0))).first())
