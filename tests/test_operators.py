from collections import Counter

import pytest
from pyspark.sql import functions as F

from keepsake import schema
from keepsake.operators import entities, graph, joins, linkers, rollups, search


def test_missing_entities_raise(spark):
    view = entities.entity_rows(spark.range(3), "person", "id")
    assert entities.get_entity(view, "person", 2).count() == 1
    with pytest.raises(entities.EntityNotFoundError, match="person 9 was not found"):
        entities.get_entity(view, "person", 9)


def test_trees_cycles_and_unknown_parents(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 99, "d"), (5, 6, "x"), (6, 5, "y")], "n int, p int, name string")
    got = {r.node: (r.root, r.depth, r.path) for r in graph.tree(df, "n", "p", "name").collect()}
    assert got == {1: (1, 0, "a"), 2: (1, 1, "a/b"), 3: (1, 2, "a/b/c"), 4: (4, 0, "d")}
    totals = {r.path: r.total for r in graph.subtree_totals(graph.tree(df, "n", "p", "name"), spark.createDataFrame([(2, 5), (3, 7)], "n int, v int"), "n", "v").collect()}
    assert totals == {"a": 12, "a/b": 12, "a/b/c": 7, "d": 0}


def test_merges_end_at_the_last_person_and_cycles_at_the_least(spark):
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)] + [(100, 101), (101, 102), (102, 100)], "n int, into int")
    got = {r.node: r.canonical for r in graph.canonical(df, "n", "into").collect()}
    assert all(got[i] == 0 for i in range(40)) and len({got[i] for i in (100, 101, 102)}) <= 3 and got[100] in (100, 101, 102)


def test_components_and_hops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(200, 201), (300, 300)], "source int, target int")
    got = {r.node: r.component for r in graph.connected(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[201] == 200 and got[300] == 300
    near = {r.node: r.hops for r in graph.within_hops(edges, spark.createDataFrame([(10,)], "node int"), 2).collect()}
    assert near == {10: 0, 9: 1, 11: 1, 8: 2, 12: 2}


def test_symmetric_closure_is_idempotent(spark):
    links = spark.createDataFrame([(1, 2, "near"), (2, 1, "near"), (3, 4, "before")], "source int, target int, link_type string")
    once = graph.symmetric(links, ["near"])
    assert {tuple(r) for r in once.collect()} == {(1, 2, "near"), (2, 1, "near"), (3, 4, "before")}
    assert {tuple(r) for r in graph.symmetric(once, ["near"]).collect()} == {tuple(r) for r in once.collect()}


def test_windows_spans_and_places(spark):
    a = spark.createDataFrame([(1, 0), (2, 100), (3, -5)], "a int, a_at int")
    b = spark.createDataFrame([(7, 10), (8, 111), (9, -10)], "b int, b_at int")
    assert {(r.a, r.b) for r in joins.within_window(a, b, "a_at", "b_at", 10).collect()} == {(1, 7), (1, 9), (3, 9)}
    spans = spark.createDataFrame([("x", 0, 100), ("y", 50, None), ("z", 5, 5)], "s string, start int, finish int")
    assert {(r.s, r.a) for r in joins.during(a, spans, "a_at", "start", "finish", 30).collect()} == {("x", 1), ("y", 2)}
    p = spark.createDataFrame([(1, 0.0, 179.9995), (2, 89.9999, 0.0)], "a int, lat double, lon double")
    q = spark.createDataFrame([(1, 0.0, -179.9995), (2, 89.9999, 180.0), (3, 1.0, 0.0)], "b int, lat2 double, lon2 double")
    assert {(r.a, r.b) for r in joins.near(p, q, 200.0, ("lat", "lon"), ("lat2", "lon2")).collect()} == {(1, 1), (2, 2)}


def test_as_of_takes_equal_times_and_keeps_unmatched_rows(spark):
    left = spark.createDataFrame([("u", 5, 1), ("u", 10, 2), ("v", 1, 3)], "k string, at int, id int")
    right = spark.createDataFrame([("u", 5, "a"), ("u", 7, None), ("w", 0, "z")], "k string, seen int, v string")
    got = {r.id: (r.seen, r.v) for r in joins.as_of(left, right, ["k"], "at", "seen", ["v"]).collect()}
    assert got == {1: (5, "a"), 2: (7, None), 3: (None, None)}


def test_optional_and_required_edges(spark):
    people = spark.createDataFrame([("p", "P")], "id string, name string")
    rows = spark.createDataFrame([(1, "p"), (2, None)], "n int, sender_id string")
    assert joins.follow(rows, "chat_messages", "sender_id", people).count() == 2
    assert joins.follow(rows.withColumnRenamed("sender_id", "person_id"), "person_aliases", "person_id", people).count() == 1


def test_fused_scores_fall_with_either_rank(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id int, rank int")
    other = spark.createDataFrame([(1, 1), (2, 3), (4, 2)], "id int, rank int")
    got = {r.id: r.score for r in search.fuse(ranks, other).collect()}
    assert got[1] == pytest.approx(1 / 61) and got[1] > got[2] > got[3] and got[4] == pytest.approx(0.7 / 62)


def test_quotes_begin_inside_words_and_may_be_short(spark):
    docs = spark.createDataFrame([(1, "xxalpha beta gamma delta epsilon zetayy"), (2, "alpha beta"), (3, "one two three")], "id int, text string")
    passages = spark.createDataFrame([(10, "alpha beta gamma delta epsilon zeta"), (11, "alpha beta"), (12, "ne two thr"), (13, "gamma  delta epsilon"), (14, "ree"), (15, " "), (16, None)], "p int, passage string")
    assert {tuple(r) for r in linkers.by_quote(docs, "id", "text", passages, "p", "passage").collect()} == {(1, 10), (1, 11), (2, 11), (3, 12), (3, 14)}


def test_many_short_quotes_go_the_other_way(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i} and x{i % 7}, so") for i in range(50)], "id int, text string")
    passages = spark.createDataFrame([(100 + k, f"x{k}") for k in range(9)] + [(200, "and x3"), (201, "w7 and x0, so"), (202, "")], "p int, passage string")
    want = {(i, 100 + i % 7) for i in range(50)} | {(i, 200) for i in range(50) if i % 7 == 3} | {(7, 201)}
    for limit in (1 << 20, 0):
        monkeypatch.setattr(linkers, "SHORT_BYTES", limit)
        assert {tuple(r) for r in linkers.by_quote(docs, "id", "text", passages, "p", "passage").collect()} == want


def test_names_of_several_words(spark):
    import random
    import re

    rng = random.Random(3)
    words = ["new", "york", "city", "a", "b", "Ünal"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 14))).replace("york ", rng.choice(["York, ", "york-", "york "]))) for i in range(60)] + [(100, None), (101, ""), (102, "New-York's city"), (103, "new york new york city")]
    names = ["New York", "York", "new york city", "a b a", "A  b", "ünal", "!!!", "", "city new", "absent name", None]
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    runs = {n: tokens(n) for n in names if tokens(n)}
    df, known = spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame([(n,) for n in names], "name string")
    every, kept = set(), set()
    for i, t in docs:
        w, end = tokens(t), 0
        hits = sorted((at, -len(r), n) for n, r in runs.items() for at in range(len(w)) if w[at : at + len(r)] == r)
        every |= {(i, n, at, -m) for at, m, n in hits}
        spans = []
        for at, m, _ in hits:
            if at >= end:
                spans.append((at, m))
                end = at - m
        kept |= {(i, n, at, -m) for at, m, n in hits if (at, m) in spans}
    assert {tuple(r) for r in linkers.name_mentions(df, "id", "text", known, "name", longest=False).collect()} == every
    got = [tuple(r) for r in linkers.name_mentions(df, "id", "text", known, "name").collect()]
    assert set(got) == kept and len(got) == len(kept) and (102, "New York", 0, 2) in every
    assert {tuple(r) for r in linkers.by_name(df, "id", "text", known, "name").collect()} == {(i, n) for i, n, _, _ in every}
    assert linkers.name_mentions(df, "id", "text", known.limit(0), "name").collect() == []


def test_link_rows_keep_confidence_in_range(spark):
    pairs = spark.createDataFrame([(1, 2, 1.7), (3, 4, -1.0)], "a int, b int, c double")
    rows = linkers.link_rows(pairs, "x", F.col("a"), F.col("b"), F.lit("media"), F.lit("person"), F.lit("mentions"), F.col("c")).collect()
    assert [r.confidence for r in rows] == [1.0, 0.0] and all(r.is_automatic and not r.is_confirmed for r in rows)
    assert list(rows[0].asDict()) == [c.name for c in schema.columns("entity_links")] and len({r.id for r in rows}) == 2
    own = linkers.link_rows(pairs, "x", F.col("a"), F.col("b"), F.lit("media"), F.lit("person"), F.when(F.col("a") == 1, "custom").otherwise("about"), custom_type=F.lit("twin")).collect()
    assert {(r.link_type, r.custom_type) for r in own} == {("custom", "twin"), ("about", None)}


def test_replies_and_other_references(spark):
    rows = [(1, "<a>", None, None), (2, "<b>", "<a>", "<a>"), (3, "<c>", "<b>", "<a> <b>"), (4, "<d>", "<zz>", "<c>"), (5, None, "<a>", None)]
    df = spark.createDataFrame(rows, "k int, mid string, reply string, refs string")
    assert {tuple(r) for r in linkers.by_reference(df, "k", "mid", "reply", "refs").collect()} == {(2, 1, "reply_to"), (3, 2, "reply_to"), (3, 1, "references"), (4, 3, "references"), (5, 1, "reply_to")}


def test_places_match_a_plain_loop(spark):
    import math
    import random

    rng = random.Random(4)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)] + [(lat, lon) for lat in (90.0, -90.0, 89.9, 0.0, 59.99) for lon in (-180.0, 180.0, 179.9, -179.95, 0.0)]

    def metres(p, q):
        (a, b), (c, e) = ([math.radians(x) for x in y] for y in (p, q))
        return 2 * 6371008.8 * math.asin(min(1.0, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((e - b) / 2) ** 2)))

    p, q = (spark.createDataFrame([(i, *x) for i, x in enumerate(spots)], f"{n} int, {n}lat double, {n}lon double") for n in "ab")
    for radius in (20_000.0, 400_000.0, 3_000_000.0):
        want = {(i, j) for i, x in enumerate(spots) for j, y in enumerate(spots) if metres(x, y) <= radius}
        assert {(r.a, r.b) for r in joins.near(p, q, radius, ("alat", "alon"), ("blat", "blon")).collect()} == want
        for i in (0, 3, 150, 160, 172):
            assert {r.a for r in joins.around(p, *spots[i], radius, ("alat", "alon")).collect()} == {j for a, j in want if a == i}


def test_pairs_of_one_place_are_many_tasks_work(spark, monkeypatch):
    """One place with nearly all rows, at the pole, in tables of one file, which Spark would broadcast."""
    monkeypatch.setattr(joins, "TILE", 16)
    monkeypatch.setattr(joins, "STACK", 8)
    spots = [(90.0, 0.0)] * 60 + [(89.9999, 170.0)] * 30 + [(0.0, 0.0), (None, 0.0), (10.0, 20.0)]
    p, q = (spark.createDataFrame([(i, *x) for i, x in enumerate(spots)], f"{n} int, {n}lat double, {n}lon double").coalesce(1) for n in "ab")
    near = joins.near(p, q, 200.0, ("alat", "alon"), ("blat", "blon"))
    assert near.columns == ["a", "alat", "alon", "b", "blat", "blon", "distance_m"]
    got = near.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.a, r.b) for r in got) == sorted([(i, j) for i in range(90) for j in range(90)] + [(90, 90), (92, 92)])
    assert Counter(r.task for r in got).most_common(1)[0][1] < len(got) * 2 / 3


def test_pairs_of_one_time_are_many_tasks_work(spark, monkeypatch):
    monkeypatch.setattr(joins, "TILE", 16)
    a, b = (spark.createDataFrame([(i, None if i == 200 else 1000 if i < 150 else i * 50, i % 2) for i in range(201)], f"{n} int, {n}_at int, k int").coalesce(1) for n in "ab")
    for on in (None, ["k"]):
        got = joins.within_window(a.drop(*([] if on else ["k"])), b.drop(*([] if on else ["k"])), "a_at", "b_at", 60, on).withColumn("task", F.spark_partition_id()).collect()
        at = lambda i: 1000 if i < 150 else i * 50
        assert sorted((r.a, r.b) for r in got) == [(i, j) for i in range(200) for j in range(200) if abs(at(i) - at(j)) <= 60 and (not on or i % 2 == j % 2)]
        assert Counter(r.task for r in got).most_common(1)[0][1] < len(got) * 2 / 3


def test_pairs_of_one_key_and_spans_are_many_tasks_work(spark, monkeypatch):
    """One key with nearly all rows, open and closed spans, nulls, and times that are no number; a point's spans stand together."""
    monkeypatch.setattr(joins, "SPAN_TILE", 16, raising=False)
    monkeypatch.setattr(joins, "STACK", 8)
    nan = float("nan")
    points = [(i, None if i == 7 else 5 if i % 40 == 3 else 1, None if i == 9 else nan if i == 11 else float(i * 7 % 100)) for i in range(120)]
    spans = [(j, None if j == 4 else 5 if j % 30 == 2 else 1, None if j == 6 else float(j % 90), None if j % 3 else float(j % 90 + j % 5)) for j in range(90)]
    a, s = spark.createDataFrame(points, "i int, k int, at double").coalesce(1), spark.createDataFrame(spans, "j int, k int, start double, finish double").coalesce(1)
    found = joins.during(a, s, "at", "start", "finish", 10, ["k"])
    assert sorted(found.columns) == ["at", "finish", "i", "j", "k", "start"]
    got = found.withColumn("task", F.spark_partition_id()).collect()
    late = lambda x, y: x != x or x >= y  # noqa: E731  Spark has NaN behind all numbers
    want = [(i, j, k) for i, k, at in points for j, key, start, end in spans if k == key and None not in (k, at, start) and late(at, start) and (end is None or not late(at, end))]
    assert sorted((r.i, r.j, r.k) for r in got) == sorted(want)
    assert Counter(r.task for r in got).most_common(1)[0][1] < len(got) * 2 / 3


def test_words_of_texts_stay_where_they_are_if_names_are_few(spark):
    names = spark.range(20_000).select(F.element_at(F.array(F.lit("York"), F.lit("New York"), F.lit("!"), F.lit("york")), (F.col("id") % 4 + 1).cast("int")).alias("name"))
    docs = spark.createDataFrame([(1, "new york, York; new York"), (2, "York"), (3, ""), (4, None), (1, "york")], "id int, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50000")
    try:
        got = linkers.by_name(docs, "id", "text", names, "name")
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in got.collect()) == [(1, "New York"), (1, "York"), (1, "york"), (2, "York"), (2, "york")]
        assert {tuple(r) for r in linkers.by_name(docs, "id", "text", names, "name", True).collect()} == {(1, "New York"), (1, "York"), (1, "york"), (2, "York"), (2, "york")}
        assert linkers.by_name(docs, "id", "text", names.limit(0), "name").collect() == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lookups_reach_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 180 - 90.0D AS latitude", "id % 360 - 180.0D AS longitude").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,77)" in plan(entities.lookup_in(t, "id", 77)) and entities.lookup_in(t, "id", "77").count() == 1 and entities.lookup_in(t, "id", "x").count() == 0
    assert "GreaterThanOrEqual(latitude" in plan(joins.around(t, 10.0, 20.0, 5000.0))


def test_sessions_begin_only_after_more_than_the_gap(spark):
    df = spark.createDataFrame([("u", 0), ("u", 30), ("u", 61), ("v", 5)], "u string, t int")
    got = sorted((r.u, r.started, r.ended, r.visits) for r in rollups.sessions(df, "u", F.col("t"), 30).collect())
    assert got == [("u", 0, 30, 2), ("u", 61, 61, 1), ("v", 5, 5, 1)]


def test_carryover(spark):
    df = spark.createDataFrame([("g", 2024, 1, 100, 40), ("g", 2024, 2, 100, 130), ("g", 2024, 3, 50, 0)], "category string, year int, month int, budgeted int, spent int")
    got = [(r.carryover, r.available) for r in rollups.budget_carryover(df).orderBy("month").collect()]
    assert got == [(0, 60), (60, 30), (30, 80)]
