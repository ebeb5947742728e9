"""Prefix scans over ranges against plain loops, with a key that has half of all rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keepsake.operators import joins, rollups, scan


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Few rows too are dealt to several ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_with_a_hot_key(many=4000, seed=1):
    rng = random.Random(seed)
    return [(i, "hot" if i % 2 else rng.choice(["a", "b", None, f"k{i % 97}"]), rng.choice([None, *range(500)]), rng.choice([None, rng.randint(-9, 9)])) for i in range(many)]


def table(spark, rows):
    return spark.createDataFrame(rows, "id int, k string, t int, v int").repartition(5)


def by_key(rows):
    """Each key's rows in order of time (null first), then id."""
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        out[r[1]].append(r)
    return out


def order():
    return [F.asc("t"), F.asc("id")]


def test_sums_last_values_and_rows_before(spark):
    rows = rows_with_a_hot_key()
    got = scan.scanned(table(spark, rows), ["k"], order(), sums={"total": F.col("v"), "n": F.lit(1)}, lasts={"seen": F.col("v")}, before={"was": F.col("v"), "who": F.col("id")})
    want = {}
    for own in by_key(rows).values():
        total = seen = was = who = None
        for n, (i, _, _, v) in enumerate(own, 1):
            total = v if total is None else total + (v or 0)
            seen = v if v is not None else seen
            want[i] = (total, n, seen, was, who)
            was, who = v, i
    assert {r.id: (r.total, r.n, r.seen, r.was, r.who) for r in got.collect()} == want and got.columns == ["id", "k", "t", "v", "total", "n", "seen", "was", "who"]


def test_a_hot_key_is_many_ranges(spark):
    laid = scan.laid_out(table(spark, rows_with_a_hot_key()), ["k"], order())
    sizes = [r["count"] for r in laid.groupBy("k", scan.PART).count().collect()]
    assert laid.where("k = 'hot'").select(scan.PART).distinct().count() >= 2 and max(sizes) < 1500 < 2000
    plan = scan.carried(laid, ["k"], order(), sums={"s": F.col("v")})._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_without_a_key_with_maps_and_without_rows(spark):
    df = spark.createDataFrame([(i, {"a": i}) for i in range(50)], "id int, m map<string,int>")
    assert [r.s for r in scan.scanned(df, [], [F.asc("id")], sums={"s": F.col("id")}).orderBy("id").collect()] == [i * (i + 1) // 2 for i in range(50)]
    assert scan.scanned(df.limit(0), [], [F.asc("id")], sums={"s": F.col("id")}).collect() == []
    same = spark.createDataFrame([(1, "x")] * 30, "t int, k string")
    assert sorted(r.n for r in scan.scanned(same, ["k"], [F.asc("t")], sums={"n": F.lit(1)}).collect()) == list(range(1, 31))


def test_sessions_and_running_sums_of_a_hot_key(spark):
    rows = [r for r in rows_with_a_hot_key(3000, 2) if r[2] is not None]
    want = []
    for k, own in by_key(rows).items():
        last, n = None, 0
        for _, _, t, _ in own:
            if last is None or t - last > 3:
                n += 1
                want.append([k, n, t, t, 0])
            want[-1][3], want[-1][4], last = t, want[-1][4] + 1, t
    got = rollups.sessions(table(spark, rows), "k", F.col("t"), 3).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(tuple(w)) for w in want)
    grown = {r.id: r.d for r in rollups.since_previous(table(spark, rows), ["k"], order(), F.col("t"), "d").collect()}
    for own in by_key(rows).values():
        assert [grown[r[0]] for r in own] == [None, *(b[2] - a[2] for a, b in zip(own, own[1:], strict=False))]


def test_as_of_a_hot_key(spark):
    rows = rows_with_a_hot_key(3000, 3)
    left, right = [r for r in rows if r[0] % 3], [r for r in rows if not r[0] % 3]
    once = {}
    for i, k, t, v in right:
        once.setdefault((k, t), (i, k, t, v))
    right = list(once.values())
    got = joins.as_of(table(spark, left).drop("v"), spark.createDataFrame([(k, t, i) for i, k, t, _ in right], "k string, seen int, who int"), ["k"], "t", "seen", ["who"])
    known = by_key([r for r in right if r[2] is not None])
    for r in got.collect():
        own = [x for x in known.get(r.k, []) if r.t is not None and x[2] <= r.t]
        assert (r.seen, r.who) == ((own[-1][2], own[-1][0]) if own else (None, None))


def test_spans_and_points_by_a_sweep(spark):
    rng = random.Random(4)
    key = lambda i: "hot" if i % 2 else rng.choice(["a", "b", None])
    points = [(i, key(i), rng.choice([None, *range(60)])) for i in range(900)] + [(5000, "alone", 3), (0, "hot", 7), (0, "hot", 7)]
    spans = []
    for i in range(500):
        start = rng.choice([None, *range(60)])
        spans.append((i, key(i), start, None if start is None or rng.random() < 0.2 else start + rng.randint(-2, 20)))
    p = spark.createDataFrame(points, "id int, k string, at int")
    s = spark.createDataFrame(spans, "span int, k string, start int, finish int")
    inside = lambda p, s: p[1] is not None and p[1] == s[1] and None not in (p[2], s[2]) and s[2] <= p[2] and (s[3] is None or p[2] < s[3])
    around, held = scan.span_counts(p, s, "at", "start", "finish", ["k"])
    assert sorted((r.id, r.spans_around) for r in around.collect()) == sorted((x[0], sum(inside(x, y) for y in spans)) for x in points)
    assert sorted((r.span, r.points_inside) for r in held.collect()) == sorted((y[0], sum(inside(x, y) for x in points)) for y in spans)
    assert around.columns == ["id", "k", "at", "spans_around"] and held.columns == ["span", "k", "start", "finish", "points_inside"]
    empty = scan.span_counts(p.limit(0), s.limit(0), "at", "start", "finish", ["k"])
    assert [x.collect() for x in empty] == [[], []]
