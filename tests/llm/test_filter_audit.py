"""The audit of filters against counting rows step by step."""

import itertools
import re

import pytest

from keepsake.llm import filter_audit

NAMES = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(NAMES)]


def failures(rows):
    """For each row the set of filters that it fails."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A"} if len(words) < 50 else set()
        own |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        own |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        own |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        own |= {"E"} if i is not None and least[t] < i else set()
        out.append(own)
    return out


def plain(rows, labels, orders=ORDERS):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    fails, out = failures(rows), {}
    for part in {s or "" for _, _, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, fails, strict=True) if (s or "") == part]
        every = dict.fromkeys(NAMES, 0)
        for order in ORDERS:
            left = own
            for k, name in enumerate(order):
                gone, rest = [x for x in left if name in x[1]], [x for x in left if name not in x[1]]
                every[name] += len(gone)
                if order in orders:
                    failing = [x for x in own if name in x[1]]
                    out[part, order, k + 1] = [len(rest), len(gone), len(failing) - len(gone), sum(x[1] == {name} for x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), name]
                left = rest
        for (p, _, _), v in out.items():
            if p == part and isinstance(v[-1], str):
                v[-1] = every[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def ours(spark, rows, labels, **more):
    docs = spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], "doc_id long, text string, source string, mask string, n int")
    df = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **more)
    return df, {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def texts():
    prose = " ".join(f"word{k}" for k in range(60))
    return [
        (1, prose, "a"), (2, prose, "a"), (3, prose, "b"), (4, "short", "b"), (5, "a b " * 40, None), (6, "SHOUT " * 60, ""), (7, prose + " 5% & more", "a"), (8, None, "a"), (9, "", "c"),
        (10, "X#" * 300_000, "c"), (11, "ÄÖ " * 60, "b"), (12, "  x\x0b\x0c\r\ny", "b"), (13, "tie", "a"), (13, "tie", "a"), (14, "tie", "c"), (None, "tie", "c"), (None, prose, None), (15, prose.upper(), "a"),
    ]


def test_every_step_of_every_order_is_that_of_brute_force(spark):
    rows, labels = texts(), [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, None, 1), (5, 1, None), (7, 0, 1), (13, 1, 1), (99, 1, 1), (None, 1, 1)]
    df, got = ours(spark, rows, labels)
    assert df.count() == len(got) == 4 * 600 and got == plain(rows, labels)
    kinds = dict(df.dtypes)
    assert kinds["step"] == "int" and {kinds[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")} == {"bigint"}


def test_hot_part_and_hot_text(spark):
    rows = [(i, "same text" if i % 2 else f"text {i} 100%", "hot" if i % 3 else None) for i in range(3000)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 3000, 7)]
    assert ours(spark, rows, labels)[1] == plain(rows, labels)


def test_empty_tables_given_orders_and_wrong_names(spark):
    assert ours(spark, [], [])[1] == {}
    rows = texts()
    some = ours(spark, rows, [], orders=["ABCDE", "EDCBA"])[1]
    assert some == plain(rows, [], ["ABCDE", "EDCBA"])
    alone = ours(spark, rows, [], filters={"A": filter_audit.FILTERS["A"]}, repeated=None)[1]
    assert {k[1:]: v[1] for k, v in alone.items() if k[0] == "c"} == {("A", 1): 4}
    with pytest.raises(ValueError):
        ours(spark, rows, [], repeated="A")
