"""The audit of sources against plain counting."""

import re
from collections import Counter

import numpy as np
import pytest

from keepsake.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, least=10, top=10):
    docs, count, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall(lowered(text))
        docs.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    out = []
    for lang, source in groups:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= least)
        sources = sorted(s for x, s in groups if x == lang)

        def p(of, kept=kept, lang=lang):
            own = [sum(count[lang, s, t] for s in of) for t in kept]
            return own, [1 + 10**9 * (c + 2) // (sum(own) + 2 * len(kept)) for c in own]

        own, mine = p([source])
        _, whole = p(sources)
        far = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = [(-sum(map(far, mine, p([s])[1])), s) for s in sources if s != source]
        terms = [(-far(a, b), t) for c, a, b, t in zip(own, mine, whole, kept, strict=True) if c and a > b]
        for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
            out += [(lang, source, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def ours(spark, rows, **more):
    docs = spark.createDataFrame([(t, a, s, "x", 5) for t, a, s in rows], "text string, lang string, source string, term string, n int")
    df = divergence.audit(docs.repartition(3), **more)
    assert dict(df.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    return sorted(tuple(r) for r in df.collect())


def corpus(seed=3, many=240):
    rng = np.random.default_rng(seed)
    words = ["der", "Die", "ÄÖ", "äö", "x", "日本", "naïve", "a" * 400, "b1c", "z", "zz", "THE", "the", "😀", "o'clock", "e-mail"] + [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(60)]
    rows = []
    for _ in range(many):
        own = rng.choice(words, rng.integers(0, 40), p=(lambda w: w / w.sum())(1 / np.arange(1, len(words) + 1)))
        rows.append((" ".join(own), ["en", "de", None][rng.integers(3)], ["s1", "s2", "s3", "é", None, ""][rng.integers(6)]))
    return [*rows, (None, "en", "silent"), ("", "en", "silent"), ("1234 ...", "de", "digits"), ("alone", "xx", "one"), ("alone", "xx", "two"), ("the " * 300_000, "en", "s1"), ("y" * 5_000_000 + " the the", "de", "s2"), rows[0], rows[0]]


def test_pairs_and_terms_are_those_of_plain_counting(spark):
    rows = corpus()
    assert ours(spark, rows) == plain(rows)


def test_tiles_small_tries_and_other_limits(spark, monkeypatch):
    rows = corpus(5, 120)
    for name, value in (("COMPACT", 200), ("HAND_OVER", 50), ("LEAVES", 3), ("COUNTERS", 7), ("BUILDING", 20), ("ROWS", 16)):
        monkeypatch.setattr(divergence, name, value)
    assert ours(spark, rows, least=2, top=3, tile=2) == plain(rows, 2, 3)


def test_small_limits_inside_one_process():
    """The same tries whatever the limits: counted and merged here, where the limits hold for certain."""
    import pyarrow as pa

    rows = [(t, a or "", s or "") for t, a, s in corpus(7, 60)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array([(r[0] or "").encode() for r in rows])], names=["lang", "source", "text"])
    want = Counter()
    for t, a, s in rows:
        want.update((x, a, s) for x in TERM.findall(lowered(t)))
    old = {k: getattr(divergence, k) for k in ("COMPACT", "HAND_OVER", "LEAVES", "COUNTERS", "BUILDING", "ROWS", "PIECE")}
    try:
        for k, v in (("COMPACT", 100), ("HAND_OVER", 30), ("LEAVES", 3), ("COUNTERS", 7), ("BUILDING", 20), ("ROWS", 16), ("PIECE", 1000)):
            setattr(divergence, k, v)
        leaves = list(divergence._count(iter([batch.slice(0, 20), batch.slice(20)])))
        got = Counter()
        for b in leaves:
            assert b.column(0).to_pylist() == sorted(b.column(0).to_pylist(), key=str.encode)
            for r in b.to_pylist():
                got[r["term"], r["lang"], r["source"]] += r["n"]
        assert got == want
        every = sorted((tuple(r.values()) for b in leaves for r in b.to_pylist()), key=lambda r: (r[0].encode(), r[1], r[2]))
        table = pa.Table.from_pylist([dict(zip(divergence._LEAF.names, r, strict=True)) for r in every], divergence._LEAF)
        merged = Counter()
        for b in divergence._merge(1)(iter(table.to_batches(max_chunksize=11))):
            for r in b.to_pylist():
                term, k = b"", 0
                assert len(r["shared"]) <= 3
                for same, rest, size in zip(r["shared"], r["suffixes"], r["sizes"], strict=True):
                    term = term[:same] + rest
                    for j in range(k, k + size):
                        merged[term.decode(), r["lang"], r["sources"][r["at"][j]]] += r["counts"][j]
                    k += size
        assert merged == want
    finally:
        for k, v in old.items():
            setattr(divergence, k, v)


def test_empty_table_and_shares(spark):
    assert ours(spark, []) == []
    rng = np.random.default_rng(1)
    for _ in range(200):
        whole = int(rng.integers(1, 9 * 10**15))
        count = int(rng.integers(0, whole + 1))
        assert int(divergence.shares(np.array([count]), np.int64(whole))[0]) == 1 + 10**9 * count // whole


def test_many_tasks_with_one_hot_source(spark):
    rows = [(f"common words {'rare' + 'abcdefghijklmnopqrst'[i % 20]} x", "en", "hot" if i % 3 else f"s{i % 5}") for i in range(2000)]
    assert ours(spark, rows) == plain(rows)


@pytest.mark.parametrize("text", ["", "a", "é", "aé1Bc", "\x00a\x7fb`c@d[e{f", "ÿ\u0080\U0010ffff"])
def test_terms_are_those_of_the_pattern(text):
    data = np.frombuffer((text + "|" + text).encode(), dtype=np.uint8)
    terms, of = divergence.terms_of(data, np.array([0, len(text.encode()) + 1]))
    assert terms.to_pylist() == TERM.findall(lowered(text)) * 2 and of.tolist() == [0] * (len(terms) // 2) + [1] * (len(terms) // 2)
