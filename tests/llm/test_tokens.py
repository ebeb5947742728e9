"""BPE, token counts and packing, against the tokenizers library."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from keepsake.llm import bpe, packing, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS, BYTES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
PIECES = ["a", "B", "'s", "'LL", "'l", "é", "Σ", "ΑΣ ", "İ", "ß", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", " \n", "\n ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "1", "22", "٣", "中文", "😀", "​", "don't", "!!", "...", "_", "#", "ǅ", "가", "th", "ing", "x" * 70, "qwerty" * 20, "ͅ", "Ⅷ", "\x00", " the", "hello"]
SCHEMA = "doc_id long, text string, n_tokens string, length int"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {p: Tokenizer.from_file(p) for p in (WORDS, BYTES)}


def samples(n, seed):
    rng = random.Random(seed)
    return ["", " ", "\n"] + ["".join(rng.choices(PIECES, k=rng.randint(1, 12))) for _ in range(n)] + ["".join(rng.choices("etaoin", k=6000)), "word " * 5000]


def test_segment_tree_merges_leftmost_lowest_rank():
    pairs = {(1, 1): (0, 2), (2, 1): (1, 3), (2, 2): (2, 4)}
    assert bpe.merge_word([1] * 5, pairs) == [2, 3]
    flat, length = bpe.merge_words(np.array([1] * 5 + [1] * 3 + [7]), np.array([5, 3, 1]), bpe.PairTable(pairs))
    assert flat.tolist() == [2, 3, 3, 7] and length.tolist() == [2, 1, 1]


def test_encoding_and_decoding_match_the_library(library):
    own, texts = bpe.WordBPE(WORDS), samples(1500, 1)
    for t, raw in zip(texts, own.encode_batch(texts), strict=True):
        ids = library[WORDS].encode(t, add_special_tokens=False).ids
        assert bpe.unpacked(raw).tolist() == ids, t
        assert own.decode(ids) == library[WORDS].decode(ids, skip_special_tokens=False)


def test_encode_frames(spark, library):
    rows = [(1, None), (2, ""), (3, "Some text"), (3, "Some text"), (None, "x<|endoftext|>y"), (4, "long " * 30_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    out = bpe.encode(df, WORDS).collect()
    assert sorted(len(r.ids) for r in out) == sorted(len(library[WORDS].encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    for r in bpe.digests(df, WORDS).collect():
        text = next(t for i, t in rows if i == r.doc_id)
        ids = library[WORDS].encode(text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library[WORDS].decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(df.limit(0), WORDS).count() == 0


def test_prefix_counts_match_the_library(library):
    counter = token_counts.PrefixCounter(BYTES)
    for t in samples(1500, 2):
        assert counter.counts(t)[-1] == len(library[BYTES].encode(t, add_special_tokens=False).ids), t
    for t in [*samples(150, 3)[:-2], "a <|endoftext|>", "!!<|endoftext|><|endoftext|> \n<|endoftext|>'ll'l", "we'll  've \n\n 'tis   x", "'" * 3 + "ll"]:
        counts = counter.counts(t)
        assert len(counts) == len(t) + 1
        for n in range(len(t) + 1):
            assert counts[n] == len(library[BYTES].encode(t[:n], add_special_tokens=False).ids), (t[:n], t)


def test_longest_prefix_within_a_budget(library):
    counter = token_counts.PrefixCounter(BYTES)
    for t in ["Some words of a text, and   more of them.", "x" * 300, "", "é中😀" * 9]:
        for limit in (0, 1, 3, 8):
            best = max(n for n in range(len(t) + 1) if len(library[BYTES].encode(t[:n], add_special_tokens=False).ids) <= limit)
            assert token_counts.PrefixCounts(counter, t).fit(limit) == best


def test_long_words_take_time_in_proportion():
    import time

    counter = token_counts.PrefixCounter(BYTES)
    began = time.thread_time()
    found = token_counts.PrefixCounts(counter, "!?" * 100_000)
    assert found.fit(1) > 0 and found.count(200_000) > 1000 and time.thread_time() - began < 20  # a second on a machine of today


def test_stored_prefixes_answer_cuts_and_budgets(spark, library):
    rows = [(1, "Some words, and   more of them."), (2, None), (3, ""), (4, "x" * 200), (None, "we'll see"), (1, "again")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    from pyspark.sql import functions as F

    stored = token_counts.prefix_counts(df, BYTES)
    size = lambda t: len(library[BYTES].encode(t, add_special_tokens=False).ids)
    got = stored.select("doc_id", "counts", token_counts.tokens_at(F.col("counts"), F.lit(6)).alias("six"), token_counts.longest_within(F.col("counts"), F.lit(3)).alias("three")).collect()
    cut = {(r.doc_id, r.text, r.n_tokens) for r in token_counts.truncated(df, BYTES, 3).collect()}
    assert len(got) == len(rows) == len(cut)
    for (i, t), r in zip(rows, got, strict=True):
        t = t or ""
        best = max(n for n in range(len(t) + 1) if size(t[:n]) <= 3)
        assert (r.doc_id, r.counts, r.six, r.three) == (i, [size(t[:n]) for n in range(len(t) + 1)], size(t[:6]), best)
        assert (i, t[:best], size(t[:best])) in cut


def test_count_frames(spark):
    df = spark.createDataFrame([(1, None, "", 0), (None, "é", "", 0), (2, "word " * 600, "", 0), (2, "word " * 600, "", 0)], SCHEMA)
    out = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, BYTES).collect())
    assert out[:2] == [(0, 2, 1, False), (1, 0, 0, False)] and out[2] == out[3] and out[2][3]
    assert token_counts.count_tokens(df.limit(0), BYTES).count() == 0


def test_packing_keeps_every_limit():
    rng = np.random.default_rng(1)
    demand = np.stack([rng.integers(1, 900, 3000), np.ones(3000, dtype=int), rng.integers(0, 300, 3000)], axis=1)
    limits = (2048, 6, 700)
    bins = packing.pack(demand, limits)
    sums = np.stack([np.bincount(bins, demand[:, k]) for k in range(3)], axis=1)
    assert (sums <= limits).all() and (sums[:, 1] > 0).all()
    lower = max(-(-int(demand[:, k].sum()) // limits[k]) for k in range(3))
    assert len(sums) <= 1.12 * lower
    assert packing.pack(np.zeros((0, 3))).tolist() == []
    with pytest.raises(ValueError):
        packing.pack(np.array([[3000, 1, 1]]))


def test_packed_documents_are_whole(spark, library):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "Gamma!", "δ"], k=rng.randint(0, 200)))) for i in range(200)] + [(500, None), (501, ""), (502, "word " * 9000), (None, "null key"), (7, "again"), (7, "again")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).coalesce(2)
    out = packing.pack_documents(df, WORDS).collect()
    ids = {i: [*library[WORDS].encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    spans = {}
    for r in out:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id != 7:
            piece = ids[r.doc_id][r.start : r.start + r.length]
            assert len(piece) == r.length and zlib.crc32(np.array(piece, dtype="<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in out if r.doc_id != 7) == sum(len(v) for i, v in ids.items() if i != 7)
    assert sum(r.length for r in out) >= 0.93 * 2048 * (len(spans) - 2)  # either task may leave its last one unfilled
    assert packing.pack_documents(df.limit(0), WORDS).count() == 0


def test_thousands_of_added_tokens_in_one_text(library):
    counter, lib = token_counts.PrefixCounter(BYTES), library[BYTES]
    added = sorted(counter.added)[0]
    began = time.perf_counter()
    assert int(counter.counts(f"ab {added}" * 20_000)[-1]) == len(lib.encode(f"ab {added}" * 20_000, add_special_tokens=False).ids)
    assert time.perf_counter() - began < 20  # in proportion to the text
    text = f"ab {added}it's{added[:5]}{added}{added} é{added}"
    assert counter.counts(text).tolist() == [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]


def test_rows_that_repeat_a_turn_are_held_in_bounded_number(spark, library, monkeypatch):
    df = spark.createDataFrame([(i % 2 or None, 0, "user", "so it goes", "x") for i in range(30_000)], "conv_id long, turn int, role string, text string, extra string")
    n = len(library[WORDS].encode("so it goes", add_special_tokens=False).ids) + 1
    out = packing.pack_conversations(df, WORDS).groupBy("sequence_id").agg({"length": "sum", "*": "count"}).collect()
    assert sum(r["sum(length)"] for r in out) == 30_000 * n and sum(r["count(1)"] for r in out) == 30_000 and max(r["sum(length)"] for r in out) <= 2048


def test_each_limit_of_instruction_data_can_bind(spark, library):
    rng = random.Random(8)
    rows = [(c, t, ("user", "assistant")[t % 2], " ".join(rng.choices(["alpha", "beta", "Gamma!", "δ"], k=rng.randint(0, 60)))) for c in range(60) for t in range(rng.choice([1, 2, 5]))]
    rows += [(100, 0, "user", None), (101, 0, "assistant", "long " * 3000), (101, 1, None, ""), (None, 0, "assistant", "x"), (3, None, "user", "y"), (300, 0, "user", "again"), (300, 0, "user", "again")]
    rows += [(200, t, "assistant", "so it goes on") for t in range(200)]  # more turns than are looked at together
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, example string, offset int")
    ids = lambda t: np.array([*library[WORDS].encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
    texts = {}
    for c, t, role, text in rows:
        texts.setdefault((c, t), (text, role))
    for limits, binds in (((2048, 10_000, 10_000), 0), ((2048, 3, 10_000), 1), ((2048, 10_000, 150), 2), ((300, 4, 120), None)):
        out = packing.pack_conversations(df, WORDS, limits).collect()
        assert sum(r.length for r in out) == sum(len(ids(r[3])) for r in rows)
        by, examples = {}, {}
        for r in out:
            text, role = texts[r.conv_id, r.turn]
            piece = ids(text)[r.start : r.start + r.length]
            assert len(piece) == r.length and r.loss == (r.length if role == "assistant" else 0) and zlib.crc32(piece.tobytes()) == r.ids_crc32
            by.setdefault(r.sequence_id, []).append(r)
            examples.setdefault((r.conv_id, None if r.turn is None else r.turn // packing.TURNS, r.example), set()).add(r.sequence_id)
        assert all(len(s) == 1 for s in examples.values())
        sums = []
        for own in by.values():
            own.sort(key=lambda r: r.offset)
            assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
            sums.append((sum(r.length for r in own), len({(r.conv_id, None if r.turn is None else r.turn // packing.TURNS, r.example) for r in own}), sum(r.loss for r in own)))
        sums = np.array(sums)
        assert (sums <= limits).all()
        if binds is not None:  # nearly all sequences are full by this one, and by no other
            share = np.median(sums / np.array(limits), axis=0)
            assert share[binds] > 0.9 and all(share[k] < 0.9 for k in range(3) if k != binds), share
    assert packing.pack_conversations(df.limit(0), WORDS).count() == 0
