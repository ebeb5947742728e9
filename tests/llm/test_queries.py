"""The registered queries of the ten operators, from end to end over the smallest tables, against libraries and brute force."""

import glob
import hashlib
import os
import zlib

import numpy as np
import pytest

from keepsake.llm import queries, toxicity
from keepsake.llm.queries import QUERIES
from test_text import plain_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def library(name):
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.tokenizer(name))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql_agree_with_it(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    rows = sorted(str(tuple(r[c] for c in order)) for r in got.collect())
    assert rows == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall()) and rows


def test_op5_encodes_and_decodes_like_the_library(spark, texts):
    lib, got = library("word_bpe_49k.json"), QUERIES["op5_segment_tree_bpe"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op6_scores_are_those_of_the_formula(spark, texts):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.fit(*toxicity.sample(docs, labels))
    got = QUERIES["op6_subword_toxicity"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        words = [[model.part[g] for g in toxicity.grams(w)] for w in toxicity.words(texts[r.doc_id] or "")]
        own = [sum(x) / len(x) for x in words]
        most = sorted(set(own))[-toxicity.TOP :]
        logit = model.bias + (sum(most) / len(most) if most else 0.0)
        assert r.score == pytest.approx(model.score(logit), abs=1e-9) and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_op6_finds_the_toxic_documents_that_no_fit_has_seen(spark):
    """On the larger table: at least 0.9 of them, though some labels there are wrong, with at most 1 % of the clean ones."""
    large = "/root/testdata/sf0.1"
    if not os.path.isdir(large):
        pytest.skip("no tables here")
    got = {r.doc_id: r.predicted for r in QUERIES["op6_subword_toxicity"](spark, large).where("held_out").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{large}/labels.parquet").collect() if r.doc_id in got}
    share = {c: [got[i] for i, x in labels.items() if x == c] for c in (0, 1)}
    print({c: (sum(v), len(v)) for c, v in share.items()})
    assert sum(share[1]) >= 0.9 * len(share[1]) > 100 and sum(share[0]) <= 0.01 * len(share[0])


def test_op7_components_are_those_of_brute_force(spark, texts):
    want = plain_components([(i, t, None) for i, t in texts.items()])
    got = QUERIES["op7_tensored_minhash"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_op8_counts_like_the_library(spark, texts):
    lib, got = library("byte_bpe_50k.json"), QUERIES["op8_prefix_token_counts"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        size = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), size(text), size(text) > 512)
        assert size(text[: r.fits_chars]) <= 512 and (r.fits_chars == len(text) or size(text[: r.fits_chars + 1]) > 512)


def test_op9_packs_every_id_once(spark, texts):
    lib, spans, pieces = library("word_bpe_49k.json"), {}, {}
    for r in QUERIES["op9_vector_packing"](spark, SF).collect():
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    assert sorted(pieces) == sorted(texts)
    for i, own in pieces.items():
        ids, at = [*lib.encode(texts[i] or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(own, key=lambda r: r.start):
            piece = np.array(ids[r.start : r.start + r.length], dtype="<u4")
            assert r.start == at and len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    for own in spans.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048


def test_conversations_are_packed_whole(spark):
    lib, turns = library("word_bpe_49k.json"), spark.read.parquet(f"{SF}/conversations.parquet").collect()
    want, got, sums = {}, {}, {}
    for r in turns:
        want[r.conv_id, r.turn] = want.get((r.conv_id, r.turn), 0) + len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1
    for r in QUERIES["conversation_packing"](spark, SF).collect():
        got[r.conv_id, r.turn] = got.get((r.conv_id, r.turn), 0) + r.length
        tokens, loss, examples = sums.setdefault(r.sequence_id, [0, 0, set()])
        sums[r.sequence_id][:2] = tokens + r.length, loss + r.loss
        examples.add((r.conv_id, r.turn // 64, r.example))
    assert got == want and all(t <= 2048 and n <= 1024 and len(e) <= 16 for t, n, e in sums.values())


def test_op10_is_right_on_held_out_documents(spark, texts):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op10_cross_parsing"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held) > 10
