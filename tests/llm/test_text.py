"""WARC, toxicity, language identification, near duplicates and the pipeline."""

import gzip
import hashlib
import io
import json
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from keepsake.llm import language_id, near_duplicates, packing, toxicity, warc

PAGES = "page_id long, url string, html string, record_type string"


def test_normaliser_gives_members_that_are_read_alone():
    records = [warc.page_record(i, f"http://x/{i}\r\n", b"p" * i, hashlib.sha1(b"p" * i).hexdigest(), i, None) for i in range(5)]
    stream, out, index = io.BytesIO(), io.BytesIO(), io.BytesIO()
    assert warc.write_stream(stream, records) == 5
    stream.seek(0)
    assert warc.normalise(stream, out, index) == 5
    entries = [json.loads(x) for x in index.getvalue().splitlines()]
    assert sum(e["length"] for e in entries) == len(out.getvalue())
    assert gzip.decompress(out.getvalue()) == gzip.decompress(stream.getvalue())
    for i, e in reversed(list(enumerate(entries))):
        r = warc.read_record(out, e["offset"], e["length"])
        assert r.block == b"p" * i and e["id"] == f"<urn:page:{i}>" and "\r" not in r.fields["warc-target-uri"]


def test_broken_streams_are_refused():
    for raw in (b"no record", b"WARC/1.1\r\nA: b\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"):
        with pytest.raises(ValueError):
            list(warc.records_of(io.BytesIO(raw)))


def test_pages_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a", "<p>small</p>"), (2, "http://b", "<p>small</p>"), (3, "u3", big), (4, "u4", big), (9, "u9", big), (9, "u9", big), (5, None, None), (6, "", ""), (None, "n", big), (7, "u7", "x" * 300_000)]
    out = warc.round_trip(spark.createDataFrame([(*r, "?") for r in rows], PAGES), tmp_path.as_uri()).collect()
    assert len(out) == len(rows)
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in out}
    for i, _, html in rows:
        body = (html or "").encode()
        revisit = html == big and i in (3, 4)
        assert (i, "revisit" if revisit else "response", 9 if revisit else None, len(body), hashlib.sha1(body).hexdigest()) in got
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_automaton_phrases():
    a = language_id.SuffixAutomaton(" banana band ")
    assert a.phrases("banana") == 1 and a.phrases("anband") == 2 and a.phrases("xyz") == 3 and a.phrases("") == 0
    text = "".join(random.Random(1).choices("ab", k=200))
    a = language_id.SuffixAutomaton(text)
    for i in range(0, 180, 7):
        assert a.phrases(text[i : i + 20]) == 1


def test_archives_from_elsewhere_are_normalised(spark, tmp_path):
    pages = [(i, f"http://x/{i}", b"p" * i) for i in range(4)]
    with open(tmp_path / "whole.warc.gz", "wb") as f:
        warc.write_stream(f, [warc.page_record(i, u, p, hashlib.sha1(p).hexdigest(), len(p), None) for i, u, p in pages])
    (tmp_path / "cut.warc.gz").write_bytes((tmp_path / "whole.warc.gz").read_bytes()[:-40])
    (tmp_path / "none.warc.gz").write_bytes(b"no gzip")
    names = ["whole.warc.gz", "cut.warc.gz", "none.warc.gz", "missing.warc.gz"]
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in names] + [(None,)], "path string")
    done = near_duplicates.written(warc.normalise_archives(paths, tmp_path.as_uri() + "/out"), "manifest")
    got = {r.path.rpartition("/")[2]: r for r in done.collect()}
    assert got.keys() == set(names) and got["whole.warc.gz"].records == 4 and all((got[n].error is None) == (n == "whole.warc.gz") for n in names)
    assert sorted((r.page_id, r.payload_bytes) for r in warc.read_archives(done).collect()) == [(i, i) for i in range(4)]
    assert warc.normalise_archives(paths.limit(0), tmp_path.as_uri() + "/out").count() == 0


def plain_phrases(text, learned):
    """The greedy parse by searching the learned text; each piece by itself."""
    count = 0
    for k in range(0, len(text), language_id.PIECE):
        piece, at = text[k : k + language_id.PIECE], 0
        while at < len(piece):
            n = 1
            while at + n < len(piece) and piece[at : at + n + 1] in learned:
                n += 1
            at, count = at + n, count + 1
    return count


def test_parses_match_a_search_of_the_learned_text(monkeypatch):
    rng = random.Random(6)
    learned = {x: language_id.running(" ".join("".join(rng.choices(own, k=rng.randint(1, 6))) for _ in range(300))) for x, own in (("a", "abcdé"), ("b", "abxyz"), ("c", "中文字人"))}
    texts = [language_id.running(" ".join("".join(rng.choices("abcdéxyzq中文", k=rng.randint(1, 6))) for _ in range(n))) for n in (0, 1, 3, 40, 200, 900)]
    for piece in (7, 64, 1024):
        monkeypatch.setattr(language_id, "PIECE", piece)
        got = language_id.CrossParser(learned).phrases(texts)
        assert got.tolist() == [[plain_phrases(t, learned[x]) for x in sorted(learned)] for t in texts]
    assert b"a" * 3 not in learned["c"] and language_id.CrossParser({"a": b" the cat sat "}).phrases([b" the cat sat "]).tolist() == [[1]]  # a phrase crosses words


def test_running_text_has_letters_only():
    assert language_id.running("½ ² ① 12 _ ٣") == b"" == language_id.running(None) == language_id.running("")
    assert language_id.running("A-b\tÉÇ_x ½ü 中文。字!") == " a b éç x ü 中文 字 ".encode()
    many = "".join(map(chr, range(0x2190, 0x2300)))
    assert language_id.running(f"a{many}b") == b" a b "


def test_foreign_texts_are_rejected_and_others_stay(spark):
    greek = "και το σπίτι με την αλεπού που πηδά πάνω από τον τεμπέλη σκύλο " * 4
    rows = [*corpus(), (1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (1003, greek, None), (1004, "A.", "en"), (None, DE, "de"), (3, corpus()[3][1], "de")]
    kept = language_id.spoken(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted([*range(120), 3, 1004, -1])
    # once Greek is learned, the same text is told to be Greek, and stays
    taught = [(2000 + i, greek, "el") for i in range(12)]
    assert 1003 in {r.doc_id for r in language_id.spoken(frame(spark, rows + taught)).collect()}
    assert language_id.spoken(frame(spark, [(1, EN, None)])).count() == 0 == language_id.spoken(frame(spark, [])).count()


EN, DE = "the quick brown fox jumps over a lazy dog and the other house", "der schnelle braune fuchs springt über den faulen hund und das haus"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string"


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(rng.choices((EN if lang == "en" else DE).split(), k=rng.randint(30, 90))), lang))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x") for i, t, lang in rows], DOCS)


def test_languages_are_told_apart(spark):
    rows = [*corpus(), (1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (None, DE, "de"), (1003, "x" * 50_000, None), (1004, "½ ² ①", "en"), (3, corpus()[3][1], "de")]
    out = language_id.identify(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id < 1000:
            assert r.lang_pred == ("en", "de")[r.doc_id % 2] and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id in (1000, 1001, 1002, 1004):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert next(r for r in out if r.doc_id is None).lang_pred == "de"
    assert {r.lang_pred for r in language_id.identify(frame(spark, [(1, "words", None)])).collect()} == {"und"}
    assert language_id.identify(frame(spark, [])).count() == 0


def toxic_corpus(n=400, seed=2):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "amet", "con") for b in ("um", "a", "is", "or", "ent")]
    rows = []
    for i in range(n):
        own = rng.choices(words, k=rng.randint(20, 120))
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(["wretch", "vermin", "vermins"]))
        rows.append((i, " ".join(own), int(bad)))
    return rows


def test_toxic_texts_and_unseen_misspellings_are_found():
    rows = toxic_corpus()
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    model = toxicity.fit([t for _, t, _ in train], [c for _, _, c in train])
    scorer = toxicity.Scorer(model)
    held = [r for r in rows if r not in train]
    right = sum((scorer.score(t) >= 0.7) == bool(c) for _, t, c in held)
    assert right / len(held) > 0.97
    clean = held[1][1] if not held[1][2] else held[2][1]
    assert scorer.score(clean + " verminn") > scorer.score(clean) and scorer.score("dolor " * 3000 + "vermin wretch " + "sita " * 3000) >= 0.7
    assert 0 <= scorer.score("") <= 1 and scorer.score("") == scorer.score(None)
    again = toxicity.fit([t for _, t, _ in train], [c for _, _, c in train])
    assert np.array_equal(again.part, model.part)
    assert toxicity.fit(["a"], [1]) is None


def test_n_grams_of_many_words_are_those_of_each():
    own = ["word", "Über", "中文字", "😀x😀", "a", "", "...", "É!", " mid", "end ", " mid ", "x" * 64, "ß€𝄞"]
    of, buckets = toxicity.gram_buckets(own)
    for k, w in enumerate(own):
        assert sorted(buckets[of == k].tolist()) == sorted(toxicity.grams(w)), w


def test_toxicity_frames(spark):
    rows = [(i, t, "en") for i, t, _ in toxic_corpus(120)] + [(900, None, None), (None, "dolor", None), (901, "", "en"), (0, toxic_corpus(120)[0][1], "en")]
    labels = spark.createDataFrame([(i, c, "x") for i, _, c in toxic_corpus(120)] + [(0, 1, "x"), (None, 1, "x"), (900, None, "x")], "doc_id long, toxic int, score string")
    out = toxicity.detect(frame(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    none = toxicity.detect(frame(spark, rows), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.detect(frame(spark, []), labels).count() == 0


def near_corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 7)))
    rows = []
    for base in range(25):
        words = [word() for _ in range(rng.randint(20, 300))]
        for copy in range(rng.choice([1, 2, 6])):
            own = list(words)
            for _ in range(copy * max(1, len(words) // 60)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own), "en"))
    words = [word() for _ in range(150)]
    for _ in range(120):  # one large group, whose members are about as far apart as links reach
        own = list(words)
        for _ in range(4):
            own[rng.randrange(len(own))] = word()
        rows.append((len(rows), " ".join(own), "en"))
    rows += [(len(rows) + k, rows[4][1].upper(), "en") for k in range(30)]
    return rows


def plain_components(rows):
    sets = {}
    for i, t, _ in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_match_brute_force(spark):
    rows = near_corpus()
    extra = [(5000, None, "en"), (5001, "", "en"), (5002, "two words", "en"), (5003, "TWO  words", "en"), (5004, "words two", "en"), (5005, "word " * 20_000, None)]
    want = plain_components(rows + extra)
    out = near_duplicates.components(frame(spark, [*rows, *extra, (None, rows[0][1], "en"), rows[7]])).collect()
    assert len(out) == len(rows) + len(extra) + 2
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
    assert near_duplicates.components(frame(spark, [])).count() == 0


def test_open_pairs_are_compared_in_blocks(spark, monkeypatch):
    rows = near_corpus(5)
    monkeypatch.setattr(near_duplicates, "MAX_ROUNDS", 1)
    monkeypatch.setattr(near_duplicates, "SMALL", 2)
    monkeypatch.setattr(near_duplicates, "BLOCK", 2000)
    monkeypatch.setattr(near_duplicates, "ASKED", 1000)
    monkeypatch.setattr(near_duplicates, "BUCKET_BLOCK", 5)
    monkeypatch.setattr(near_duplicates, "KNOWN", 3)
    want = plain_components(rows)
    assert {r.doc_id: r.component_id for r in near_duplicates.components(frame(spark, rows)).collect()} == {i: c for i, (_, c) in want.items()}


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(1, "some words of a text", "a", 1), (2, "SOME words of a text", "b", 2), (2, "some words of a text", "b", 3), (3, "other", "c", 4), (3, "other", "d", 5), (None, "other", "e", 6), (4, None, "f", 7), (5, "", "g", 8)]
    df = spark.createDataFrame([(*r, *r[2:], r[3], r[3], r[3]) for r in rows], "doc_id long, text string, _id string, n int, print string, kept int, component_id int, groups int, label int")
    out = near_duplicates.one_of_each(df)
    assert out.columns == df.columns and sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 3, 4, 5] and out.where("doc_id IS NULL").count() == 1
    assert near_duplicates.components(df).count() == len(rows)


def test_tensored_tables_find_links():
    rng = np.random.default_rng(2)
    missed = 0
    for _ in range(2000):
        common, own = rng.integers(0, 1 << 63, 160, dtype=np.uint64), rng.integers(0, 1 << 63, (2, 20), dtype=np.uint64)
        a, b = (near_duplicates.group_hashes(np.concatenate([common, x])) for x in own)
        missed += (a == b).sum() < 2
    assert missed <= 3 and len(near_duplicates.tables_of()) == 153


def test_pipeline_matches_its_stages_in_plain_python(spark, tmp_path):
    rng = random.Random(9)
    rows = corpus(160, 4)
    words = {i: t.split() for i, t, _ in rows}
    toxic = set(range(0, 160, 5))
    docs = []
    for i, _, lang in rows:
        own = words[i]
        own += [f"w{i}x{k}" for k in range(40)]
        for _ in range(4 * (i in toxic)):
            own.insert(rng.randrange(len(own)), rng.choice(["wretch", "vermin"]))
        docs.append((i, " ".join(own), lang))
    docs += [(1000, docs[1][1], "de"), (1001, docs[1][1] + " more", "de"), (1002, "1 2 3", "en"), (1003, None, "en")]
    frame(spark, docs).drop("score").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i in toxic)) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = [r for r in docs if any(c.isalpha() for c in r[1] or "")]
    known = {i for i, _, _ in left}
    chosen = [(i, t, int(i in toxic)) for i, t, _ in left if i < 160 and zlib.crc32(str(i).encode()) % 3 != 1]
    scorer = toxicity.Scorer(toxicity.fit([t for _, t, _ in chosen], [c for _, _, c in chosen]))
    left = [r for r in left if scorer.score(r[1]) < 0.7]
    groups = plain_components(left)
    left = [r for r in left if groups[r[0]][1] == r[0]]
    assert {r.doc_id for r in out} == {i for i, _, _ in left} and 1002 not in known
    assert {1000, 1001} & {r.doc_id for r in out} == set() and len({r.doc_id for r in out} & toxic) <= 2
    assert all(r.length <= packing.LIMITS[0] for r in out)
    nothing = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, nothing, str(tmp_path))
        assert kept.count() == 0 and (name == "packing" or kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]), name


def test_pipeline_stages_take_any_rows(spark, tmp_path):
    rng = random.Random(11)
    plain = [(i, f"{t} w{i}a w{i}b w{i}c w{i}d w{i}e w{i}f w{i}g w{i}h", lang) for i, t, lang in corpus(60, 7)]
    long = (500, " ".join(rng.choices(EN.split(), k=60_000)), "en")
    odd = [(501, None, "en"), (502, "", None), (None, plain[3][1] + " tail", None), (503, "x" * 100_000, "en"), long, plain[5], plain[5]]
    rows = [(i, t, lang, "s", len(t or ""), "id", 1, "k", "m", 0.5, [1]) for i, t, lang in plain + odd]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string, n int, key string, lang_pred string, score double, groups array<int>")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    ids = lambda df: sorted(-1 if r.doc_id is None else r.doc_id for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        found = ids(kept)
        if name == "language_id":
            assert found == sorted([*range(60), -1, 500, 503, 5, 5])
        elif name == "toxicity":
            assert found == sorted([*range(60), -1, 500, 501, 502, 503, 5, 5])  # labels of one kind teach nothing
        else:
            assert found == sorted([*range(60), -1, 500, 501, 502, 503])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert set(ids(packed)) == {*range(60), -1, 500, 501, 502, 503} and packed.where("doc_id = 500").agg({"length": "sum"}).first()[0] == packed.where("doc_id = 500").first().doc_tokens
    assert packed.where("doc_id = 5 AND start = 0").count() == 3
