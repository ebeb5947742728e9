"""The training-data operators leave nothing out: no stratum, no language, no part of a text."""

import zlib

from keepsake.llm import language_id, quality_rules, toxicity


def test_toxicity_sees_all_of_a_text_without_white_space():
    rows = [(i, " ".join(["lorem", "dolor", "sita", "amet"] * 8 + (["wretch", "vermin"] if i % 3 == 0 else ["ipsum", "conis"])), int(i % 3 == 0)) for i in range(120)]
    scorer = toxicity.Scorer(toxicity.fit([t for _, t, _ in rows], [c for _, _, c in rows]))
    for joint in "/_.-,":
        clean = joint.join(["lorem", "dolor", "sita", "amet"] * 30)
        assert scorer.score(clean) < 0.5 and scorer.score(clean + joint + "wretch" + joint + "vermin") >= 0.7
    clean = "loremdolorsitaamet" * 30
    assert scorer.score(clean + "wretchvermin" + clean) > scorer.score(clean + clean)
    assert scorer.score("wretch " + "-" * 80) == scorer.score("wretch -")


def test_slices_of_long_words_have_all_their_grams_and_no_others():
    for n in (65, 66, 67, 68, 69, 200):
        word = "".join(chr(0x4E00 + i) for i in range(n))
        marked = f"<{word}>"
        want = {zlib.crc32(marked[i : i + k].encode()) % toxicity.BUCKETS for k in range(3, 6) for i in range(len(marked) - k + 1)}
        assert {g for w in toxicity.words(word) for g in toxicity.grams(w)} == want


def test_quality_rules_give_cutoffs_to_every_stratum(spark):
    body = "array_join(transform(sequence(1, 60), i -> concat('w', i, 'x', id)), ' ')"
    docs = spark.range(1100 * 18).selectExpr("id AS doc_id", f"concat({body}, IF(id >= 1100 * 17, ' $ $ $ $ $ $ $ $ $', '')) AS text", "concat('l', id % 1100) AS lang")
    labels = docs.where("doc_id < 1100 * 17").selectExpr("doc_id", "1 AS quality")
    out = quality_rules.judge(docs, labels, alpha=0.5, delta=0.5).selectExpr("doc_id >= 1100 * 17 AS bad", "kept", "cut_symbols").groupBy("bad", "kept", "cut_symbols").count().collect()
    assert {tuple(r) for r in out} == {(False, True, 50, 1100 * 17), (True, False, 50, 1100)}


def test_every_labelled_language_is_learned_and_long_words_teach(spark):
    rows = [(i, f"{chr(0x4E00 + i % 70) * 5} {chr(0x5E00 + i % 70) * 4}", f"l{i % 70:02}") for i in range(70 * 12)] + [(5000 + i, "".join(chr(0x3041 + (i + k) % 40) for k in range(150)), "long") for i in range(12)]
    learned = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(learned) == {r[2] for r in rows}
    parser = language_id.CrossParser(learned)
    assert [x[0] for x in parser.predict([r[1] for r in rows])] == [r[2] for r in rows]
