"""The positional index and its queries against a plain reading of the texts."""

import re

import pytest

from keepsake.operators import fulltext, search

TEXTS = {
    1: "The cat. the CAT, concat", 2: None, 3: "a_cat x-the", 4: "none", 5: "", 6: "a well-known fact, well known; well... known!", 7: "well a known", 8: "a a a a", 9: "New York, new york new", 10: "ÉTÉ été 東京 42",
    11: "well " * 3000 + "known", 12: "!!! ---",
}


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def times(text, *phrase):
    w = tokens(text)
    return sum(tuple(w[i : i + len(phrase)]) == phrase for i in range(len(w)))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    place = f"file://{tmp_path_factory.mktemp('words')}/index"
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in TEXTS.items()], "id int, text string, position int, term string")
    fulltext.write_postings(fulltext.postings(docs, "id", "text", 8), place, 8)
    return docs, spark.read.parquet(place)


def ask(index, query):
    docs, stored = index
    return {r.id: r.score for r in fulltext.found(stored, query, docs, 8).collect()}


def want(holds, score=lambda t: 0):
    return {i: score(t) for i, t in TEXTS.items() if holds(t)}


def test_words_phrases_and_prefixes(index):
    has = lambda *w: lambda t: times(t, *w)
    for query, phrase in (("cat", ("cat",)), ('"the cat"', ("the", "cat")), ("well-known", ("well", "known")), ("New.York", ("new", "york")), ("été", ("été",)), ('"a a"', ("a", "a")), ('"a a a"', ("a", "a", "a")), ("東京", ("東京",)), ("snake_case", ("snake", "case"))):
        assert ask(index, query) == want(has(*phrase), has(*phrase)), query
    prefix = lambda p: lambda t: sum(w.startswith(p) for w in tokens(t))
    for query, p in (("con*", "con"), ("n*", "n"), ("É*", "é"), ("4*", "4")):
        assert ask(index, query) == want(prefix(p), prefix(p)), query


def test_booleans(index):
    c = lambda w: lambda t: times(t, *w.split())
    cat, the, well, known, a = c("cat"), c("the"), c("well"), c("known"), c("a")
    assert ask(index, "the cat") == ask(index, "the AND cat") == want(lambda t: the(t) and cat(t), lambda t: the(t) + cat(t))
    assert ask(index, "cat OR known -a") == want(lambda t: cat(t) or known(t) and not a(t), lambda t: cat(t) + known(t))
    assert ask(index, "(cat OR known) -a") == want(lambda t: (cat(t) or known(t)) and not a(t), lambda t: cat(t) + known(t))
    assert ask(index, "NOT (a OR well-known)") == want(lambda t: not a(t) and not times(t, "well", "known"))
    assert ask(index, "well NOT NOT known") == want(lambda t: well(t) and known(t), lambda t: well(t) + known(t))
    assert ask(index, "cat !!! the") == ask(index, "cat the") and ask(index, "nothing") == {}


@pytest.mark.parametrize("query", ["", "!!!", '"open', "(cat", "cat)", "OR cat", "cat OR", "NOT", "cat AND", "-"])
def test_what_is_no_query_says_so(query):
    with pytest.raises(ValueError):
        fulltext.parse(query)


def test_absence_needs_the_table_and_reads_only_its_words(index):
    docs, stored = index
    with pytest.raises(ValueError):
        fulltext.found(stored, "NOT cat", None, 8)
    plan = fulltext.found(stored, "the cat", None, 8)._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan and "PartitionFilters: [bucket#" in plan
    assert "StringStartsWith(term" in fulltext.found(stored, "conc*", None, 8)._jdf.queryExecution().executedPlan().toString()


def test_scores_of_texts_and_of_the_index_agree(index):
    docs, stored = index
    for words in (["the", "Cat"], ["nothing"], ["cat", "cat"], ["a b", "x"], ["well-known", "well"], ["a-a"], ["!!!"], ["new york", "york-new"]):
        assert sorted(map(tuple, fulltext.indexed_scores(stored, words, 8).collect())) == sorted(map(tuple, search.word_scores(docs, "id", "text", words).collect())), words


def test_rows_that_repeat_and_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "b a")], "id int, text string")
    fulltext.write_postings(fulltext.postings(docs, "id", "text"), str(tmp_path / "i"))
    assert {r.id: r.score for r in fulltext.found(spark.read.parquet(str(tmp_path / "i")), '"a b"').collect()} == {1: 2, None: 1}
    empty = fulltext.postings(docs.limit(0), "id", "text")
    assert fulltext.found(empty, "a b").collect() == [] and fulltext.indexed_scores(empty, ["a"]).collect() == []


def test_what_is_stored_has_no_row_for_each_occurrence(spark, tmp_path):
    """Runs of ids near each other take two bytes an id and a position; ids far apart, negative ones, texts as ids and positions over 32,767 lose nothing."""
    far = [-(1 << 63), -5, 0, 1, 40_000, 1 << 40, (1 << 63) - 1]
    for kind, ids in (("long", far), ("string", ["a", "b", None])):
        docs = spark.createDataFrame([(i, "x y x " * 3) for i in ids] + [(ids[1], "y " * 33_000 + "x y")], f"id {kind}, text string").coalesce(1)
        plain, place = fulltext.postings(docs, "id", "text"), str(tmp_path / kind)
        fulltext.write_postings(plain, place)
        stored = spark.read.parquet(place)
        assert stored.count() < 20 < plain.count()
        of = lambda df: sorted((r.term, str(r.id), r.position) for r in fulltext.spelled_out(df).collect())
        assert of(stored) == of(plain)
    near = spark.createDataFrame([(1000 + i, "x y x") for i in range(50)], "id int, text string").coalesce(1)
    made = fulltext.runs(fulltext.postings(near, "id", "text"))
    assert sorted((r.term, r.base, len(r.near), r.ids) for r in made.collect()) == [("x", 1000, 100, None), ("y", 1000, 50, None)]
    assert fulltext.found(made, '"x y x"').count() == 50
