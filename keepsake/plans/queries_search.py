"""Search by words, by vectors, and both fused; streams over what has arrived."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keepsake.functions import measures, texts
from keepsake.operators import fulltext, graph, search, vectors
from keepsake.plans import api
from keepsake.plans.registry import Book, table
from keepsake.streaming import windows

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
WORDS = ["the", "tion", "moron"]
_PROBE = "[" + ", ".join(f"{((i * 37) % 64 - 31.5) / 32!r}" for i in range(64)) + "]"
PROBE = [((i * 37) % 64 - 31.5) / 32 for i in range(64)]
_FTS = r"(SELECT doc_id AS id, count(*) AS score FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents) WHERE w IN ('the', 'tion', 'moron') GROUP BY 1)"
_COS = f"(SELECT vec_id AS id, label, round(list_sum(list_transform(list_zip(embedding, p), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(p, lambda x: x * x)))), 6) AS score FROM (SELECT *, {_PROBE}::DOUBLE[] AS p FROM embeddings))"


@book.query(f"SELECT id, score FROM {_FTS}")
def fts_term_frequency(spark, d):
    return search.word_scores(table(spark, d, "documents"), "doc_id", "text", WORDS)


@book.query(f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT * FROM {_FTS} ORDER BY score DESC, id LIMIT 5)")
def fts_top5(spark, d):
    return search.top(search.word_scores(table(spark, d, "documents"), "doc_id", "text", WORDS), 5)


@book.query(f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, score FROM {_COS} ORDER BY score DESC, id LIMIT 10)")
def knn_top10(spark, d):
    return search.top(search.vector_scores(table(spark, d, "embeddings"), "vec_id", "embedding", PROBE), 10)


@book.query(f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, score FROM {_COS} WHERE label % 2 = 1 ORDER BY score DESC, id LIMIT 10)")
def knn_of_kind(spark, d):
    own = table(spark, d, "embeddings").where("label % 2 = 1")
    return search.top(search.vector_scores(own, "vec_id", "embedding", PROBE), 10)


@book.query(f"""
WITH f AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM {_FTS}), v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM {_COS})
SELECT coalesce(f.id, v.id) AS id, f.r AS word_rank, v.r AS vector_rank, round(coalesce(0.3::DOUBLE / (60.0::DOUBLE + f.r), 0) + coalesce(0.7::DOUBLE / (60.0::DOUBLE + v.r), 0), 9) AS score FROM f FULL JOIN v ON f.id = v.id""")
def hybrid_rrf(spark, d):
    words = search.ranked(search.word_scores(table(spark, d, "documents"), "doc_id", "text", WORDS))
    near = search.ranked(search.vector_scores(table(spark, d, "embeddings"), "vec_id", "embedding", PROBE))
    return search.fuse(words, near)


@book.query(f"""
WITH f AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM {_FTS}), v AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM {_COS} JOIN documents ON id = doc_id)
SELECT coalesce(f.id, v.id) AS id, f.r AS word_rank, v.r AS vector_rank, round(coalesce(0.3::DOUBLE / (60.0::DOUBLE + f.r), 0) + coalesce(0.7::DOUBLE / (60.0::DOUBLE + v.r), 0), 9) AS score
FROM f FULL JOIN v ON f.id = v.id ORDER BY score DESC, id LIMIT 10""")
def search_knowledge(spark, d):
    """The service's hybrid search, the ten best, over documents with the vectors of the same number."""
    corpus = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")
    return api.search_knowledge(corpus, WORDS, PROBE, 10)


@book.query(f"SELECT id, score FROM {_FTS}")
def fts_indexed(spark, d):
    """The same as fts_term_frequency, from a stored index of postings."""
    return fulltext.indexed_scores(_index(spark, d), WORDS)


def _index(spark, d):
    """The stored positions of all documents' words, as a search reads them."""
    place = _place(spark)
    fulltext.write_postings(fulltext.postings(table(spark, d, "documents"), "doc_id", "text"), place)
    return spark.read.parquet(place)


_TOKENS = r"(SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)"
_AT = "len(list_filter(range(1, len(w) + 1), lambda i: {}))"
_OF_THE = _AT.format("w[i] = 'of' AND w[i + 1] = 'the'")
_COUNT = _AT.format("w[i] = '{}'").format


@book.query(f"SELECT id, {_OF_THE} + {_AT.format("w[i] = 'in' AND w[i + 1] = 'a' AND w[i + 2] = 'the'")} AS score FROM {_TOKENS} WHERE {_OF_THE} > 0 OR {_AT.format("w[i] = 'in' AND w[i + 1] = 'a' AND w[i + 2] = 'the'")} > 0")
def fts_phrase(spark, d):
    return fulltext.found(_index(spark, d), '"of the" OR in-a-the')


@book.query(f"SELECT id, {_COUNT('er')} + {_COUNT('ing')} + {_COUNT('tion')} + {_OF_THE} AS score FROM {_TOKENS} WHERE {_COUNT('er')} > 0 AND ({_COUNT('ing')} > 0 OR {_COUNT('tion')} > 0 AND {_OF_THE} > 0) AND NOT ({_COUNT('moron')} > 0 OR {_COUNT('worthless')} > 0)")
def fts_boolean(spark, d):
    return fulltext.found(_index(spark, d), 'er (ing OR tion "of the") NOT (moron OR worthless)')


@book.query(f"SELECT id, {_AT.format("starts_with(w[i], 'tion')")} + {_AT.format("starts_with(w[i], 'é')")} AS score FROM {_TOKENS} WHERE {_AT.format("starts_with(w[i], 'tion')")} + {_AT.format("starts_with(w[i], 'é')")} > 0 AND {_COUNT('the')} = 0")
def fts_prefix(spark, d):
    return fulltext.found(_index(spark, d), "(tion* OR é*) -the")


@book.query(f"SELECT id, 0 AS score FROM {_TOKENS} WHERE coalesce({_COUNT('the')}, 0) = 0 AND coalesce({_COUNT('der')}, 0) = 0")
def fts_absent(spark, d):
    """Texts without two words: those that the index has no row for are known by the table."""
    return fulltext.found(_index(spark, d), "NOT the NOT der", table(spark, d, "documents").select(F.col("doc_id").alias("id")))


@book.query(f"SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, score FROM {_COS} ORDER BY score DESC, id LIMIT 10)")
def knn_indexed(spark, d):
    """The same as knn_top10, from a stored index whose unread cells are proven to hold nothing as good."""
    place = _place(spark)
    vectors.write_index(table(spark, d, "embeddings"), place)
    return vectors.Index(spark, place).nearest(PROBE, 10)


@book.query()
def knn_probed(spark, d):
    """The ten nearest vectors of every vector whose number is divisible by 20, from as many cells as the index's own sample needs for a recall of 0.95."""
    place, own = _place(spark), table(spark, d, "embeddings")
    vectors.write_index(own, place)
    index = vectors.Index(spark, place)
    return index.search(own.where("vec_id % 20 = 0"), 10, index.calibrated(10, 0.95))


@book.query("""
WITH v AS (SELECT vec_id AS id, embedding AS e, list_transform(embedding, lambda x: x::DOUBLE) AS d FROM embeddings),
u AS (SELECT id, e, d, sqrt(list_sum(list_transform(d, lambda x: x * x))) AS n FROM v)
SELECT a.id, any_value(min_id) AS class_id, count(b.id) AS links
FROM (SELECT *, min(id) OVER (PARTITION BY e) AS min_id FROM u) a LEFT JOIN u b ON a.id <> b.id AND list_inner_product(a.d, b.d) / (a.n * b.n) >= 0.4 GROUP BY a.id""")
def vector_link_counts(spark, d):
    return vectors.link_counts(table(spark, d, "embeddings"), 0.4)


@book.query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS length FROM embeddings")
def vector_lengths(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(measures.dot(v, v)), 5).alias("length"))


@book.query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS tokens FROM documents")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(texts.tokens(F.col("text"))).cast("long").alias("tokens"))


def _place(spark) -> str:
    """A new folder that all executors see, for a stream's state or its result."""
    return f"{graph.shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark, d):
    return windows.read_table_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema)


def _finished(spark, stream, mode):
    return windows.run_to_end(stream, _place(spark), mode, _place(spark))


@book.query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS window_start, count(*) AS rows FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    out = _finished(spark, windows.tumbling(_stream(spark, d), "ts", "1 day", "1 day", ["event_type"]), "complete")
    return out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "rows")


@book.query("SELECT event_type, w AS window_start, count(*) AS rows FROM (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR])::TIMESTAMP AS w FROM events) GROUP BY ALL")
def stream_sliding(spark, d):
    out = _finished(spark, windows.sliding(_stream(spark, d), "ts", "1 day", "1 day", "12 hours", ["event_type"]), "complete")
    return out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "rows")


@book.query("SELECT user_id, min(ts)::TIMESTAMP AS started, count(*) AS visits FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def stream_sessions(spark, d):
    out = _finished(spark, windows.sessions(_stream(spark, d), "ts", "1 day", "30 minutes", "user_id"), "complete")
    return out.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "visits")


@book.query("SELECT user_id, event_type FROM events GROUP BY ALL")
def stream_dedup(spark, d):
    out = _finished(spark, windows.first_of_each(_stream(spark, d), "ts", "3650 days", ["user_id", "event_type"]), "append")
    return out.select("user_id", "event_type")
