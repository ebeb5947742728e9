"""Search: words, vectors, and both fused by reciprocal ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions import measures, texts
from keepsake.operators import fulltext
from keepsake.operators.graph import held

#: Of reciprocal rank fusion: the smoothing constant, and the weights of words and of vectors.
RRF_K, WORD_WEIGHT, VECTOR_WEIGHT = 60, 0.3, 0.7


def word_scores(df: DataFrame, key: str, text: str, query: list[str]) -> DataFrame:
    """key and score: how often words of the query occur, for rows with any. Words are counted where they stand, without a list of all words.

    A word with a sign inside (well-known) is met where its parts follow one another as words, whatever stands between them; one without a letter or digit is left out.
    """
    parts = sorted({w for w in map(fulltext.words_of, query) if w})
    single, phrases = "|".join(w[0] for w in parts if len(w) == 1), [w for w in parts if len(w) > 1]
    if not parts:
        return df.select(F.col(key).alias("id"), F.lit(0).cast("bigint").alias("score")).limit(0)
    end = r"(?![\p{L}\p{N}])"
    # of a phrase only the first word is taken, so that phrases that overlap are all counted
    asked = [f"(?:{single}){end}"] * bool(single) + [rf"{w[0]}(?=[^\p{{L}}\p{{N}}]+{(texts.TOKEN_GAP).join(w[1:])}{end})" for w in phrases]
    found = [F.regexp_count(F.lower(F.col(text)), F.lit(rf"(?<![\p{{L}}\p{{N}}]){x}")) for x in asked]
    return df.select(F.col(key).alias("id"), reduce(lambda a, b: a + b, found).cast("bigint").alias("score")).where("score > 0")


def vector_scores(df: DataFrame, key: str, embedding: str, probe: list[float] | Column) -> DataFrame:
    """key and score: cosine with the probe, rounded to 6 places; rows without a vector are left out."""
    p = probe if isinstance(probe, Column) else F.array(*(F.lit(float(x)) for x in probe))
    return df.where(F.col(embedding).isNotNull()).select(F.col(key).alias("id"), F.round(measures.cosine(F.col(embedding), p), 6).alias("score")).where("score IS NOT NULL")


def top(scores: DataFrame, k: int) -> DataFrame:
    """id, score, rank of the k best; ties go to the smaller id. The plan keeps k rows a task, not a sort of all."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), F.asc("id")))
    return scores.orderBy(F.desc("score"), F.asc("id")).limit(k).withColumn("rank", rank)


#: Rows up to which one task puts a ranking in order.
FEW = 200_000


def ranked(scores: DataFrame) -> DataFrame:
    """id, score, rank of all rows; ties go to the smaller id. Scores are computed once and counted.

    A short ranking is sorted in one task. Of a long one ranges of scores are sorted, each in its task, and how many rows stand before a range is added.
    """
    rows = held(scores.select("id", "score"))
    if rows.count() <= FEW:
        return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("id"))).cast("bigint"))
    place = F.monotonically_increasing_id()  # the partition's number above bit 33, the row's below
    rows = held(rows.repartitionByRange(F.desc("score"), F.asc("id")).sortWithinPartitions(F.desc("score"), F.asc("id")).select("id", "score", place.alias("_place")))
    part = F.shiftright("_place", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_part", part).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return placed.select("id", "score", (F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rank"))


def fuse(words: DataFrame, vectors: DataFrame, k: int = RRF_K, word_weight: float = WORD_WEIGHT, vector_weight: float = VECTOR_WEIGHT) -> DataFrame:
    """id, word_rank, vector_rank, score: weighted reciprocal rank fusion of two ranked lists."""
    part = lambda weight, rank: F.coalesce(F.lit(float(weight)) / (F.lit(float(k)) + F.col(rank)), F.lit(0.0))
    a, b = words.select("id", F.col("rank").alias("word_rank")), vectors.select("id", F.col("rank").alias("vector_rank"))
    return a.join(b, "id", "full_outer").withColumn("score", F.round(part(word_weight, "word_rank") + part(vector_weight, "vector_rank"), 9))
