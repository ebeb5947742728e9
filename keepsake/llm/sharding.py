"""Sharding by weighted rendezvous hashing.

Every (key, shard) pair has a fixed pseudo-random number u in (0, 1); a key goes to the shard with the largest
ln(u) / weight. A shard's numbers don't depend on the other shards, so one more shard takes rows only into itself, each
shard keeping its share in proportion to the weights; nothing else moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm._shared import written

#: Hexadecimal digits of the digest that make the number: 52 bits, exact in a double.
DIGITS = 13
#: Parts of each shard that are numbered apart from each other.
PARTS = 1024
#: Slots of equal rows that are spelled out at a time.
PIECE = 1 << 14


def shard_scores(key: Column, weights: Sequence[float]) -> Column:
    """An array with a struct (score, s) for each shard, s being minus its number. The array is made by one lambda for all shards: spelled out for
    each they would make generated code whose compilation takes more memory than the data.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    name = F.coalesce(key.cast("string"), F.lit("null"))

    def score(weight: Column, s: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat_ws(":", name, s.cast("string"))), 1, DIGITS), 16, 10).cast("bigint")
        return F.struct((F.log((bits + F.lit(0.5)) / F.lit(float(16**DIGITS))) / weight).alias("score"), (-s).alias("s"))

    return F.transform(F.array(*(F.lit(float(w)) for w in weights)), score)


def best_shard(scores: Column, among: int) -> Column:
    """The shard with the largest of the first scores; ties go to the smaller number."""
    return (-F.array_max(F.slice(scores, 1, among))["s"]).cast("int")


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key. A null key counts as the text "null"."""
    return best_shard(shard_scores(key, weights), len(weights))


def part_of(key: Column, size: Column, crc: Column, parts: int) -> Column:
    digest = F.md5(F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("null")), size.cast("string"), crc.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(parts)).cast("int")


def assign_shards(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", parts: int = PARTS, grown_weight: float = 1.0) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length plus 1 (null text: 1, with the checksum of no bytes). grown_shard is the shard when one
    more of grown_weight stands beside the others. slot numbers a shard's rows from 0 without gaps: rows are counted
    by part of the shard, parts start where those before them end, and a row's place in its part follows
    (key, checksum, size). Equal rows are summed before they are numbered, so repeats gather nowhere. Rows with a null
    key share one shard; other columns are ignored; an empty table gives an empty one. The text, of any length, is read once and
    never shuffled: what is known of a row, a few numbers, goes to a table in the shared folder. The table of starts has
    at most (shards * parts) rows, hence the broadcast.
    """
    own = len(weights)
    scores = shard_scores(F.col("doc_id"), [*weights, grown_weight])
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key].alias("doc_id"), (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    same = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")).withColumn("scores", scores)
    same = same.select("doc_id", "size", "text_crc32", "copies", best_shard(F.col("scores"), own).alias("shard"), best_shard(F.col("scores"), own + 1).alias("grown_shard"), part_of(F.col("doc_id"), F.col("size"), F.col("text_crc32"), parts).alias("part"))
    same = written(same, "shards")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = same.groupBy("shard", "part").agg(F.sum("copies").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = same.withColumn("at", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(F.broadcast(starts), ["shard", "part"])
    first = F.col("start") + F.col("at")
    names = ["doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard"]
    pieces = placed.select(*names, "grown_shard", first.alias("first"), (first + F.col("copies") - 1).alias("last"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / PIECE))).alias("piece"))
    begin = F.col("first") + F.col("piece") * PIECE
    return pieces.select("doc_id", "size", "text_crc32", "law", "shard", F.explode(F.sequence(begin, F.least(F.col("last"), begin + PIECE - 1))).alias("slot"), "grown_shard")


def _score_sql(shard: int) -> str:
    return f"ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':{shard}'), 1, {DIGITS}))::BIGINT + 0.5) / {16**DIGITS}.0)"


def oracle(shards: int) -> str:
    """The same rows in DuckDB for equal weights; its checksum runs the CRC's shift register over the bytes."""

    def best(n: int) -> str:
        return f"list_position([{', '.join(_score_sql(s) for s in range(n))}], greatest({', '.join(_score_sql(s) for s in range(n))})) - 1"

    return f"""
WITH tab AS (
  SELECT list(r ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r
    FROM range(256) x(i))),
bytes AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b
  FROM documents),
rows AS (
  SELECT doc_id, size::BIGINT AS size,
         xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
         ({best(shards)})::INT AS shard, ({best(shards + 1)})::INT AS grown_shard
  FROM bytes, tab)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (
         PARTITION BY shard
         ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '/' || size || '/' || text_crc32), 1, 8))::BIGINT % {PARTS}, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard
FROM rows"""
