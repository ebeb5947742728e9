"""Full text by positions: a stored index of where each word stands, and queries of words, phrases, prefixes, AND, OR and NOT over it.

The index has a row for each occurrence: term, id, position, and bucket, a hash of the term's first two characters, by which it is stored
in folders. Stored and moved are runs: a term with the ids and positions of some texts, so that the word itself is there once for all of them.
A query reads the folders and row groups of its words. A phrase is met where its words' positions, each less its place in the
phrase, agree: one grouping by text and start, however long the phrase and however frequent its words. All parts of a query are found
together and their counts are set side by side for each text, so that booleans cost no join.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake.functions import texts

BUCKETS, LEADING = 64, 2
#: Occurrences that a task makes runs of at a time, and of a run at most.
GATHERED, RUN = 1 << 20, 1 << 14
_PIECE = re.compile(r"\s*(\(|\)|-(?=[\w\"(])|\"[^\"]*\"|[^\s()\"]+)")


def words_of(text: str) -> tuple[str, ...]:
    """The words of a piece of a query, as texts have them: runs of letters and digits, in lower case."""
    return tuple(re.findall(r"[^\W_]+", text.lower()))


# --- index ---


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.crc32(F.substring(term, 1, LEADING).cast("binary")), F.lit(buckets)).cast("int")


def postings(df: DataFrame, key: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """The index of full text: term, id, position (from 0), bucket. Null texts and texts without a word have no row; repeated rows have theirs again."""
    terms = df.select(F.col(key).alias("id"), F.posexplode(texts.tokens(F.col(text))).alias("position", "term"))
    return terms.select("term", "id", "position", bucket_of(F.col("term"), buckets).alias("bucket"))


def runs(index: DataFrame) -> DataFrame:
    """postings() as runs: a row for each term of GATHERED occurrences of a task, and one more for each RUN of them: bucket, term, ids, positions.

    Where ids are whole numbers, most runs have base, near and at instead: the least id, how far behind it each one is, and positions, in two bytes each.
    """
    kind = index.schema["id"].dataType
    whole = isinstance(kind, (T.ShortType, T.IntegerType, T.LongType))
    own = T.StructType().add("bucket", T.IntegerType()).add("term", T.StringType()).add("ids", T.ArrayType(kind)).add("positions", T.ArrayType(T.IntegerType()))
    out = own.add("base", kind).add("near", T.ArrayType(T.ShortType())).add("at", T.ArrayType(T.ShortType())) if whole else own

    def packed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        words = rows.column("term").combine_chunks().dictionary_encode()
        code = words.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        size = np.diff(np.r_[first, len(code)])
        many = -(-size // RUN)
        first = np.repeat(first, many) + RUN * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        size = np.diff(np.r_[first, len(code)])
        ids, places, buckets = (rows.column(c).take(pa.array(order)).combine_chunks() for c in ("id", "position", "bucket"))
        small = np.zeros(len(first), dtype=bool)
        if whole and not ids.null_count:
            value, place = ids.to_numpy(), places.to_numpy()
            base = np.minimum.reduceat(value, first)
            small = (np.maximum.reduceat(value, first).astype(float) - base.astype(float) < 30_000) & (np.maximum.reduceat(place, first) < 1 << 15)
        for near in (True, False):
            some = np.flatnonzero(small == near)
            if not len(some):
                continue
            inside = np.flatnonzero(np.repeat(small == near, size))
            ends = pa.array(np.r_[0, np.cumsum(size[some])], pa.int32())
            listed = lambda x: pa.ListArray.from_arrays(ends, x)  # noqa: B023, E731
            columns = {"bucket": buckets.take(pa.array(first[some])), "term": words.dictionary.take(pa.array(code[first[some]]))}
            if near:
                far = value[inside] - np.repeat(base[some], size[some])
                columns |= {"base": pa.array(base[some]), "near": listed(pa.array(far.astype(np.int16))), "at": listed(pa.array(place[inside].astype(np.int16)))}
            else:
                columns |= {"ids": listed(ids.take(pa.array(inside))), "positions": listed(places.take(pa.array(inside)))}
            kinds = {"ids": pa.list_(ids.type), "positions": pa.list_(pa.int32()), "base": ids.type, "near": pa.list_(pa.int16()), "at": pa.list_(pa.int16())}
            yield pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(len(some), kinds[c]) for c in out.names], out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                count += b.num_rows
            if count >= GATHERED:
                yield from packed(pa.Table.from_batches(held))
                held, count = [], 0
        if held:
            yield from packed(pa.Table.from_batches(held))

    return index.select("bucket", "term", "id", "position").mapInArrow(run, out)


def spelled_out(rows: DataFrame) -> DataFrame:
    """term, id, position of runs(), or of postings() as they are."""
    if "ids" not in rows.columns:
        return rows.select("term", "id", "position")
    pairs = F.arrays_zip(F.col("ids").alias("id"), F.col("positions").alias("position"))
    if "near" in rows.columns:
        kind = rows.schema["base"].dataType
        ids = F.transform("near", lambda x: (F.col("base") + x).cast(kind))
        pairs = F.when(F.col("near").isNotNull(), F.arrays_zip(ids.alias("id"), F.col("at").cast("array<int>").alias("position"))).otherwise(pairs)
    return rows.select("term", F.explode(pairs).alias("_p")).select("term", "_p.*")


def write_postings(index: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Stores postings() as runs by bucket, sorted by term, so that a search reads the row groups of its words and no text.

    As many tasks write as the session has shuffle partitions (a bucket at least): a bucket's runs are dealt by their first id, so that a frequent word is many
    tasks' work.
    """
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = -(-parts // buckets)
    made = runs(index)
    seed = F.xxhash64(F.get("ids", F.lit(0)), *(["base"] if "base" in made.columns else []))
    dealt = made.repartition(buckets * salts, "bucket", F.pmod(seed, F.lit(salts))) if salts > 1 else made.repartition("bucket")
    dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


# --- queries ---


@dataclass
class Query:
    """What a text must have: parts are ("word", w), ("prefix", w) or ("phrase", w, w, ...), and holds says of counts of them, by number, whether a text is found."""

    parts: list[tuple[str, ...]] = field(default_factory=list)
    holds: Callable[[list[Column]], Column] = lambda _: F.lit(True)
    plain: Callable[[list[bool]], bool] = lambda _: True
    wanted: set[int] = field(default_factory=set)

    @property
    def by_absence(self) -> bool:
        """Whether a text without any of the parts is found."""
        return self.plain([False] * len(self.parts))


def parse(text: str) -> Query:
    """Words side by side must all be there (AND may stand between them), OR binds less than that, NOT or a minus sign turns what follows into its opposite.

    "in quotes" is a phrase, and so is a word that holds a hyphen or another sign (well-known); word* is a prefix. Pieces without a letter or
    digit say nothing. AND, OR and NOT are written in capitals.
    """
    pieces, at, out = [], 0, Query()
    while m := _PIECE.match(text, at):
        pieces.append(m[1])
        at = m.end()
    if text[at:].strip():
        raise ValueError(f"a quote has no end: {text[at:].strip()[:40]}")
    place = 0

    def leaf(piece: str, positive: bool):
        quoted = piece.startswith('"')
        words = words_of(piece)
        if not words:
            return None
        kind = "prefix" if not quoted and piece.endswith("*") and len(words) == 1 else "phrase" if len(words) > 1 else "word"
        part = (kind, *words)
        if part not in out.parts:
            out.parts.append(part)
        n = out.parts.index(part)
        if positive:
            out.wanted.add(n)
        return (lambda c: c[n] > 0), (lambda c: c[n])

    def unary(positive: bool):
        nonlocal place
        piece = pieces[place]
        place += 1
        if piece in ("NOT", "-"):
            if place == len(pieces):
                raise ValueError(f"nothing stands behind {piece}")
            inner = unary(not positive)
            return inner and ((lambda c: ~inner[0](c)), (lambda c: not inner[1](c)))
        if piece == "(":
            inner = either(positive)
            if place == len(pieces):
                raise ValueError("a bracket is not closed")
            place += 1
            return inner
        if piece in (")", "AND", "OR"):
            raise ValueError(f"{piece} stands where a word should")
        return leaf(piece, positive)

    def joined(found: list, both: bool):
        found = [f for f in found if f]
        if len(found) < 2:
            return found[0] if found else None

        def columns(c):
            made = found[0][0](c)
            for f in found[1:]:
                made = made & f[0](c) if both else made | f[0](c)
            return made

        return columns, lambda c: (all if both else any)(f[1](c) for f in found)

    def every(positive: bool):
        nonlocal place
        found = [unary(positive)]
        while place < len(pieces) and pieces[place] not in ("OR", ")"):
            place += pieces[place] == "AND"
            if place == len(pieces):
                raise ValueError("nothing stands behind AND")
            found.append(unary(positive))
        return joined(found, True)

    def either(positive: bool):
        nonlocal place
        found = [every(positive)]
        while place < len(pieces) and pieces[place] == "OR":
            place += 1
            if place == len(pieces):
                raise ValueError("nothing stands behind OR")
            found.append(every(positive))
        return joined(found, False)

    if pieces:
        made = either(True)
        if place < len(pieces):
            raise ValueError("a bracket is closed that was not opened")
        if made:
            out.holds, out.plain = made
    if not out.parts:
        raise ValueError("a query needs a word")
    return out


def part_counts(index: DataFrame, parts: list[tuple[str, ...]], buckets: int = BUCKETS) -> DataFrame:
    """part (its number), id, times: how often each part stands in each text that has it. Only folders and row groups of the parts' words are read.

    index is what write_postings() has stored, or postings().
    """
    of = lambda w: zlib.crc32(w[:LEADING].encode()) % buckets
    terms = sorted({w for kind, *words in parts for w in words if kind != "prefix"})
    starts = [w for kind, w, *_ in parts if kind == "prefix"]
    wanted = F.col("term").isin(terms) if terms else F.lit(False)
    for w in starts:
        wanted = wanted | F.col("term").startswith(w)
    folders = {of(w) for w in terms} | {of(w) for w in starts if len(w) >= LEADING}
    rows = index.where(wanted)
    if all(len(w) >= LEADING for w in starts):
        rows = rows.where(F.col("bucket").isin(sorted(folders)))
    rows = spelled_out(rows)
    uses = [F.when(F.col("term").startswith(words[0]) if kind == "prefix" else F.col("term") == w, F.struct(F.lit(n).alias("part"), F.lit(k).alias("k"))) for n, (kind, *words) in enumerate(parts) for k, w in enumerate(words)]
    used = rows.select("id", "position", F.explode(F.array_compact(F.array(*uses))).alias("use"))
    sizes = F.array(*(F.lit(len(words)) for _, *words in parts))
    size = F.get(sizes, F.col("use.part"))
    alone = used.where(size == 1).groupBy("use.part", "id").agg(F.count(F.lit(1)).alias("times"))
    if max(len(words) for _, *words in parts) == 1:
        return alone
    longest = max(len(words) for _, *words in parts)
    places = [F.sum(F.when(F.col("use.k") == k, 1).otherwise(0)).alias(f"_{k}") for k in range(longest)]
    met = used.where(size > 1).groupBy("use.part", "id", (F.col("position") - F.col("use.k")).alias("start")).agg(*places)
    whole = met.select("part", "id", F.array_min(F.slice(F.array(*(F.col(f"_{k}") for k in range(longest))), F.lit(1), F.get(sizes, F.col("part")))).alias("times"))
    whole = whole.where("times > 0").groupBy("part", "id").agg(F.sum("times").alias("times"))
    return alone.unionByName(whole)


def found(index: DataFrame, query: str | Query, ids: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """id and score of the texts that a query finds; the score counts occurrences of the parts that are asked for (not of what must be absent).

    A query that also finds texts with none of its words (NOT x) needs ids, a table with the column id of all texts.
    """
    q = parse(query) if isinstance(query, str) else query
    counts = part_counts(index, q.parts, buckets)
    times = [f"times_{n}" for n in range(len(q.parts))]
    rows = counts.groupBy("id").agg(*(F.sum(F.when(F.col("part") == n, F.col("times")).otherwise(0)).alias(c) for n, c in enumerate(times)))
    if q.by_absence:
        if ids is None:
            raise ValueError("a query that texts without its words meet needs the table of all ids")
        rows = ids.select("id").distinct().join(rows, "id", "left").fillna(0, times)
    score = F.lit(0)
    for n in sorted(q.wanted):
        score = score + F.col(times[n])
    return rows.where(q.holds([F.col(c) for c in times])).select("id", score.cast("bigint").alias("score"))


def indexed_scores(index: DataFrame, query: list[str], buckets: int = BUCKETS) -> DataFrame:
    """search.word_scores() from the index: how often words of the query occur, for texts with any; a word with a sign inside is a phrase."""
    parts = sorted({w for w in map(words_of, query) if w})
    if not parts:
        own = index.select(F.explode("ids").alias("id")) if "ids" in index.columns else index.select("id")
        return own.select("id", F.lit(0).cast("bigint").alias("score")).limit(0)
    counts = part_counts(index, [("phrase" if len(w) > 1 else "word", *w) for w in parts], buckets)
    return counts.groupBy("id").agg(F.sum("times").alias("score"))
