"""How far the sources of a language lie apart in their words, and which words do it.

Each task counts the terms of its texts in a byte trie whose leaves hold a counter for each (language, source). Tries are laid out by
their leaves in byte order, which for UTF-8 is the order of code points: what a radix trie's inner nodes say, the bytes that
neighbours share, follows from that order, and building one is sorting. Tries merge by ranges of prefixes: Spark's range
partitioning brings the leaves of all tasks that lie in a range to one task in byte order, where one walk adds up equal leaves and
drops the terms that too few documents have. What remains is stored as sub-tries with front-coded leaves.

A second walk over the sub-tries streams what all pairs of sources differ by, a sum for each pair, and the candidates for each
group's terms, of which a task keeps the first few; the walk's order settles ties. All figures are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm._shared import small_batches, written

MIN_DOCUMENTS, TOP_TERMS, SCALE_STEPS = 10, 10, 3
#: Sources of a language that are compared with as many others at a time.
TILE = 256
#: Counters after which a task adds up what it has, and after which it hands its trie over and begins another.
COMPACT, HAND_OVER = 2_000_000, 1_000_000
#: Leaves and counters of a stored sub-trie, counters of all that a task builds at a time, and rows of a batch handed to Spark.
LEAVES, COUNTERS, BUILDING, ROWS = 4096, 1 << 16, 1 << 18, 1 << 15
#: Bytes of a text that are taken up at a time where one is longer.
PIECE = 4 << 20

_LEAF = pa.schema([("term", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
LEAF = "term string, lang string, source string, n bigint, docs bigint"
_SUBTRIE = pa.schema([("lang", pa.string()), ("shared", pa.list_(pa.int32())), ("suffixes", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("sources", pa.list_(pa.string())), ("tally", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
SUBTRIE = "lang string, shared array<int>, suffixes array<binary>, sizes array<int>, sources array<string>, tally array<bigint>, at array<int>, counts array<bigint>"
PART = "lang string, source string, part string, item string, value bigint"


def _byte_map() -> np.ndarray:
    """What a byte counts as: a-z for letters of ASCII, itself for a part of any other character, 0 for what separates terms."""
    of = np.zeros(256, dtype=np.uint8)
    of[0x80:] = np.arange(0x80, 0x100)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", dtype=np.uint8)
    of[letters] = letters
    of[letters - 32] = letters
    return of


_BYTES = _byte_map()


def terms_of(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts that lie one after another in data, text k from starts[k] on: all in order, and the number of each one's text."""
    low = _BYTES[data]
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = starts[starts < len(data)]
    first[begins] = inside[begins]  # a text's end ends a term too
    places = np.flatnonzero(first)
    kept = low[inside]
    if len(places) == 0:
        return pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
    before = np.cumsum(inside)
    offsets = np.append(before[places] - 1, len(kept)).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(places), pa.py_buffer(offsets), pa.py_buffer(kept))
    return terms, np.searchsorted(starts, places, side="right") - 1


def _summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of values by key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    return key[at], *(np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values)


class Trie:
    """Counts of terms by group (language, source): leaves are added slice by slice and read in byte order."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.counters = 0

    def add(self, terms: pa.Array, text: np.ndarray, group: np.ndarray) -> None:
        """Terms and the number of each one's text, of which group names the group."""
        if len(terms):
            coded = terms.dictionary_encode()
            code, many = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            key, n = _summed(text * many + code, np.ones(len(code), dtype=np.int64))
            self._take(coded.dictionary, key % many, group[key // many], n, np.ones(len(key), dtype=np.int64))

    def add_text(self, data: np.ndarray, group: int) -> None:
        """One long text, piece by piece."""
        own, start = Trie(), 0
        while start < len(data):
            end = min(len(data), start + PIECE)
            while end < len(data) and _BYTES[data[end]] != 0:  # goes on to the end of the term
                stop = np.flatnonzero(_BYTES[data[end : end + PIECE]] == 0)
                end = end + int(stop[0]) if len(stop) else min(len(data), end + PIECE)
            terms, text = terms_of(data[start:end], np.zeros(1, dtype=np.int64))
            own.add(terms, text, np.zeros(1, dtype=np.int64))
            start = end
        if own.parts:
            names, code, _, n, _ = own.compact()
            self._take(names, code, np.full(len(code), group), n, np.ones(len(code), dtype=np.int64))

    def _take(self, names: pa.Array, code: np.ndarray, group: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        wide = len(self.groups) + 1
        key, n, docs = _summed(code * wide + group, n, docs)
        self.parts.append((names, key // wide, key % wide, n, docs))
        self.counters += len(key)

    def number(self, lang: str, source: str) -> int:
        return self.groups.setdefault((lang, source), len(self.groups))

    def compact(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Adds up what was taken: names, and code, group, n, docs of each counter."""
        if len(self.parts) > 1:
            chunks = pa.chunked_array([pa.DictionaryArray.from_arrays(pa.array(p[1].astype(np.int32)), p[0]) for p in self.parts]).unify_dictionaries()
            code = np.concatenate([c.indices.to_numpy() for c in chunks.chunks]).astype(np.int64)
            group, n, docs = (np.concatenate([p[k] for p in self.parts]) for k in (2, 3, 4))
            self.parts, self.counters = [], 0
            self._take(chunks.chunk(0).dictionary, code, group, n, docs)
        return self.parts[0]

    def leaves(self) -> Iterator[pa.RecordBatch]:
        """All counters, terms in byte order; the trie is empty then."""
        if not self.parts:
            return
        names, code, group, n, docs = self.compact()
        order = pc.array_sort_indices(names).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        by = np.lexsort((group, rank[code]))
        langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
        for k in range(0, len(by), ROWS):
            some = by[k : k + ROWS]
            of = pa.array(group[some])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(code[some])), langs.take(of), sources.take(of), pa.array(n[some]), pa.array(docs[some])], schema=_LEAF)
        self.__init__()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (lang, source, text in bytes) to leaves."""
    trie = Trie()
    for batch in batches:
        if not batch.num_rows:
            continue
        lang, source, text = batch.columns
        group = np.array([trie.number(a, b) for a, b in zip(lang.to_pylist(), source.to_pylist(), strict=True)], dtype=np.int64)
        text = text.cast(pa.large_binary()) if text.null_count == 0 else pc.fill_null(text, b"").cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
        first = 0
        while first < len(text):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1)
            own = data[offsets[first] : offsets[last]]
            if len(own) > PIECE:
                trie.add_text(own, int(group[first]))
            else:
                terms, of = terms_of(own, offsets[first:last] - offsets[first])
                trie.add(terms, of, group[first:last])
            first = last
        if trie.counters > COMPACT:
            trie.compact()
            if trie.counters > HAND_OVER:
                yield from trie.leaves()
    yield from trie.leaves()


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before in one of the columns; the first row does."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        if len(c) > 1:
            out[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return out


def _added(rows: pa.Table) -> pa.Table:
    """Rows in order with equal (term, lang, source) added up."""
    at = np.flatnonzero(_changes(*(rows.column(c).combine_chunks() for c in ("term", "lang", "source"))))
    if len(at) == rows.num_rows:
        return rows
    sums = [pa.array(np.add.reduceat(rows.column(c).to_numpy(), at)) for c in ("n", "docs")]
    return pa.table([*(rows.column(c).take(pa.array(at)) for c in ("term", "lang", "source")), *sums], schema=_LEAF)


class _Shoots:
    """Sub-tries of each language that grow leaf by leaf."""

    def __init__(self) -> None:
        self.held: dict[str, list[pa.Table]] = {}
        self.counters: dict[str, int] = {}

    def take(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Added-up rows of kept terms in byte order."""
        lang = rows.column("lang").combine_chunks().dictionary_encode()
        code = lang.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        ends = np.cumsum(np.bincount(code, minlength=len(lang.dictionary)))
        for k, name in enumerate(lang.dictionary.to_pylist()):
            own = rows.take(pa.array(order[ends[k - 1] if k else 0 : ends[k]]))
            self.held.setdefault(name, []).append(own)
            self.counters[name] = self.counters.get(name, 0) + own.num_rows
            if self.counters[name] > COUNTERS:
                yield from self.cut(name)
        if sum(self.counters.values()) > BUILDING:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        for name in list(self.held):
            yield from self.cut(name)

    def cut(self, lang: str) -> Iterator[pa.RecordBatch]:
        """What is held of a language, as sub-tries of at most LEAVES leaves and about COUNTERS counters."""
        rows = pa.concat_tables(self.held.pop(lang)).combine_chunks()
        del self.counters[lang]
        at = np.append(np.flatnonzero(_changes(rows.column("term").combine_chunks())), rows.num_rows)
        first = 0
        while first < len(at) - 1:
            last = min(len(at) - 1, first + LEAVES, max(first + 1, int(np.searchsorted(at, at[first] + COUNTERS))))
            own = rows.slice(at[first], at[last] - at[first])
            yield _subtrie(lang, own, at[first : last + 1] - at[first])
            first = last


def _subtrie(lang: str, rows: pa.Table, at: np.ndarray) -> pa.RecordBatch:
    shared, suffixes, before = [], [], b""
    for term in rows.column("term").take(pa.array(at[:-1])).to_pylist():
        term = term.encode()
        same = 0
        for a, b in zip(before, term, strict=False):
            if a != b:
                break
            same += 1
        shared.append(same)
        suffixes.append(term[same:])
        before = term
    source = rows.column("source").combine_chunks().dictionary_encode()
    counts, of = rows.column("n").to_numpy(), source.indices.to_numpy()
    tally = np.zeros(len(source.dictionary), dtype=np.int64)
    np.add.at(tally, of, counts)
    return pa.RecordBatch.from_arrays([pa.array([x], kind.type) for x, kind in zip((lang, shared, suffixes, np.diff(at), source.dictionary.to_pylist(), tally, of, counts), _SUBTRIE, strict=True)], schema=_SUBTRIE)


def _merge(least: int):
    """Leaves of a range in order of (term, lang, source) to sub-tries of the terms with at least that many documents."""

    def kept(rows: pa.Table) -> pa.Table:
        at = np.flatnonzero(_changes(rows.column("term").combine_chunks(), rows.column("lang").combine_chunks()))
        docs = np.add.reduceat(rows.column("docs").to_numpy(), at)
        return rows.filter(pa.array(np.repeat(docs >= least, np.diff(np.append(at, rows.num_rows)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shoots, open_ = _Shoots(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]).cast(_LEAF)
            rows = _added(pa.concat_tables([open_, rows]).combine_chunks() if open_ is not None else rows)
            last = int(np.flatnonzero(_changes(rows.column("term").combine_chunks(), rows.column("lang").combine_chunks()))[-1])
            open_ = rows.slice(last)  # may go on in the next batch
            if last:
                yield from shoots.take(kept(rows.slice(0, last).combine_chunks()))
        if open_ is not None:
            yield from shoots.take(kept(open_.combine_chunks()))
        yield from shoots.rest()

    return run


def subtries(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = MIN_DOCUMENTS) -> DataFrame:
    """The merged trie of all terms that at least that many documents of a language have, as stored sub-tries.

    Columns: lang, shared and suffixes (front-coded terms in byte order), sizes (counters of each term), sources, tally (their sums in this
    sub-trie), at and counts (the counters: place in sources, occurrences).
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("")).alias("lang"), F.coalesce(docs[source].cast("string"), F.lit("")).alias("source"), docs[text].cast("binary").alias("text"))
    leaves = written(rows.mapInArrow(_count, LEAF), "leaves")
    ranged = leaves.repartitionByRange("term", "lang").sortWithinPartitions("term", "lang", "source")
    return written(ranged.mapInArrow(_merge(least), SUBTRIE), "subtries")


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10 ** 9 * count / whole) for count <= whole, three digits at a time: exact for whole below 9 * 10 ** 15."""
    out, rest = np.zeros(np.broadcast(count, whole).shape, dtype=np.int64), count
    for _ in range(SCALE_STEPS):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def _walk(top: int):
    """Sub-tries, each beside two tiles of its language's sources, to sums of pairs and candidates."""

    def emit(sums: dict, best: dict) -> Iterator[pa.RecordBatch]:
        for (lang, a, b), value in sums.items():
            for i, x in enumerate(a):
                others = [j for j, y in enumerate(b) if y != x]
                if not others:
                    continue
                items, values = [b[j] for j in others], [int(value[i, j]) for j in others]
                yield from _rows(lang, [x] * len(items), "pair", items, values)
                if a != b:
                    yield from _rows(lang, items, "pair", [x] * len(items), values)
        for (lang, x), found in best.items():
            yield from _rows(lang, [x] * len(found), "term", [t.decode() for _, t in found], [-v for v, _ in found])
        sums.clear()
        best.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        best: dict[tuple[str, str], list[tuple[int, bytes]]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                terms, before = [], b""
                for same, rest in zip(r["shared"], r["suffixes"], strict=True):
                    before = before[:same] + rest
                    terms.append(before)
                leaf, at = np.repeat(np.arange(len(terms)), r["sizes"]), np.array(r["at"], dtype=np.int64)
                n, kept = np.array(r["counts"], dtype=np.int64), r["terms"]

                def counted(tile: list[str], at=at, leaf=leaf, n=n, own=r["sources"], many=len(terms)) -> np.ndarray:
                    place = {s: k for k, s in enumerate(tile)}
                    column = np.array([place.get(s, -1) for s in own], dtype=np.int64)[at]
                    out = np.zeros((many, len(tile)), dtype=np.int64)
                    out[leaf[column >= 0], column[column >= 0]] = n[column >= 0]
                    return out

                tiles = [(counted(r[f"{x}_sources"]), np.array(r[f"{x}_n"], dtype=np.int64)) for x in "ab"]
                p, q = (shares(c + 2, own + 2 * kept) for c, own in tiles)
                key = (r["lang"], tuple(r["a_sources"]), tuple(r["b_sources"]))
                total = sums.setdefault(key, np.zeros((p.shape[1], q.shape[1]), dtype=np.int64))
                for i in range(p.shape[1]):
                    one = p[:, i : i + 1]
                    total[i] += ((one - q) * (one - q) // (one + q)).sum(axis=0)
                if r["a"] == r["b"]:
                    whole = np.zeros(len(terms), dtype=np.int64)
                    np.add.at(whole, leaf, n)
                    base = shares(whole + 2, np.int64(r["lang_n"] + 2 * kept))
                    for i, x in enumerate(r["a_sources"]):
                        there = np.flatnonzero((tiles[0][0][:, i] > 0) & (p[:, i] > base))
                        gap = p[there, i] - base[there]
                        value = gap * gap // (p[there, i] + base[there])
                        first = np.lexsort((there, -value))[:top]
                        found = [(-int(value[k]), terms[there[k]]) for k in first]
                        best[r["lang"], x] = sorted(best.get((r["lang"], x), []) + found)[:top]
                if len(sums) > 64 or len(best) > 1 << 14:
                    yield from emit(sums, best)
        yield from emit(sums, best)

    return run


_PART = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _rows(lang: str, source: list[str], part: str, item: list[str], value: list[int]) -> Iterator[pa.RecordBatch]:
    if source:
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(source)), pa.array(source), pa.array([part] * len(source)), pa.array(item), pa.array(value, pa.int64())], schema=_PART)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = MIN_DOCUMENTS, top: int = TOP_TERMS, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source) every other source of the language by how far it lies from it
    (part pair), and the top terms that it has more of than the language (part term).

    Terms are runs of ASCII letters and of characters beyond ASCII, A-Z in lower case; a language's terms are those that at least `least` of its
    documents have, repeated rows counting each by itself. With count occurrences of a term, N of all kept terms and V kept terms a group
    has p = 1 + floor(10 ** 9 * (count + 2) / (N + 2 * V)), the language q alike; two differ by floor((p - q) ** 2 / (p + q)). A group whose
    texts have no kept term is a group still; without kept terms all pairs of a language differ by 0. Null text, lang and source are
    the empty string. An empty table gives an empty one; other columns are ignored, texts are taken whole. Exact while a language has
    fewer than 9 * 10 ** 15 occurrences.

    A frequent term brings one row for each task and group, not for each occurrence. A language's sources are compared in tiles, so that a
    task's table of sums has tile * tile entries; the result itself has a row for each pair of sources.
    """
    groups = written(docs.groupBy(F.coalesce(docs[lang].cast("string"), F.lit("")).alias("lang"), F.coalesce(docs[source].cast("string"), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("docs")), "groups")
    tries = subtries(docs, lang, source, text, least)
    own = tries.select("lang", F.explode(F.arrays_zip("sources", "tally")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.tally").alias("n"))
    sizes = tries.groupBy("lang").agg(F.sum(F.size("sizes")).cast("bigint").alias("terms"), F.sum(F.aggregate("tally", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("lang_n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    known = groups.select("lang", "source", F.floor(place / tile).cast("int").alias("tile")).join(own, ["lang", "source"], "left").join(sizes, "lang")
    tiles = known.groupBy("lang", "tile", "terms", "lang_n").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("own"))
    side = lambda x: [F.col("tile").alias(x), F.col("own.source").alias(f"{x}_sources"), F.col("own.n").alias(f"{x}_n")]
    both = tiles.select("lang", "terms", "lang_n", *side("a")).join(tiles.select("lang", *side("b")), "lang").where("a <= b")
    walked = tries.join(written(both, "tiles"), "lang").mapInArrow(_walk(top), PART)
    every = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    rows = walked.unionByName(every.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("bigint").alias("value")))
    rows = rows.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    return rows.select("lang", "source", "part", "item", "value", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


def oracle() -> str:
    """The same rows in DuckDB with integers of 128 bits."""
    return f"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
o AS (SELECT lang, source, doc, unnest(w) AS term FROM d),
g AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= {MIN_DOCUMENTS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
ln AS (SELECT lang, term, sum(c) AS c, sum(sum(c)) OVER (PARTITION BY lang) AS n FROM c GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 2)) // (n + 2 * v) AS q FROM ln JOIN v USING (lang)),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(gn.n, 0) + 2 * v.v) AS p
  FROM g JOIN kept ON g.lang = kept.lang JOIN v ON v.lang = g.lang LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM parts)
WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
