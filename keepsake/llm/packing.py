"""Packing examples into training sequences as vector bin packing.

An example asks for a vector: tokens, one segment, and tokens that bear loss; a sequence has a limit for each. One
sequence is filled at a time, always with the example that fits and whose demand has the largest dot product with what
is left, each measure in shares of its limit: a sequence that still has much room for tokens but little for segments
takes long examples, and so on. Examples of equal demand are interchangeable, so the choice is made among demands.

Documents longer than a sequence are cut: whole sequences first, the rest is packed. Each task packs what it reads.
Of a conversation only the answers bear loss, so that sequences of instruction data can be full by tokens, by segments or by
loss: pack_conversations() cuts conversations between turns where one of the three would be exceeded, and packs the pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm._shared import row_slices, small_batches, text_slices
from keepsake.llm.bpe import REMEMBERED, word_bpe

#: Tokens, segments and loss-bearing tokens of a sequence at most: of plain text, in which all tokens but a segment's first bear loss, and of
#: instruction data.
LIMITS, TALK_LIMITS = (2048, 256, 2048), (2048, 16, 1024)
#: Roles whose turns bear loss; turns of a conversation that are looked at together, and rows where turns repeat.
ANSWERS, TURNS, HELD = ("assistant",), 64, 4096
END_ID = 1
#: Examples that a task packs together: its memory is bounded, and less than one sequence in hundreds stays unfilled.
WINDOW = 1 << 18
#: Sequences of a task are numbered from its number times this.
PER_TASK = 1 << 36


def pack(demands: np.ndarray, limits: Sequence[int] = LIMITS) -> np.ndarray:
    """The bin of each example, from 0; demands is an array of shape (examples, measures), none above its limit.

    Ties go to the larger demand, by measure. The same demands in the same order give the same bins.
    """
    demands, limits = np.asarray(demands, dtype=np.int64), np.asarray(limits, dtype=np.int64)
    if len(demands) == 0:
        return np.zeros(0, dtype=np.int64)
    if (demands > limits).any() or (demands < 0).any():
        raise ValueError("an example is larger than a sequence")
    kinds, kind = np.unique(-demands, axis=0, return_inverse=True)
    kinds, kind = -kinds, kind.reshape(-1)
    members = np.argsort(kind, kind="stable")
    count = np.bincount(kind, minlength=len(kinds))
    end = np.cumsum(count)
    at = end - count
    shares = kinds / limits
    bins = np.empty(len(demands), dtype=np.int64)
    alive = np.arange(len(kinds))
    left, number, empty = limits.copy(), 0, True
    while len(alive):
        fits = alive[(kinds[alive] <= left).all(axis=1)]
        if not len(fits):
            if empty:
                raise AssertionError("an example that fits nowhere")
            left, number, empty = limits.copy(), number + 1, True
            continue
        k = fits[np.argmax(shares[fits] @ (left / limits))]
        bins[members[at[k]]] = number
        at[k] += 1
        left, empty = left - kinds[k], False
        if at[k] == end[k]:
            alive = alive[alive != k]
    return bins


def placed(demands: np.ndarray, limits: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each example, order by bins, offset of each in that order). What fills a sequence by itself is not searched for."""
    full = (demands[:, 0] == limits[0]) & (demands <= np.asarray(limits)).all(axis=1)
    bins = np.empty(len(demands), dtype=np.int64)
    bins[full] = np.arange(int(full.sum()))
    bins[~full] = pack(demands[~full], limits) + int(full.sum())
    order = np.argsort(bins, kind="stable")
    ordered, sizes = bins[order], demands[order, 0]
    ends = np.cumsum(sizes)
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    return bins, order, ends - sizes - (ends - sizes)[new][np.cumsum(new) - 1]


def loss_tokens(length: np.ndarray) -> np.ndarray:
    """Of a piece of plain text every token but the first bears loss: nothing stands before that one."""
    return length - 1


def pack_documents(docs: DataFrame, path: str, limits: Sequence[int] = LIMITS, end_id: int = END_ID, key: str = "doc_id", text: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and end_id (null and empty texts: end_id alone). Pieces lie in a sequence in the order in
    which they were read. remembered bounds a worker's dictionary of runs. Null or repeated keys pass through, other columns are left out, an empty table gives an empty
    one. Nothing is shuffled; a task that runs again reads the same rows and so numbers the same sequences.
    """
    most = int(limits[0])
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path, remembered)
        end = end_id.to_bytes(4, "little")
        first = TaskContext.get().partitionId() * PER_TASK
        keys, rows = [], []  # of the window: its keys, and (place of the key, start, length, crc, tokens of the document)

        def packed() -> pa.RecordBatch:
            nonlocal first
            of, start, length, crc, whole = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            demand = np.stack([length, np.ones(len(length), dtype=np.int64), loss_tokens(length)], axis=1)
            bins, order, offset = placed(demand, limits)
            out = [pa.concat_arrays(keys).take(pa.array(of[order]))]
            out += [pa.array(x[order], pa.int64()) for x in (start, length, crc, whole)]
            out += [pa.array(bins[order] + first, pa.int64()), pa.array(offset, pa.int64())]
            first += int(bins.max()) + 1
            return pa.RecordBatch.from_arrays(out, ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        place = 0
        for some, texts in text_slices(batches):
            keys.append(some)
            for raw in bpe.encode_batch(texts):
                raw += end
                whole = len(raw) // 4
                for start in range(0, whole, most):
                    piece = raw[4 * start : 4 * (start + most)]
                    rows.append((place, start, len(piece) // 4, zlib.crc32(piece), whole))
                place += 1
            if len(rows) >= WINDOW:
                yield packed()
                keys, rows, place = [], [], 0
        if rows:
            yield packed()

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(docs[key].alias("key"), docs[text].alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def pieces_of(turns: Sequence[tuple[int, bool]], limits: Sequence[int]) -> list[list[tuple[int, int, int]]]:
    """Examples of a conversation, each a list of (turn, start, length), from the length of each turn and whether it bears loss.

    A turn goes to the example before it if that keeps within the limits of tokens and loss; else it begins one. A turn that is too long by
    itself is cut into pieces, each an example, the last of which others may join.
    """
    out: list[list[tuple[int, int, int]]] = []
    tokens = loss = 0
    for k, (length, bears) in enumerate(turns):
        most = min(limits[0], limits[2]) if bears else limits[0]
        for start in range(0, length, most):
            n = min(most, length - start)
            if not out or start or tokens + n > limits[0] or loss + n * bears > limits[2]:
                out.append([])
                tokens = loss = 0
            out[-1].append((k, start, n))
            tokens, loss = tokens + n, loss + n * bears
    return out


def pack_conversations(turns: DataFrame, path: str, limits: Sequence[int] = TALK_LIMITS, end_id: int = END_ID, answers: Sequence[str] = ANSWERS, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece of a turn: key, turn, start, length, loss (its loss-bearing tokens), ids_crc32, example, sequence_id, offset.

    A turn is its ids and end_id; it bears loss if its role is one of answers. Turns of a conversation that follow one another make an example as
    long as tokens and loss allow, and an example is one segment; its pieces lie one behind another in one sequence. A conversation is taken TURNS
    turns at a time, so that a very long one is spread over tasks; examples are numbered in each. Null texts are their end mark alone, null roles bear no
    loss. A row without a key or a turn follows nothing: it is a conversation by itself, packed where it was read. Rows that repeat key and turn follow
    one another in the order of their texts; an example ends after HELD rows, so that a task's memory doesn't grow with them. An empty
    table gives no rows; other columns are left out. One shuffle, of the turns by conversation.
    """
    names = ["key", "turn", "start", "length", "loss", "ids_crc32", "example", "sequence_id", "offset"]
    small_batches(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = word_bpe(path, remembered), end_id.to_bytes(4, "little")
        first = TaskContext.get().partitionId() * PER_TASK
        rows, demands = [], []  # of the window: pieces with the number of their example, and the examples' demands
        held: list[tuple[tuple, int | None, bytes, bool]] = []  # turns of the conversation that is being read
        made = 0  # examples that it has so far

        def close() -> None:
            nonlocal made
            for number, parts in enumerate(pieces_of([(len(raw) // 4, bears) for _, _, raw, bears in held], limits), made):
                at = len(demands)
                for k, start, n in parts:
                    (name, _), turn_of, raw, bears = held[k]
                    rows.append((name, turn_of, start, n, n * bears, zlib.crc32(raw[4 * start : 4 * (start + n)]), number, at))
                demands.append((sum(n for _, _, n in parts), 1, sum(n for k, _, n in parts if held[k][3])))
                made += 1
            held.clear()

        def packed() -> pa.RecordBatch:
            nonlocal first
            bins, order, offset = placed(np.array(demands, dtype=np.int64), limits)
            begin = np.empty(len(demands), dtype=np.int64)
            begin[order] = offset
            out, before = [], {}
            for *row, at in rows:  # pieces of an example come one behind another
                own = before.get(at, 0)
                before[at] = own + row[3]
                out.append((*row, int(bins[at]) + first, int(begin[at]) + own))
            out.sort(key=lambda x: (x[7], x[8]))
            first += int(bins.max()) + 1
            rows.clear()
            demands.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, kind if name == "key" else pa.int64()) for name, x in zip(names, zip(*out, strict=True), strict=True)], names)

        kind, now = None, None
        for some, texts in row_slices(batches, 4):
            kind = some.schema.field("key").type
            columns = [some.column(k).to_pylist() for k in range(4)]
            for name, chunk, turn_of, bears, raw in zip(*columns, bpe.encode_batch(texts), strict=True):
                loose = name is None or turn_of is None
                if held and ((name, chunk) != now or loose or len(held) >= HELD):
                    close()
                if (name, chunk) != now or loose:
                    now, made = (name, chunk), 0
                held.append((now, turn_of, raw + end, bears))
            if len(demands) >= WINDOW:
                yield packed()
        close()
        if demands:
            yield packed()

    chunk = F.floor(F.coalesce(turns[turn].cast("long"), F.lit(-1)) / TURNS)
    own = turns.select(turns[key].alias("key"), chunk.alias("chunk"), turns[turn].cast("long").alias("turn"), F.coalesce(turns[role].isin(*answers), F.lit(False)).alias("bears"), turns[text].alias("text"))
    named = F.col("key").isNotNull() & F.col("turn").isNotNull()
    dealt = own.where(named).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "turn", "text").union(own.where(~named))
    kind = turns.schema[key].dataType.simpleString()
    return dealt.mapInArrow(run, f"key {kind}, turn long, start long, length long, loss long, ids_crc32 long, example long, sequence_id long, offset long").withColumnRenamed("key", key)
