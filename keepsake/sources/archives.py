"""Archives and mailboxes: members of ZIP and TAR files, and messages of mbox files, as rows.

Files are read by ranges (see ranges.py), so that one file is many tasks' work. In a store that only Spark reads they come through its binaryFile source; a
file is one task's work there, and smaller than 2 GB.
"""

from __future__ import annotations

import email
import email.policy
import functools
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from email.utils import getaddresses, parsedate_to_datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.operators import graph
from keepsake.sources import ranges

MEMBERS = "archive string, member string, size long, content binary"
MAIL = "mailbox string, position long, message_id string, in_reply_to string, references string, subject string, from_address string, from_name string, to_addresses array<string>, occurred_at timestamp_ntz, body_text string, body_html string, attachment_count int"


def member_parts(spark: SparkSession, path: str, split_bytes: int = ranges.SPLIT_BYTES, part_bytes: int = ranges.PART_BYTES) -> DataFrame:
    """archive, member, size, part, content, error: files inside ZIP and TAR archives of any size, in parts of at most part_bytes.

    A file that is no archive gives no row, and a folder inside an archive none; an empty member is one empty part. A member that can't be read (damaged, encrypted)
    has a last row with its error, the others go on.
    """
    ranges.register(spark)
    return spark.read.format("keepsake_archive").option("splitBytes", split_bytes).option("partBytes", part_bytes).load(path)


def write_archives(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """Stores rows as ZIP members of that name and content, an archive for each task, in a folder that all executors see: archive, members. Lazy: whoever reads the result twice must store it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = ranges.opened(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        tail, n = f"{task.partitionId():06d}-{task.taskAttemptId()}.zip", 0
        with fs.open_output_stream(f"{base}/{tail}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for b in batches:
                for member, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    z.writestr(member, body or b"")
                    n += 1
        yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{tail}"], "members": pa.array([n], pa.int64())})

    return df.where(F.col(name).isNotNull()).select(F.col(name).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "archive string, members long")


def members(spark: SparkSession, path: str, split_bytes: int = ranges.SPLIT_BYTES) -> DataFrame:
    """archive, member, size, content of all files inside ZIP and TAR archives, each whole (1 GB at most: see member_parts()). A file that is neither gives no row."""
    if ranges.reachable(path):
        return member_parts(spark, path, split_bytes, 1 << 30).where("part = 0 AND error IS NULL AND size <= 1073741824").select("archive", "member", "size", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for member, content in unpacked(raw):
                    yield pa.RecordBatch.from_pydict({"archive": [name], "member": [member], "size": pa.array([len(content)], pa.int64()), "content": pa.array([content], pa.binary())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, MEMBERS)


def unpacked(raw: bytes) -> Iterator[tuple[str, bytes]]:
    stream = io.BytesIO(raw)
    if zipfile.is_zipfile(stream):
        with zipfile.ZipFile(stream) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield info.filename, z.read(info)
        return
    stream.seek(0)
    try:
        with tarfile.open(fileobj=stream) as t:
            for info in t:
                if info.isfile():
                    yield info.name, t.extractfile(info).read()
    except tarfile.ReadError:
        return


def unquoted(message: bytes) -> bytes:
    """A message without its "From " line; ">From " lines lose a mark."""
    return re.sub(rb"(?m)^>(>*From )", rb"\1", message.partition(b"\n")[2])


_parsed = functools.lru_cache(1024)(email.policy.default.header_factory)


def _header(name: str, value: str):
    """A header as it is parsed; mails share most of their short ones, and each is asked for several times."""
    return _parsed(name, value) if len(value) <= 256 else email.policy.default.header_factory(name, value)


POLICY = email.policy.default.clone(header_factory=_header)


def mail_fields(raw: bytes) -> dict:
    m = email.message_from_bytes(raw, policy=POLICY)
    sender = getaddresses([str(m.get("From", ""))])
    try:
        at = parsedate_to_datetime(str(m["Date"])) if m["Date"] else None
    except (TypeError, ValueError):
        at = None
    if at is not None and at.tzinfo is not None:
        at = (at - at.utcoffset()).replace(tzinfo=None)

    def body(kind: str) -> str | None:
        part = m.get_body((kind,))
        try:
            return part.get_content() if part is not None else None
        except (LookupError, ValueError):
            return part.get_payload(decode=True).decode("utf-8", "replace")

    text = lambda name: str(m[name]).strip() if m[name] is not None else None
    return {
        "message_id": text("Message-ID"), "in_reply_to": text("In-Reply-To"), "references": text("References"), "subject": text("Subject"),
        "from_name": sender[0][0] or None if sender else None, "from_address": sender[0][1].lower() or None if sender else None,
        "to_addresses": [a.lower() for _, a in getaddresses([str(x) for x in m.get_all("To", [])]) if a],
        "occurred_at": at, "body_text": body("plain"), "body_html": body("html"), "attachment_count": sum(1 for _ in m.iter_attachments()) if m.is_multipart() else 0,
    }


def mailboxes(spark: SparkSession, path: str, split_bytes: int = ranges.SPLIT_BYTES) -> DataFrame:
    """A row for each message of mbox files, times in UTC; position numbers a mailbox's messages from 0.

    A message's number in its range is known where it is read; how many the ranges before have comes from a reading that only counts, so that no message moves.
    """
    schema = pa.schema([("mailbox", pa.string()), ("begin", pa.int64()), ("nth", pa.int64()), *((n, pa.string()) for n in ("message_id", "in_reply_to", "references", "subject", "from_address", "from_name")), ("to_addresses", pa.list_(pa.string())), ("occurred_at", pa.timestamp("us")), ("body_text", pa.string()), ("body_html", pa.string()), ("attachment_count", pa.int32())])
    if ranges.reachable(path):
        ranges.register(spark)
        source = spark.read.format("keepsake_mailbox").option("splitBytes", split_bytes)
        raw = source.load(path)
        counted = source.option("content", "false").load(path).groupBy("mailbox", "begin").agg(F.count(F.lit(1)).alias("_n"))
        past = Window.partitionBy("mailbox").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
        before = graph.held(counted.select("mailbox", "begin", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before")))  # no more rows than ranges; written, so that Spark knows how few
    else:
        before = None  # a file is one range

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, whole in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                    for n, (at, one) in enumerate(ranges.messages_in(io.BytesIO(whole), 0, len(whole))):
                        yield pa.RecordBatch.from_pydict({"mailbox": [name], "offset": pa.array([at], pa.int64()), "begin": pa.array([0], pa.int64()), "nth": pa.array([n], pa.int64()), "raw": pa.array([one], pa.binary())})

        raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, ranges.MESSAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"mailbox": name, "begin": begin, "nth": n, **mail_fields(unquoted(one))} for name, begin, n, one in zip(*(b.column(c).to_pylist() for c in ("mailbox", "begin", "nth", "raw")), strict=True)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    mails = raw.mapInArrow(run, MAIL.replace("position long", "begin long, nth long"))
    position = F.col("nth")
    if before is not None:
        mails, position = mails.join(before, ["mailbox", "begin"]), F.col("nth") + F.col("_before")
    return mails.select("mailbox", position.alias("position"), *(f.name for f in schema if f.name not in ("mailbox", "begin", "nth")))
