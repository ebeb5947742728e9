"""Mailboxes and archives as tables that many tasks read: a mailbox by ranges of bytes, an archive by groups of members.

Both are data sources of Spark's Python API. Whoever plans a read looks at sizes and directories only; a task opens the file at its own place
and streams from there, so that a file may be larger than any row, worker or executor. A message belongs to the range in which it begins.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file that a task reads (about), of content in one row, and of a read.
SPLIT_BYTES, PART_BYTES, BLOCK = 64 << 20, 8 << 20, 1 << 20
#: Bytes of an Arrow batch at most (about).
BATCH_BYTES = 2 << 20
MESSAGES = "mailbox string, offset long, begin long, nth long, raw binary"
PARTS = "archive string, member string, size long, part int, content binary, error string"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def reachable(path: str) -> bool:
    """Whether pyarrow's file systems know the store; other stores are read by Spark alone."""
    try:
        opened(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return "*" not in path and "," not in path


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder but those whose names begin with a dot or an underscore."""
    fs, place = opened(path)
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    info = fs.get_file_info(place)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [x for x in fs.get_file_info(pafs.FileSelector(place, recursive=True)) if x.is_file]
    shown = lambda p: not any(x[0] in "._" for x in p.removeprefix(place).split("/") if x)
    return sorted((f"{prefix}{x.path}", x.size) for x in found if info.is_file or shown(x.path))


def _is_zip(file: pa.NativeFile) -> bool:
    try:
        return zipfile.is_zipfile(file)
    except (ValueError, OSError):  # shorter than a directory's end
        return False


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def _beginning(data: bytearray, start: int) -> int:
    """Where a message begins at or behind start, -1 if nowhere: at a "From " line behind an empty line (or one that opens the file, which the caller sees)."""
    at = data.find(b"From ", start)
    while at >= 0 and data[max(0, at - 2) : at] != b"\n\n" and data[max(0, at - 3) : at] != b"\n\r\n":
        at = data.find(b"From ", at + 1)
    return at


def messages_in(file: io.BufferedIOBase, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the messages that begin in [start, end), whole, each from its "From " line on. Of what it reads it holds one message."""
    base = max(0, start - 4)  # what stands before a line says whether it begins a message
    file.seek(base)
    data, searched, current = bytearray(), 0, None
    while True:
        at = 0 if base == searched == 0 and data[:5] == b"From " else _beginning(data, searched)
        if at < 0:
            block = file.read(BLOCK)
            if not block:
                break
            searched = max(searched, len(data) - 8)
            if current is None and len(data) > 8:  # nothing that is held begins a message
                base += searched
                del data[:searched]
                searched = 0
            data += block
            continue
        if current is not None:
            yield current, bytes(data[:at])
        if base + at >= end:
            return
        current = base + at if base + at >= start else None
        del data[:at]
        base, searched = base + at, 5
    if current is not None:
        yield current, bytes(data)


def _batches(rows: Iterator[tuple], schema: pa.Schema, sized: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[sized] or b"")
        if size >= BATCH_BYTES or len(held) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class MailboxReader(DataSourceReader):
    def __init__(self, path: str, split: int, content: bool):
        self.path, self.split, self.content = path, split, content

    def partitions(self) -> list[Range]:
        return [Range(p, a, min(n, a + self.split)) for p, n in files_of(self.path) for a in range(0, n, self.split)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, place = opened(part.path)
        with fs.open_input_file(place) as file:
            schema = pa.schema([("mailbox", pa.string()), ("offset", pa.int64()), ("begin", pa.int64()), ("nth", pa.int64()), ("raw", pa.binary())])
            found = enumerate(messages_in(file, part.start, part.end))
            yield from _batches(((part.path, at, part.start, n, raw if self.content else None) for n, (at, raw) in found), schema, 4)


class MailboxSource(DataSource):
    """format("keepsake_mailbox").load(path), options splitBytes and content: a row for each message of mbox files: mailbox, offset (its first byte), begin (its range's
    first byte), nth (its number in the range, from 0), raw (from its "From " line on; null where content is false)."""

    @classmethod
    def name(cls) -> str:
        return "keepsake_mailbox"

    def schema(self) -> str:
        return MESSAGES

    def reader(self, schema) -> MailboxReader:
        return MailboxReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)), self.options.get("content", "true").lower() == "true")


@dataclass
class Members(InputPartition):
    """Members first to last of a ZIP's directory; of a TAR their names and places; of a compressed TAR all (no places)."""

    path: str
    kind: str
    first: int = 0
    last: int = 0
    places: tuple[tuple[str, int, int], ...] = ()


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, split: int, part: int):
        self.path, self.split, self.part = path, split, part

    def partitions(self) -> list[Members]:
        out = []
        for path, size in files_of(self.path):
            fs, place = opened(path)
            with fs.open_input_file(place) as file:
                out += self._groups(path, file) if size else []
        return out or [Members("", "none")]

    def _groups(self, path: str, file: pa.NativeFile) -> Iterator[Members]:
        if _is_zip(file):
            sizes = [x.compress_size for x in zipfile.ZipFile(file).infolist()]
            for a, z in self._cuts(sizes):
                yield Members(path, "zip", a, z)
            return
        file.seek(0)
        if file.read(2) in (b"\x1f\x8b", b"BZ", b"\xfd7"):
            yield Members(path, "stream")
            return
        file.seek(0)
        try:
            with tarfile.open(fileobj=file, mode="r:") as t:
                found = [(x.name, x.offset_data, x.size) for x in t if x.isfile()]
        except tarfile.ReadError:
            return  # neither: it gives no row
        for a, z in self._cuts([n for _, _, n in found]):
            yield Members(path, "tar", places=tuple(found[a:z]))

    def _cuts(self, sizes: list[int]) -> Iterator[tuple[int, int]]:
        first = total = 0
        for k, n in enumerate(sizes):
            total += n
            if total >= self.split or k == len(sizes) - 1:
                yield first, k + 1
                first, total = k + 1, 0

    def _content(self, archive: str, member: str, size: int, stream: io.BufferedIOBase) -> Iterator[tuple]:
        """A row for each part of a member; one that can't be read ends with a row that says why."""
        part = done = 0
        try:
            while part == 0 or done < size:
                content = stream.read(min(self.part, size - done))
                if done < size and not content:
                    raise EOFError("cut short")
                yield archive, member, size, part, content, None
                part, done = part + 1, done + len(content)
        except (OSError, EOFError, RuntimeError, ValueError, zipfile.BadZipFile, NotImplementedError) as e:
            yield archive, member, size, part, None, f"{type(e).__name__}: {e}"

    def _rows(self, p: Members) -> Iterator[tuple]:
        fs, place = opened(p.path)
        with fs.open_input_file(place) as file:
            if p.kind == "zip":
                with zipfile.ZipFile(file) as z:
                    for info in z.infolist()[p.first : p.last]:
                        if info.is_dir():
                            continue
                        try:
                            with z.open(info) as stream:
                                yield from self._content(p.path, info.filename, info.file_size, stream)
                        except (RuntimeError, zipfile.BadZipFile, NotImplementedError) as e:
                            yield p.path, info.filename, info.file_size, 0, None, f"{type(e).__name__}: {e}"
            elif p.kind == "tar":
                for name, at, size in p.places:
                    file.seek(at)
                    yield from self._content(p.path, name, size, file)
            else:
                try:
                    with tarfile.open(fileobj=file, mode="r|*") as t:
                        for info in t:
                            if info.isfile():
                                yield from self._content(p.path, info.name, info.size, t.extractfile(info))
                except (tarfile.ReadError, EOFError, OSError, gzip.BadGzipFile):
                    return

    def read(self, part: Members) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("part", pa.int32()), ("content", pa.binary()), ("error", pa.string())])
        if part.path:
            yield from _batches(self._rows(part), schema, 4)


class ArchiveSource(DataSource):
    """format("keepsake_archive").load(path), options splitBytes and partBytes: the files in ZIP and TAR archives, in parts: archive, member, size, part, content, error."""

    @classmethod
    def name(cls) -> str:
        return "keepsake_archive"

    def schema(self) -> str:
        return PARTS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)), int(self.options.get("partBytes", PART_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MailboxSource)
    spark.dataSource.register(ArchiveSource)
