"""WARC archives: written as one gzip stream, normalised to a member per record with a sidecar index, and read by it.

write_stream() writes records as many crawlers leave them, a whole file in one gzip stream, where a record can be reached
only by inflating all before it. normalise() inflates such a stream once, compresses every record into a gzip member of
its own and notes where each begins in a sidecar; read_record() then reads any one by itself.

Of pages with the same payload, of at least MIN_PAYLOAD bytes, that with the largest page_id is stored as a response and
the others as revisits that name it. Files lie in the cluster's shared folder and are opened through pyarrow's file
systems, so that any executor can read what another wrote; a task that runs again writes other files, and only those of
the run that succeeded are in the manifest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import os
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from io import BufferedIOBase
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm._shared import new_path, written

MIN_PAYLOAD = 1000
#: Parts that a digest's pages are dealt to, so that one frequent payload doesn't land in one task.
SALTS = 32
#: Payload bytes after which a task begins another archive.
ARCHIVE_BYTES = 128 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    """One WARC record: its named fields in order, and its block."""

    fields: dict[str, str]
    block: bytes = b""
    version: str = "WARC/1.1"
    http: dict[str, str] = field(default_factory=dict)

    def raw(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in {**self.fields, "Content-Length": str(len(self.block))}.items())
        return f"{self.version}\r\n{head}\r\n".encode() + self.block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, sha1: str, size: int, refers_to: int | None) -> Record:
    """The record of a page: a response with its payload, or, with refers_to, a revisit without it."""
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": DATE}
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")
    fields["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    if refers_to is not None:
        fields |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": PROFILE}
    fields["Content-Type"] = "application/http; msgtype=response"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return Record(fields, head + payload if refers_to is None else head)


def write_stream(out: BufferedIOBase, records: Iterable[Record]) -> int:
    """All records as one gzip stream; returns how many there are."""
    packer, n = zlib.compressobj(1, zlib.DEFLATED, 31), 0
    for r in records:
        out.write(packer.compress(r.raw()))
        n += 1
    out.write(packer.flush())
    return n


def records_of(stream: BufferedIOBase) -> Iterator[bytes]:
    """Raw records of inflated WARC text, read once from front to back. Empty lines between records are skipped; a record cut short raises ValueError."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head, length = [line], None
        while line := stream.readline():
            head.append(line)
            if line in (b"\r\n", b"\n"):
                break
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length":
                length = int(value)
        if length is None or not line:
            raise ValueError("a record without its length")
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("a record cut short")
        yield b"".join(head) + block + b"\r\n\r\n"


def normalise(source: BufferedIOBase, out: BufferedIOBase, index: BufferedIOBase, level: int = 6) -> int:
    """Rewrites a gzip stream (or several, or members already) as a member per record; returns how many.

    index gets a line of JSON per record: offset and length of its member, its id and type. The source is inflated once and
    never held whole.
    """
    at = n = 0
    with gzip.GzipFile(fileobj=source, mode="rb") as inflated:
        for raw in records_of(inflated):
            member = zlib.compress(raw, level, 31)
            out.write(member)
            fields = parse(raw).fields
            index.write((json.dumps({"offset": at, "length": len(member), "id": fields.get("warc-record-id", ""), "type": fields.get("warc-type", "")}) + "\n").encode())
            at += len(member)
            n += 1
    return n


def parse(raw: bytes) -> Record:
    """A record from its raw form, with lower-case field names; the HTTP head of a block is parsed too."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    record = Record(fields, rest[: int(fields.get("content-length", 0))], version)
    if fields.get("content-type", "").startswith("application/http"):
        top, _, body = record.block.partition(b"\r\n\r\n")
        record.http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in top.decode("utf-8", "replace").split("\r\n")[1:])}
        record.block = body
    return record


def read_record(archive: pa.NativeFile, offset: int, length: int) -> Record:
    """One record by its place, without reading any other."""
    archive.seek(offset)
    return parse(zlib.decompress(archive.read(length), 31))


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def with_originals(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """page_id, url, payload, sha1, size and refers_to (null for responses).

    A frequent payload is dealt over SALTS tasks: its largest page_id is found by a partial aggregate, and what is
    repeated for each salt is one row for each payload that occurs twice.
    """
    body = F.coalesce(pages["html"], F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload"), F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("size"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt"))
    twice = rows.where(F.col("size") >= min_payload).groupBy("sha1").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = twice.select(F.col("sha1").alias("of"), "original", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("part"))
    joined = rows.join(twice, (rows["sha1"] == twice["of"]) & (rows["salt"] == twice["part"]) & (rows["size"] >= min_payload), "left")
    refers = F.when(F.col("page_id") != F.col("original"), F.col("original"))
    return joined.select("page_id", "url", "payload", "sha1", "size", refers.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes with_originals() rows as normalised archives into folder; returns archive, index, records of each.

    Lazy: whoever reads the result twice must store it (written()), else the archives are written twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        name, number = f"{context.partitionId():06d}-{context.taskAttemptId()}", 0

        def pages() -> Iterator[tuple[int, Record]]:
            for b in batches:
                for k in range(0, b.num_rows, 256):
                    for r in zip(*(c.to_pylist() for c in b.slice(k, 256).columns), strict=True):
                        yield r[4], page_record(*r)

        stream, done = pages(), False

        def some() -> Iterator[Record]:
            nonlocal done
            total = 0
            for size, record in stream:
                yield record
                total += size
                if total >= archive_bytes:
                    return
            done = True

        while not done:
            place, number = f"{base}/{name}-{number}.warc.gz", number + 1
            with fs.open_output_stream(place + ".whole", compression=None) as out:
                n = write_stream(out, some())
            if n:
                rewrite(fs, place + ".whole", fs, place)
            fs.delete_file(place + ".whole")
            if not n:
                return
            tail = os.path.basename(place)
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{tail}"], "index": [f"{folder}/{tail}.index"], "records": pa.array([n], pa.int64())})

    return rows.select("page_id", "url", "payload", "sha1", "size", "refers_to").mapInArrow(run, "archive string, index string, records long")


def rewrite(source_fs: pafs.FileSystem, source: str, fs: pafs.FileSystem, place: str) -> int:
    """Normalises the archive at source into place, with its sidecar beside it; returns how many records it has."""
    with source_fs.open_input_stream(source, compression=None) as whole, fs.open_output_stream(place, compression=None) as out, fs.open_output_stream(place + ".index", compression=None) as index:
        return normalise(whole, out, index)


def normalise_archives(archives: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """Normalises archives that lie anywhere pyarrow's file systems reach: path, archive, index, records, error of each; read_archives() reads the result.

    An archive is one task's work and is inflated once. One that is missing, no gzip stream or cut short has its error and null places, the others go on; null
    paths are left out, repeated ones are normalised each. Lazy: whoever reads the result twice must store it (written()).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        context, number = TaskContext.get(), 0
        for b in batches:
            for source in b.column("path").to_pylist():
                tail, number = f"{context.partitionId():06d}-{context.taskAttemptId()}-{number}.warc.gz", number + 1
                try:
                    n, error = rewrite(*opened(source), fs, f"{base}/{tail}"), None
                except (OSError, ValueError, EOFError, zlib.error) as e:
                    n, error = None, f"{type(e).__name__}: {e}"
                archive = f"{folder}/{tail}" if error is None else None
                yield pa.RecordBatch.from_pydict({"path": [source], "archive": pa.array([archive], pa.string()), "index": pa.array([archive and archive + ".index"], pa.string()), "records": pa.array([n], pa.int64()), "error": pa.array([error], pa.string())})

    return archives.where(F.col(path).isNotNull()).select(F.col(path).alias("path")).mapInArrow(run, "path string, archive string, index string, records long, error string")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the manifest's archives, through their indexes: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Size and digest of a response are those of the payload that was read; a revisit has those of its header.
    """

    def page(urn: str) -> int | None:
        tail = urn.strip("<>").rpartition(":")[2]
        return int(tail) if tail else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for archive, index in zip(b.column("archive").to_pylist(), b.column("index").to_pylist(), strict=True):
                fs, place = opened(archive)
                with fs.open_input_stream(opened(index)[1], compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                rows: list[dict] = []
                with fs.open_input_file(place) as f:
                    for e in entries:
                        r = read_record(f, e["offset"], e["length"])
                        revisit = r.fields["warc-type"] == "revisit"
                        digest = base64.b32decode(r.fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        size = int(r.http["content-length"]) if revisit else len(r.block)
                        if not revisit and hashlib.sha1(r.block).hexdigest() != digest:
                            raise ValueError(f"{archive} at {e['offset']}: the payload isn't that of its digest")
                        rows.append(dict(zip(names, (page(e["id"]), r.fields.get("warc-target-uri"), size, digest, r.fields["warc-type"], page(r.fields["warc-refers-to"]) if revisit else None), strict=True)))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.where("archive IS NOT NULL").select("archive", "index").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes all pages as archives and reads them back: one row per row of pages.

    A page is a record whatever its length; a task holds one page at a time. A null html is an empty payload, a null url is left out, a null page_id is a response that none refers to.
    Of rows that repeat the largest page_id with one payload each is a response. Other columns are ignored; an empty
    table writes no archive.
    """
    spark = pages.sparkSession
    manifest = written(write_archives(with_originals(pages), folder or new_path(spark, "warc")), "manifest")
    return read_archives(manifest.repartition(max(1, manifest.count())))


def oracle(min_payload: int = MIN_PAYLOAD) -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= {min_payload} THEN max(page_id) OVER (PARTITION BY body) END AS original FROM p)
SELECT page_id, payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN page_id <> original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM m"""
