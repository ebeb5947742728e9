"""What the operators share: tables in the folder that the whole cluster sees."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: White space of the word patterns: space and the characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, in local mode (tests) a temporary folder that becomes its value, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster sees")
        folder = "file://" + tempfile.mkdtemp(prefix="keepsake-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; it goes when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, safe from lost executors, and with no lineage.

    files is how many its rows are worth at most; without it, as many as df has partitions.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.coalesce(files) if files else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


#: Where the tables of written() lie, as long as someone holds them.
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def superseded(*tables: DataFrame | None) -> None:
    """Deletes tables of written() that nothing reads any more: a loop then needs the disk of its last round, not of all. Other DataFrames are left alone."""
    for df in tables:
        path = _places.pop(df, None) if df is not None else None
        if path:
            spark = df.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes and rows of text that a worker takes up at a time; a longer text is taken alone.
AT_ONCE, ROWS_AT_ONCE = 2_000_000, 1_000


#: Bytes of an Arrow batch at most.
BATCH_BYTES = 2 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From here on, Arrow batches of the session have at most BATCH_BYTES, or less where it says so: what goes to a Python worker at a time is
    bounded by bytes and not by rows, on both sides. It holds for what is planned later, so operators that start workers call it."""
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


def row_slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """(rows, their texts) of consecutive rows with about AT_ONCE bytes of text, so that memory doesn't follow Arrow's batches; text: the column's place."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(first, ROWS_AT_ONCE)
            size = pc.fill_null(pc.binary_length(part.column(text)), 0).to_numpy(zero_copy_only=False)
            start = total = 0
            for i, n in enumerate(size.tolist()):
                total += n
                if total >= AT_ONCE or i == len(size) - 1:
                    rows = part.slice(start, i + 1 - start)
                    yield rows, rows.column(text).to_pylist()
                    start, total = i + 1, 0


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """(keys, texts) of row_slices() of batches with the columns key and text."""
    for rows, texts in row_slices(batches, 1):
        yield rows.column(0), texts


def with_column(docs: DataFrame, column: str, kind: str, text: str, worker: Callable[[], Callable[[list[str | None]], pa.Array]]) -> DataFrame:
    """All columns of docs, then column, of what a worker's function makes of the texts; one row per row of docs, slice by slice."""
    at = docs.columns.index(text)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = worker()
        for rows, texts in row_slices(batches, at):
            yield pa.RecordBatch.from_arrays([*rows.columns, made(texts)], [*rows.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(column, T._parse_datatype_string(kind))]))


def kept_rows(docs: DataFrame, text: str, worker: Callable[[], Callable[[list[str | None]], list[bool]]]) -> DataFrame:
    """The rows of docs for whose texts a worker's function is true; all columns."""
    at = docs.columns.index(text)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker()
        for rows, texts in row_slices(batches, at):
            yield rows.filter(pa.array(kept(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


_owner: tuple[str, Callable[[], None]] | None = None


def take_over(name: str, forget: Callable[[], None]) -> None:
    """Called where an operator's task begins in a Python worker: what another operator remembers there is given up first.

    Workers outlive stages, and each operator may fill its own dictionaries; forget empties the caller's.
    """
    global _owner
    if _owner is not None and _owner[0] != name:
        _owner[1]()
        give_back()
    _owner = (name, forget)


def give_back() -> None:
    """Memory that this process has freed goes back to the system, where the C library can do that."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
