"""Imports as streams: the batch upsert's result from whatever arrives, batch by batch, with progress while it runs.

Of rows that repeat a key the first by order counts, whichever batch it came in: Spark's streaming aggregation keeps that row and the number of rows
for each key as its state, and hands out the keys that a batch changed. What each batch changes is a part of its own in a folder, written again alike if the
batch runs again; of a key the last part counts. So any division of the input into batches ends in the table that one batch would give.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from keepsake.operators import ingest

REPEATS = "_repeats"


@dataclass
class Progress(StreamingQueryListener):
    """Counts what the streams with given names have read, while they run; told, if given, gets (name, rows so far, percent of total or None) after each batch."""

    names: set[str]
    total: int | None = None
    told: Callable[[str, int, float | None], None] | None = None
    read: dict[str, int] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)
    _of: dict[str, str] = field(default_factory=dict)

    def onQueryStarted(self, event) -> None:
        self._of[str(event.id)] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name in self.names and p.numInputRows:
            self.read[p.name] = self.read.get(p.name, 0) + p.numInputRows
            self.batches[p.name] = self.batches.get(p.name, 0) + 1
            if self.told:
                self.told(p.name, self.read[p.name], 100 * self.read[p.name] / self.total if self.total else None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception and self._of.get(str(event.id)) in self.names:
            self.failed[self._of[str(event.id)]] = event.exception


def _known(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))


def import_stream(stream: DataFrame, folder: str, keys: list[str], hash_column: str, order: list[Column] | None = None, name: str = "import", progress: Progress | None = None) -> tuple[DataFrame, DataFrame]:
    """Reads what is there to its end: (one row of the stream's columns and _repeats for each key, rows that have a null in the key).

    folder is one that all executors see; it holds the state, so that a later call with what has arrived since goes on where this one ended, and the
    rows, of which the first by order (by hash, if none is given) stays for a key.
    """
    spark = stream.sparkSession
    first = F.min_by(F.struct(*(F.col(f"`{c}`") for c in stream.columns)), F.struct(*(order or [F.col(hash_column)]), F.xxhash64(hash_column)))
    own = stream.where(_known(keys)).groupBy(*keys).agg(first.alias("_first"), (F.count(F.lit(1)) - 1).alias(REPEATS))

    def keep(part: str) -> Callable[[DataFrame, int], None]:
        def write(rows: DataFrame, number: int) -> None:
            rows.write.mode("overwrite").parquet(f"{folder}/{part}/batch={number}")

        return write

    if progress is not None:
        spark.streams.addListener(progress)
    try:
        running = []
        for part, rows, mode in (("rows", own.select("_first.*", REPEATS), "update"), ("failed", stream.where(~_known(keys)), "append")):
            query = rows.writeStream.queryName(f"{name}" if part == "rows" else f"{name}-{part}").foreachBatch(keep(part)).outputMode(mode)
            running.append(query.option("checkpointLocation", f"{folder}/checkpoint-{part}").trigger(availableNow=True).start())
        for query in running:
            query.awaitTermination()
    finally:
        if progress is not None:
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
            spark.streams.removeListener(progress)
    return latest(stream, folder, keys), _parts(stream, folder, "failed").drop("batch")


def _parts(stream: DataFrame, folder: str, part: str, more: str = "") -> DataFrame:
    spark = stream.sparkSession
    schema = spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0).cast("long")) if not more else spark.createDataFrame([], stream.schema).withColumn(more, F.lit(0).cast("long")).withColumn("batch", F.lit(0).cast("long"))
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return schema
    return spark.read.schema(schema.schema).parquet(f"{folder}/{part}")


def latest(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """The rows of the last part that has each key: a partial aggregate, as a key may be in every part."""
    rows = _parts(stream, folder, "rows", REPEATS)
    columns = [*stream.columns, REPEATS]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in columns)), "batch").alias("_last")).select("_last.*")


def merged(rows: DataFrame, failed: DataFrame, existing: DataFrame, keys: list[str], hash_column: str) -> tuple[DataFrame, DataFrame]:
    """(existing after the import, its counters: found, created, updated, skipped, failed) from import_stream()'s results, as the batch operators give them."""
    winners = rows.drop(REPEATS)
    old = existing.select(*keys, F.col(hash_column).alias("_old"), F.lit(True).alias("_known"))
    kind = F.when(F.col("_known").isNull(), "created").when(F.col(hash_column).eqNullSafe(F.col("_old")), "skipped").otherwise("updated")
    judged = rows.join(old, keys, "left").select(kind.alias("kind"), REPEATS)
    count = lambda what: F.count_if(F.col("kind") == what)
    sums = judged.agg(count("created").alias("created"), count("updated").alias("updated"), (count("skipped") + F.coalesce(F.sum(REPEATS), F.lit(0))).alias("skipped"))
    counted = sums.crossJoin(F.broadcast(failed.agg(F.count(F.lit(1)).alias("failed"))))  # one row each
    counted = counted.select((F.col("created") + F.col("updated") + F.col("skipped") + F.col("failed")).alias("found"), "created", "updated", "skipped", "failed")
    return ingest.upsert(winners, existing, keys, hash_column), counted
