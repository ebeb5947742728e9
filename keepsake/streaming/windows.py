"""The batch operators' counterparts on streams: windows with watermarks, sessions, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files at path: of a folder those that are there and that arrive, of a file that one. A path where nothing is fails at once.

    Without files_per_trigger all that is there makes one batch, in which no row is late; with it files should come in order of time, as a
    watermark then takes rows of later batches for late ones.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        raise FileNotFoundError(path)
    stream = spark.readStream.schema(schema)
    stream = stream.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else stream
    if files.getFileStatus(place).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())


def tumbling(events: DataFrame, at: str, late: str, width: str, keys: list[str]) -> DataFrame:
    """rows per window of width and keys; events later than late behind the newest are dropped by the watermark."""
    own = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return own.groupBy(F.window("_at", width), *keys).agg(F.count(F.lit(1)).alias("rows")).select(F.col("window.start").alias("window_start"), *keys, "rows")


def sliding(events: DataFrame, at: str, late: str, width: str, step: str, keys: list[str]) -> DataFrame:
    own = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return own.groupBy(F.window("_at", width, step), *keys).agg(F.count(F.lit(1)).alias("rows")).select(F.col("window.start").alias("window_start"), *keys, "rows")


def sessions(events: DataFrame, at: str, late: str, gap: str, key: str) -> DataFrame:
    own = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return own.groupBy(F.session_window("_at", gap), key).agg(F.count(F.lit(1)).alias("visits")).select(key, F.col("session_window.start").alias("started"), "visits")


def first_of_each(events: DataFrame, at: str, late: str, keys: list[str]) -> DataFrame:
    """Incremental deduplication: keys seen within the watermark pass once."""
    return events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(keys)


def run_to_end(stream: DataFrame, folder: str, mode: str, checkpoint: str) -> DataFrame:
    """Processes what is there into a table in folder and returns it. Each micro-batch writes its own part and a batch that runs again writes the same one;
    in mode complete the last part is the result, else all are. Nothing is collected in the driver."""
    spark, last = stream.sparkSession, [-1]

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        last[0] = max(last[0], number)

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{folder}/batch={last[0]}" if mode == "complete" else f"{folder}/batch=*")
