"""Imports as streams: any division of the input ends in the batch upsert's table and counters."""

import random

from pyspark.sql import functions as F

from keepsake.operators import ingest
from keepsake.streaming import imports, windows

SCHEMA = "id string, v int, content_hash string"


def as_rows(df):
    return sorted(map(str, df.select("id", "v", "content_hash").collect()))


def test_any_division_gives_the_batch_result_and_progress(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([None, *[f"k{i}" for i in range(40)]]), i, f"h{rng.randint(0, 5)}") for i in range(300)]
    batch = spark.createDataFrame(rows, SCHEMA)
    existing = spark.createDataFrame([(f"k{i}", -1, f"h{i % 6}") for i in range(0, 60, 2)], SCHEMA)
    order = [F.col("v")]
    want = as_rows(ingest.upsert(batch, existing, ["id"], "content_hash", order))
    counts = ingest.counters(ingest.classify_upsert(batch, existing, ["id"], "content_hash", order)).first().asDict()
    for parts in (1, 3, 7):
        rng.shuffle(rows)
        for k in range(parts):
            spark.createDataFrame(rows[k::parts], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{parts}")
        stream = windows.read_table_stream(spark, f"{tmp_path}/in{parts}", batch.schema, 1)
        heard, name = [], f"import{parts}"
        progress = imports.Progress({name}, total=len(rows), told=lambda *x, heard=heard: heard.append(x))
        got, failed = imports.import_stream(stream, f"file://{tmp_path}/run{parts}", ["id"], "content_hash", order, name, progress)
        table, counted = imports.merged(got, failed, existing, ["id"], "content_hash")
        assert as_rows(table) == want and counted.first().asDict() == counts
        assert failed.count() == sum(r[0] is None for r in rows) == counts["failed"]
        assert progress.read[name] == len(rows) and progress.batches[name] == parts == len(heard) and heard[-1] == (name, len(rows), 100.0)


def test_a_later_call_goes_on_where_the_last_one_ended(spark, tmp_path):
    first, second = [("a", 1, "x"), ("b", 5, "y")], [("a", 0, "z"), ("c", 2, "w"), (None, 1, "n")]
    place = f"file://{tmp_path}/run"
    for rows in (first, second):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = windows.read_table_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema, 1)
        got, failed = imports.import_stream(stream, place, ["id"], "content_hash", [F.col("v")])
    assert sorted((r.id, r.v, r._repeats) for r in got.collect()) == [("a", 0, 1), ("b", 5, 0), ("c", 2, 0)] and failed.count() == 1


def test_nothing_arrives(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(f"{tmp_path}/in")
    got, failed = imports.import_stream(windows.read_table_stream(spark, f"{tmp_path}/in", empty.schema), f"file://{tmp_path}/run", ["id"], "content_hash")
    table, counted = imports.merged(got, failed, empty, ["id"], "content_hash")
    assert table.collect() == [] and counted.first().asDict() == {"found": 0, "created": 0, "updated": 0, "skipped": 0, "failed": 0}
