from datetime import datetime

import pytest
from pyspark.sql import functions as F

from keepsake import schema
from keepsake.operators import ingest


def raw(spark, table, **columns):
    typed = {c.name: c.type for c in schema.columns(table)}
    return spark.range(1).select(*(F.lit(v).cast(typed[k]).alias(k) for k, v in columns.items()))


def broken(spark, table, **columns):
    filled = ingest.fill_defaults(raw(spark, table, **columns), table)
    good, bad = ingest.validate(filled, table)
    assert good.count() + bad.count() == 1
    return set(bad.first().violations) if bad.count() else set()


NOW = datetime(2024, 1, 1)
SIMPLE = {"id": "1", "created_at": NOW, "updated_at": NOW}
MEDIA = {**SIMPLE, "source_type": "generic", "file_path": "/p.jpg"}


@pytest.mark.parametrize(("column", "value", "fails"), [("latitude", 0.0, False), ("latitude", 90.0, False), ("latitude", -90.0, False), ("latitude", 91.0, True), ("latitude", -91.0, True), ("longitude", 180.0, False), ("longitude", -180.0, False), ("longitude", 181.0, True), ("longitude", -181.0, True)])
def test_coordinates(spark, column, value, fails):
    assert broken(spark, "media", **MEDIA, **{column: value}) == ({f"{column}:range"} if fails else set())


@pytest.mark.parametrize(("month", "fails"), [(1, False), (12, False), (0, True), (13, True)])
def test_budget_months(spark, month, fails):
    found = broken(spark, "budgets", id="1", created_at=NOW, source_type="ynab", year=2024, month=month, category="Groceries", budgeted="500.00")
    assert ("month:range" in found) == fails


def test_enums_zones_and_required_columns(spark):
    assert broken(spark, "media", **{**MEDIA, "source_type": "fax"}) == {"source_type:enum"}
    assert broken(spark, "media", **MEDIA, source_timezone="Nowhere/City") == {"source_timezone:zone"}
    assert broken(spark, "media", **MEDIA, source_timezone="Europe/Paris") == set()
    assert broken(spark, "media", **{k: v for k, v in MEDIA.items() if k != "file_path"}) == {"file_path:required"}
    assert "latitude:required" in broken(spark, "locations", id="1", created_at=NOW, updated_at=NOW, source_type="any text", name="x", longitude=1.0)
    assert "confidence:range" in broken(spark, "entity_links", id="1", created_at=NOW, source_type="media", source_id="1", target_type="person", target_id="2", link_type="mentions", confidence=1.5)


def test_vectors_have_their_length(spark):
    base = {"id": "1", "media_id": "2", "embedding_type": "clip", "model_name": "m", "created_at": NOW}
    df = raw(spark, "media_embeddings", **base).withColumn("embedding", F.array_repeat(F.lit(0.1).cast("float"), 3))
    _, bad = ingest.validate(df, "media_embeddings")
    assert bad.first().violations == ["embedding:length"]
    good, _ = ingest.validate(raw(spark, "media_embeddings", **base).withColumn("embedding", F.array_repeat(F.lit(0.1).cast("float"), 768)), "media_embeddings")
    assert good.count() == 1


def test_defaults(spark):
    row = lambda t, **c: ingest.fill_defaults(raw(spark, t, **c), t).first()
    assert row("import_runs", source_id="1").status == "pending" and row("import_runs", source_id="1").entities_found == 0
    assert row("transactions", id="1").transaction_type == "expense" and row("emails", id="1").folder == "inbox" and row("accounts", id="1").currency == "USD"
    assert row("media", id="1").occurred_at_precision == "second" and row("media", id="1").media_type == "other"
    assert row("people", id="1").is_self is False and row("import_sources", id="1").is_active is True
    assert row("chat_messages", id="1").message_type == "text" and row("calendar_events", id="1").status == "confirmed"


def test_stamps(spark):
    old, new = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-01 00:00:00")
    r = ingest.stamp(spark.range(1).withColumn("created_at", old), new).first()
    assert r.created_at == datetime(2020, 1, 1) and r.updated_at == NOW
    assert ingest.stamp(spark.range(1), new).first().created_at == NOW


def test_run_state(spark):
    rows = spark.createDataFrame([("running", 50, 100), ("completed", 1, None), ("failed", 1, 0), ("pending", 0, 10), ("cancelled", 0, 10)], "s string, c int, t int")
    got = [(r.p, r.r, r.f) for r in rows.select(ingest.run_progress(F.col("c"), F.col("t")).alias("p"), ingest.run_is_running(F.col("s")).alias("r"), ingest.run_is_finished(F.col("s")).alias("f")).collect()]
    assert got == [(50.0, True, False), (None, False, True), (None, False, True), (0.0, False, False), (0.0, False, True)]


def test_dedup_and_upsert_are_idempotent(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "id int, content_hash string")
    once = ingest.keep_first(rows, ["content_hash"], [F.asc("id")])
    assert sorted(r.id for r in once.collect()) == [1, 3, 4, 5]
    assert sorted(r.id for r in ingest.keep_first(once, ["content_hash"], [F.asc("id")]).collect()) == [1, 3, 4, 5]
    assert [r.id for r in ingest.only_new(rows.where("id = 3"), rows.where("id < 3")).collect()] == [3]
    batch = spark.createDataFrame([(3, "c"), (9, "n"), (1, "a"), (None, "x")], "id int, content_hash string")
    assert tuple(ingest.counters(ingest.classify_upsert(batch, rows, ["id"], "content_hash")).first()) == (4, 1, 1, 1, 1)
    after = ingest.upsert(batch, rows, ["id"])
    assert {(r.id, r.content_hash) for r in after.collect()} == {(1, "a"), (2, "a"), (3, "c"), (4, None), (5, None), (9, "n")}
    assert {tuple(r) for r in ingest.upsert(batch, after, ["id"]).collect()} == {tuple(r) for r in after.collect()}


def test_a_key_that_a_batch_repeats_stays_unique(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, content_hash string, at int")
    batch = spark.createDataFrame([(1, "c", 5), (1, "d", 9), (1, "a", 1), (3, "x", 1), (3, "x", 2), (None, "y", 1), (2, "b", 3)], "id int, content_hash string, at int")
    newest = [-F.col("at")]
    assert sorted((r.id, r.content_hash) for r in ingest.upsert(batch, old, ["id"], order=newest).collect()) == [(1, "d"), (2, "b"), (3, "x")]
    actions = ingest.classify_upsert(batch, old, ["id"], "content_hash", newest)
    assert sorted((r.id or 0, r.action) for r in actions.collect()) == [(0, "failed"), (1, "skipped"), (1, "skipped"), (1, "updated"), (2, "skipped"), (3, "created"), (3, "skipped")]
    assert tuple(ingest.counters(actions).first()) == (7, 1, 1, 4, 1)


def test_json_columns(spark):
    df = spark.createDataFrame([('{"+1": ["a", "b"]}',), ("broken",), (None,)], "reactions string")
    assert [r.reactions for r in ingest.parse_json(df, "chat_messages").collect()][0] == {"+1": ["a", "b"]}
    notes = spark.createDataFrame([('[{"entity_type": "person", "entity_id": "7"}]',)], "linked_entities string")
    [r] = ingest.parse_json(notes, "knowledge_notes").collect()
    assert (r.linked_entities[0].entity_type, r.linked_entities[0].entity_id) == ("person", "7")


def test_a_key_repeated_a_million_times_is_counted(spark):
    batch = spark.range(1_000_000).selectExpr("'k' AS id", "'h' AS content_hash").union(spark.createDataFrame([("new", "n")], "id string, content_hash string"))
    actions = ingest.classify_upsert(batch, spark.createDataFrame([("k", "old")], "id string, content_hash string"), ["id"], "content_hash")
    assert ingest.counters(actions).first().asDict() == {"found": 1_000_001, "created": 1, "updated": 1, "skipped": 999_999, "failed": 0}
