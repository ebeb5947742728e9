"""Importers from end to end: whole tables are written in the form of an export and read back through its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions import times
from keepsake.operators import graph
from keepsake.plans.registry import Book, table
from keepsake.sources import archives, readers

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
#: Rows of a file where an export is one document: a browser's history, a list of places.
ROWS_A_FILE = 5000


def _place(spark) -> str:
    return f"{graph.shared_folder(spark)}/export-{uuid.uuid4().hex}"


def _lines(rows: DataFrame, line) -> str:
    """A new folder with text files of the lines."""
    place = _place(rows.sparkSession)
    rows.select(line.alias("value")).write.text(place)
    return place


def _documents(rows: DataFrame, number, item, name: str) -> str:
    """A new folder with a JSON document {name: [items]} for each ROWS_A_FILE rows, each a file."""
    place = _place(rows.sparkSession)
    part = F.floor(number / ROWS_A_FILE).cast("long")
    own = rows.groupBy(part.alias("part")).agg(F.collect_list(item).alias(name)).select("part", F.to_json(F.struct(F.col(f"`{name}`"))).alias("value"))
    own.repartition("part").write.partitionBy("part").text(place)
    return f"{place}/*"


@book.query("SELECT doc_id, coalesce(source, '') AS subject, coalesce(lang, '') || '@example.org' AS sender, md5(coalesce(text, '')) AS digest FROM documents")
def mailbox_messages(spark, d):
    """All documents as messages of mailboxes, read by ranges of bytes."""
    rows = table(spark, d, "documents")
    head = [F.lit("From keepsake"), F.concat(F.lit("Message-ID: <"), F.col("doc_id").cast("string"), F.lit("@keepsake>")), F.concat(F.lit("Subject: "), F.coalesce("source", F.lit(""))), F.concat(F.lit("From: "), F.coalesce("lang", F.lit("")), F.lit("@example.org"))]
    kind = [F.lit("MIME-Version: 1.0"), F.lit("Content-Type: text/plain; charset=utf-8"), F.lit("Content-Transfer-Encoding: base64"), F.lit("")]
    place = _lines(rows, F.concat_ws("\n", *head, *kind, F.base64(F.coalesce("text", F.lit("")).cast("binary")), F.lit("")))
    mails = archives.mailboxes(spark, place, 1 << 20)
    return mails.select(F.regexp_extract("message_id", r"<(-?\d+)@", 1).cast("long").alias("doc_id"), F.coalesce("subject", F.lit("")).alias("subject"), F.col("from_address").alias("sender"), F.md5(F.coalesce("body_text", F.lit("")).cast("binary")).alias("digest"))


@book.query("SELECT page_id, strlen(coalesce(html, '')) AS size, md5(coalesce(html, '')) AS digest FROM pages WHERE page_id IS NOT NULL")
def archive_members(spark, d):
    """All pages as members of ZIP archives, read by groups of members."""
    place = _place(spark)
    pages = table(spark, d, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), "html")
    graph.held(archives.write_archives(pages, place, "name", "html"))
    found = archives.members(spark, place, 1 << 20)
    return found.select(F.regexp_extract("member", r"(-?\d+)\.html$", 1).cast("long").alias("page_id"), "size", F.md5("content").alias("digest"))


@book.query("SELECT coalesce(role, '') AS sender, ('2024-01-01'::TIMESTAMP + to_minutes((conv_id * 64 + turn)::BIGINT)) AS occurred_at, md5(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> ''), chr(10))) AS digest FROM conversations")
def chat_messages(spark, d):
    """All turns of conversations as lines of chat exports with a clock of twelve hours, eight files; empty lines inside a message are not kept."""
    c = table(spark, d, "conversations")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + 60 * (F.col("conv_id") * 64 + F.col("turn")))
    body = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != ""), "\n")
    line = F.concat(F.lit("["), F.date_format(at, "dd/MM/yyyy, h:mm:ss a"), F.lit("] "), F.coalesce("role", F.lit("")), F.lit(": "), body)
    place = _place(spark)
    c.select((F.col("conv_id") % 8).alias("part"), line.alias("value")).repartition("part").sortWithinPartitions("part").write.partitionBy("part").text(place)
    log = readers.chat_log(spark, f"{place}/*", day_first=True)
    return log.select("sender", "occurred_at", F.md5(F.col("content").cast("binary")).alias("digest"))


@book.query("SELECT event_id, 'https://' || event_type || '.example.org/' || event_id AS url, event_type || '.example.org' AS domain, ts::TIMESTAMP AS occurred_at FROM events")
def browser_visits(spark, d):
    """All events as visits of a browser's export, with times in microseconds."""
    e = table(spark, d, "events")
    url = F.concat(F.lit("https://"), F.col("event_type"), F.lit(".example.org/"), F.col("event_id").cast("string"))
    item = F.struct(url.alias("url"), F.col("event_id").cast("string").alias("title"), times.epoch_micros(F.col("ts")).alias("time_usec"))
    visits = readers.browser_history(spark, _documents(e, F.col("event_id"), item, "Browser History"))
    return visits.select(F.col("title").cast("long").alias("event_id"), "url", "domain", "occurred_at")


@book.query("SELECT latitude, longitude, accuracy_meters, timestamp, count(*) AS pings FROM (SELECT (event_id * 37 % 180 - 90)::DOUBLE AS latitude, (event_id * 91 % 360 - 180)::DOUBLE AS longitude, (event_id % 50)::DOUBLE AS accuracy_meters, date_trunc('second', ts)::TIMESTAMP AS timestamp FROM events) GROUP BY ALL")
def location_pings(spark, d):
    """All events as places of a location export."""
    e = table(spark, d, "events")
    k = F.col("event_id")
    item = F.struct(((k * 37 % 180 - 90) * 10_000_000).alias("latitudeE7"), ((k * 91 % 360 - 180) * 10_000_000).alias("longitudeE7"), (k % 50).cast("double").alias("accuracy"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))
    pings = readers.location_history(spark, _documents(e, k, item, "locations"))
    return pings.groupBy("latitude", "longitude", "accuracy_meters", "timestamp").agg(F.count(F.lit(1)).alias("pings"))


@book.query("SELECT 'account ' || (o_custkey % 20) AS account, date_trunc('day', o_orderdate)::TIMESTAMP AS occurred_at, o_orderpriority AS payee, round(o_totalprice, 2)::DECIMAL(12, 2) * (CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) AS amount, CASE WHEN o_orderstatus = 'F' THEN 'expense' ELSE 'income' END AS transaction_type FROM orders")
def ledger_rows(spark, d):
    """All orders as rows of a budget export: CSV with quoted amounts of money."""
    o = table(spark, d, "orders")
    price = F.format_string("$%,.2f", F.round("o_totalprice", 2).cast("decimal(12,2)").cast("double"))
    out = F.col("o_orderstatus") == "F"
    place = _place(spark)
    rows = o.select(F.concat(F.lit("account "), (F.col("o_custkey") % 20).cast("string")).alias("Account"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("Date"), F.col("o_orderpriority").alias("Payee"), F.lit('a "quoted", category').alias("Category"), F.when(out, price).otherwise("$0.00").alias("Outflow"), F.when(~out, price).otherwise("$0.00").alias("Inflow"))
    rows.write.option("header", True).option("escape", '"').csv(place)
    return readers.ledger(spark, place).select("account", "occurred_at", "payee", "amount", "transaction_type")


@book.query("SELECT o_orderkey AS uid, o_orderpriority AS title, o_orderdate::TIMESTAMP AS start_time, (o_orderdate + INTERVAL 90 MINUTE)::TIMESTAMP AS end_time, CASE WHEN o_orderstatus = 'F' THEN 'cancelled' ELSE 'confirmed' END AS status FROM orders")
def calendar_events(spark, d):
    """All orders as events of calendar files, with folded lines."""
    o = table(spark, d, "orders")
    stamp = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    lines = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), F.col("o_orderkey").cast("string")), F.concat(F.lit("SUMMARY:"), F.substring("o_orderpriority", 1, 2), F.lit("\r\n "), F.expr("substring(o_orderpriority, 3)")), F.concat(F.lit("DTSTART:"), stamp("o_orderdate")), F.concat(F.lit("DTEND:"), stamp(F.col("o_orderdate") + F.expr("INTERVAL 90 MINUTE"))), F.concat(F.lit("STATUS:"), F.when(F.col("o_orderstatus") == "F", "CANCELLED").otherwise("CONFIRMED")), F.lit("END:VEVENT\r")]
    events = readers.calendar(spark, _lines(o, F.concat_ws("\r\n", *lines)))
    return events.select(F.col("ical_uid").cast("long").alias("uid"), "title", "start_time", "end_time", "status")


@book.query("SELECT doc_id::VARCHAR AS id, strlen(text) AS size, md5(text) AS digest FROM documents")
def stored_notes(spark, d):
    """All documents stored as knowledge notes and read back, after the model's fingerprint was checked."""
    place = _place(spark)
    own = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    from keepsake.operators.ingest import fill_defaults

    readers.write_table(fill_defaults(own, "knowledge_notes"), place, "knowledge_notes")
    readers.check_table(spark, place, "knowledge_notes")
    return readers.read_table(spark, place, "knowledge_notes").select("id", F.octet_length("content").cast("long").alias("size"), F.md5(F.col("content").cast("binary")).alias("digest"))
