"""Ingest, projections, predicates and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from keepsake import schema
from keepsake.functions import measures, recurrence, texts, times
from keepsake.operators import entities, graph, hashes, ingest
from keepsake.plans import api
from keepsake.plans.registry import Book, table
from keepsake.streaming import imports, windows

book = Book()
QUERIES, ORACLES = book.queries, book.oracles


@book.query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", ingest.content_hash(F.col("text")).alias("content_hash"))


@book.query("SELECT page_id, sha256(html) AS file_hash, strlen(html)::BIGINT AS file_size FROM pages")
def file_hash(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("file_hash"), F.octet_length("html").cast("long").alias("file_size"))


@book.query("SELECT page_id, sha256(url) AS url_hash FROM pages")
def url_hash(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2("url", 256).alias("url_hash"))


@book.query("SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY text")
def exact_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", ingest.content_hash(F.col("text")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "content_hash")


@book.query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def keep_first_of_group(spark, d):
    return ingest.keep_first(table(spark, d, "documents"), ["source", "lang"], [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "source")


@book.query("SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def incremental_dedup(spark, d):
    docs = table(spark, d, "documents").withColumn("content_hash", ingest.content_hash(F.col("text")))
    return ingest.only_new(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0")).select("doc_id")


def _streamed(spark, d):
    """The import of _upsert() as a stream of four files, one after the other."""
    new, old = _upsert(spark, d)
    place = f"{graph.shared_folder(spark)}/import-{uuid.uuid4().hex}"
    new.repartition(4, F.xxhash64("content_hash")).write.parquet(f"{place}/arrived")
    stream = windows.read_table_stream(spark, f"{place}/arrived", new.schema, 1)
    rows, failed = imports.import_stream(stream, f"{place}/run", ["doc_id"], "content_hash")
    return imports.merged(rows, failed, old, ["doc_id"], "content_hash")


# Every third stored document and every second new one has a key of its own, so that all kinds of rows occur and all documents are on both sides.
_UPSERT = """
WITH old AS (SELECT CASE WHEN doc_id % 3 = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE text END AS t FROM documents),
new AS (SELECT CASE WHEN doc_id % 97 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN doc_id ELSE 1000000000000 + doc_id END AS doc_id, text AS t FROM documents)"""


def _upsert(spark, d):
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    old = docs.select(F.when(k % 3 == 0, -1 - k).otherwise(k).alias("doc_id"), ingest.content_hash(F.when(k % 5 == 0, "old").otherwise(F.col("text"))).alias("content_hash"))
    new = docs.select(F.when(k % 97 == 0, F.lit(None)).when(k % 2 == 0, k).otherwise(k + 1_000_000_000_000).cast("long").alias("doc_id"), ingest.content_hash(F.col("text")).alias("content_hash"))
    return new, old


@book.query(_UPSERT + """,
j AS (SELECT CASE WHEN new.doc_id IS NULL THEN 'failed' WHEN old.doc_id IS NULL THEN 'created' WHEN old.t = new.t THEN 'skipped' ELSE 'updated' END AS action
      FROM new LEFT JOIN old ON new.doc_id = old.doc_id)
SELECT count(*) AS found, count(*) FILTER (WHERE action = 'created') AS created, count(*) FILTER (WHERE action = 'updated') AS updated,
       count(*) FILTER (WHERE action = 'skipped') AS skipped, count(*) FILTER (WHERE action = 'failed') AS failed FROM j""")
def upsert_counters(spark, d):
    new, old = _upsert(spark, d)
    return ingest.counters(ingest.classify_upsert(new, old, ["doc_id"], "content_hash"))


@book.query(_UPSERT + """
SELECT coalesce(new.doc_id, old.doc_id) AS doc_id, sha256(coalesce(new.t, old.t)) AS content_hash FROM old FULL JOIN (FROM new WHERE doc_id IS NOT NULL) new ON old.doc_id = new.doc_id""")
def upsert_result(spark, d):
    new, old = _upsert(spark, d)
    return ingest.upsert(new, old, ["doc_id"])


@book.query(ORACLES["upsert_result"])
def stream_upsert(spark, d):
    """upsert_result from a stream."""
    return _streamed(spark, d)[0]


@book.query(ORACLES["upsert_counters"])
def stream_counters(spark, d):
    return _streamed(spark, d)[1]


_RUNS = """(SELECT o_orderkey AS run, (o_orderkey * 7 % 100)::INT AS done, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey % 13 * 10)::INT END AS total,
       ['pending', 'running', 'completed', 'failed', 'cancelled'][o_orderkey % 5 + 1] AS status FROM orders)"""


@book.query(f"SELECT run, round(CASE WHEN total <> 0 THEN done / total * 100 END, 6) AS percent, status = 'running' AS is_running, status IN ('completed', 'failed', 'cancelled') AS is_finished FROM {_RUNS}")
def import_run_state(spark, d):
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*(F.lit(s) for s in schema.ENUMS["ImportStatus"])), (k % 5 + 1).cast("int"))
    runs = table(spark, d, "orders").select(k.alias("run"), (k * 7 % 100).cast("int").alias("done"), F.when(k % 11 != 0, (k % 13 * 10).cast("int")).alias("total"), status.alias("status"))
    return runs.select("run", F.round(ingest.run_progress(F.col("done"), F.col("total")), 6).alias("percent"), ingest.run_is_running(F.col("status")).alias("is_running"), ingest.run_is_finished(F.col("status")).alias("is_finished"))


_PLACES = "(SELECT c_custkey AS id, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_custkey * 37 % 2000 / 10.0 - 100 END AS latitude, CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE c_custkey * 91 % 4000 / 10.0 - 200 END AS longitude, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS name, ['home', 'work', 'moon'][c_custkey % 3 + 1] AS kind, c_custkey % 14 / 10.0 AS confidence FROM customer)"


@book.query(f"""
SELECT id, list_filter([CASE WHEN name IS NULL THEN 'name:required' END, CASE WHEN kind NOT IN ('home', 'work') THEN 'location_type:enum' END,
  CASE WHEN latitude IS NULL THEN 'latitude:required' END, CASE WHEN latitude NOT BETWEEN -90 AND 90 THEN 'latitude:range' END,
  CASE WHEN longitude IS NULL THEN 'longitude:required' END, CASE WHEN longitude NOT BETWEEN -180 AND 180 THEN 'longitude:range' END], lambda x: x IS NOT NULL).array_to_string(', ') AS violations
FROM {_PLACES} WHERE name IS NULL OR kind = 'moon' OR latitude IS NULL OR longitude IS NULL OR latitude NOT BETWEEN -90 AND 90 OR longitude NOT BETWEEN -180 AND 180""")
def validate_quarantine(spark, d):
    _, bad = ingest.validate(_places(spark, d), "locations")
    return bad.select("id", F.array_join("violations", ", ").alias("violations"))


def _places(spark, d):
    k = F.col("c_custkey")
    latitude, longitude = (k * 37 % 2000).cast("double") / 10.0 - 100, (k * 91 % 4000).cast("double") / 10.0 - 200
    kind = F.element_at(F.array(F.lit("home"), F.lit("work"), F.lit("moon")), (k % 3 + 1).cast("int"))
    return table(spark, d, "customer").select(k.alias("id"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"), kind.alias("location_type"), F.when(k % 17 != 0, latitude).alias("latitude"), F.when(k % 19 != 0, longitude).alias("longitude"))


@book.query(f"SELECT count(*) AS accepted FROM {_PLACES} WHERE name IS NOT NULL AND kind <> 'moon' AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180")
def validate_accepted(spark, d):
    good, _ = ingest.validate(_places(spark, d), "locations")
    return good.agg(F.count(F.lit(1)).alias("accepted"))


@book.query(f"SELECT id, latitude IS NOT NULL AND longitude IS NOT NULL AS has_location FROM {_PLACES}")
def has_location(spark, d):
    return _places(spark, d).select("id", measures.has_location(F.col("latitude"), F.col("longitude")).alias("has_location"))


@book.query("SELECT doc_id, doc_id % 3 = 0 AND length(text) > 0 OR doc_id % 5 = 0 AS has_text FROM documents")
def has_text_content(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", texts.has_text(F.when(i % 3 == 0, F.col("text")), F.when(i % 2 == 0, F.lit("")), F.when(i % 5 == 0, F.lit("caption"))).alias("has_text"))


@book.query("SELECT ['same_time', 'before', 'after', 'during', 'same_location', 'near', 'related', 'similar', 'references', 'reply_to', 'quote', 'mentions', 'about', 'sent_by', 'received_by', 'custom'][event_id % 16 + 1] AS link_type, any_value([true, false, false, false, true, true, true, true, false, false, false, false, false, false, false, false][event_id % 16 + 1]) AS is_bidirectional, count(*) AS links FROM events GROUP BY 1")
def link_directions(spark, d):
    """Events in the place of links, one kind after the other: what goes both ways, and how many there are."""
    kind = F.element_at(F.array(*(F.lit(x) for x in schema.ENUMS["LinkType"])), (F.col("event_id") % 16 + 1).cast("int"))
    links = table(spark, d, "events").select(kind.alias("link_type"))
    return links.withColumn("is_bidirectional", F.col("link_type").isin(*schema.BIDIRECTIONAL)).groupBy("link_type", "is_bidirectional").agg(F.count(F.lit(1)).alias("links"))


@book.query("SELECT event_type, event_id::VARCHAR AS entity_id, ts AS occurred_at FROM events WHERE event_id = 77")
def point_lookup(spark, d):
    found = entities.lookup_in(table(spark, d, "events"), "event_id", 77)
    return entities.entity_rows(found, "browsing_history", "event_id", "ts", event_type=F.col("event_type")).select("event_type", "entity_id", "occurred_at")


@book.query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT o_orderpriority LIKE '1%'")
def flag_filter(spark, d):
    return table(spark, d, "orders").where((F.col("o_orderstatus") == "F") & ~F.col("o_orderpriority").startswith("1")).select("o_orderkey")


@book.query("SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'STANDARD')")
def prefix_filter(spark, d):
    return table(spark, d, "part").where(F.col("p_type").startswith("STANDARD")).select("p_partkey", "p_type")


@book.query("SELECT page_id, url FROM pages ORDER BY length(html) DESC, page_id LIMIT 20")
def gallery(spark, d):
    return table(spark, d, "pages").orderBy(F.length("html").desc_nulls_last(), "page_id").limit(20).select("page_id", "url")


@book.query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS domain FROM pages")
def url_domain(spark, d):
    return table(spark, d, "pages").select("page_id", texts.domain(F.col("url")).alias("domain"))


@book.query("SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title FROM pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", texts.title(F.col("html")).alias("title"))


@book.query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", texts.html_text(F.col("html")).alias("text"))


@book.query("SELECT event_id, props ->> '$.k' AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@book.query("SELECT c_custkey, lower(trim('  ' || c_name || ' ')) AS normalized_value, regexp_replace('+1 (' || c_custkey || ') 555-' || c_nationkey, '[^0-9+]', '', 'g') AS phone FROM customer")
def alias_normalise(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", texts.alias(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("normalized_value"), texts.phone(F.concat(F.lit("+1 ("), "c_custkey", F.lit(") 555-"), "c_nationkey")).alias("phone"))


@book.query("SELECT p_partkey, replace(p_type, ' ', '+') AS q, p_type AS query FROM part")
def search_query(spark, d):
    p = table(spark, d, "part").withColumn("q", F.translate("p_type", " ", "+"))
    return p.select("p_partkey", "q", texts.search_query(F.concat(F.lit("https://example.com/search?hl=en&q="), "q")).alias("query"))


@book.query(r"SELECT doc_id, substr(regexp_replace(text, '\s+', ' ', 'g'), 1, 80) AS snippet FROM documents")
def snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.snippet(F.col("text"), 80).alias("snippet"))


_FILES = "(SELECT p_partkey, '/a/b' || p_size || '/' || ['x.JPG', 'y.mp4', 'z.mp3', 'w.pdf', 'none', 'q.xyz'][p_partkey % 6 + 1] AS path FROM part)"


@book.query(f"SELECT p_partkey, ['image', 'video', 'audio', 'document', 'other', 'other'][p_partkey % 6 + 1] AS media_type, ['jpg', 'mp4', 'mp3', 'pdf', '', 'xyz'][p_partkey % 6 + 1] AS extension, '/a/b' || p_size AS parent, 4 AS depth FROM part")
def file_paths(spark, d):
    name = F.element_at(F.array(*(F.lit(x) for x in ("x.JPG", "y.mp4", "z.mp3", "w.pdf", "none", "q.xyz"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    path = F.concat(F.lit("/a/b"), "p_size", F.lit("/"), name)
    return table(spark, d, "part").select("p_partkey", texts.media_type(path).alias("media_type"), texts.extension(path).alias("extension"), texts.parent_path(path).alias("parent"), texts.depth(path).alias("depth"))


@book.query("SELECT conv_id, turn, CASE WHEN turn > 1 THEN 2 ELSE turn END AS ids, CASE WHEN turn > 0 THEN '<' || conv_id || '.' || (turn - 1) || '@x>' END AS last_id FROM conversations")
def reference_ids(spark, d):
    one = lambda k: F.concat(F.lit("<"), "conv_id", F.lit("."), F.col("turn") - k, F.lit("@x>"))
    header = F.when(F.col("turn") > 1, F.concat(one(2), F.lit(" "), one(1))).when(F.col("turn") == 1, one(1)).otherwise(F.lit(""))
    ids = texts.message_ids(header)
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(ids).cast("long").alias("ids"), F.when(F.size(ids) > 0, F.element_at(ids, -1)).alias("last_id"))


@book.query("""
WITH e AS (SELECT event_id, ts, ['America/New_York', 'Asia/Tokyo', 'Mars/Base', NULL, 'UTC'][event_id % 5 + 1] AS zone FROM events)
SELECT event_id, ts AS field_utc, CASE WHEN zone IN ('America/New_York', 'Asia/Tokyo', 'UTC') THEN timezone('UTC', timezone(zone, ts)) ELSE ts END AS utc, coalesce(zone IN ('America/New_York', 'Asia/Tokyo', 'UTC'), false) AS known FROM e""")
def utc_normalise(spark, d):
    zone = F.get(F.array(F.lit("America/New_York"), F.lit("Asia/Tokyo"), F.lit("Mars/Base"), F.lit(None).cast("string"), F.lit("UTC")), (F.col("event_id") % 5).cast("int"))
    e = table(spark, d, "events").withColumn("zone", zone)
    return e.select("event_id", times.to_utc_field(F.col("ts")).alias("field_utc"), times.to_utc(F.col("ts"), F.col("zone")).alias("utc"), times.is_zone(F.col("zone")).alias("known"))


@book.query("""
WITH e AS (SELECT event_id, ts, ['year', 'month', 'day', 'hour', 'minute', 'second'][event_id % 6 + 1] AS p FROM events)
SELECT event_id, CASE p WHEN 'year' THEN date_trunc('year', ts) WHEN 'month' THEN date_trunc('month', ts) WHEN 'day' THEN date_trunc('day', ts) WHEN 'hour' THEN date_trunc('hour', ts) WHEN 'minute' THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END::TIMESTAMP AS starts,
 CASE p WHEN 'year' THEN date_trunc('year', ts) + INTERVAL 1 YEAR WHEN 'month' THEN date_trunc('month', ts) + INTERVAL 1 MONTH WHEN 'day' THEN date_trunc('day', ts) + INTERVAL 1 DAY WHEN 'hour' THEN date_trunc('hour', ts) + INTERVAL 1 HOUR WHEN 'minute' THEN date_trunc('minute', ts) + INTERVAL 1 MINUTE ELSE date_trunc('second', ts) + INTERVAL 1 SECOND END::TIMESTAMP AS ends
FROM e""")
def precision_span(spark, d):
    p = F.element_at(F.array(*(F.lit(x) for x in times.PRECISIONS)), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", times.span_start(F.col("ts"), p).alias("starts"), times.span_end(F.col("ts"), p).alias("ends"))


@book.query("SELECT event_id, timezone('Asia/Tokyo', timezone('UTC', ts)) AS local_time, epoch_us(ts) AS micros, (value / 3)::INT AS minutes, ts + to_minutes((value / 3)::INT) AS ends FROM (SELECT event_id, ts, floor(value) AS value FROM events)")
def interval_arithmetic(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", F.round(F.floor("value") / 3.0).cast("int").alias("minutes"))
    return e.select("event_id", times.from_utc(F.col("ts"), F.lit("Asia/Tokyo")).alias("local_time"), times.epoch_micros(F.col("ts")).alias("micros"), "minutes", (F.col("ts") + F.make_interval(mins=F.col("minutes"))).cast("timestamp_ntz").alias("ends"))


@book.query("SELECT n_nationkey, TIMESTAMP '2024-01-01 09:00:00' + to_days((n_nationkey % 3 + 1) * 7 * i) AS occurs_at FROM nation, unnest(range(n_nationkey % 4 + 1)) AS r(i)")
def recurrences(spark, d):
    k = F.col("n_nationkey")
    rule = F.concat(F.lit("FREQ=WEEKLY;INTERVAL="), k % 3 + 1, F.lit(";COUNT="), k % 4 + 1)
    n = table(spark, d, "nation").select("n_nationkey", F.lit("2024-01-01 09:00:00").cast("timestamp_ntz").alias("start"), rule.alias("rule"))
    return recurrence.occurrences(n, "n_nationkey", "start", "rule")


@book.query("""
WITH o AS (SELECT o_orderkey AS k, o_orderdate::TIMESTAMP AS start, i, o_orderdate::TIMESTAMP + to_days(i * 7) AS due FROM orders, range(3) r(i)),
x AS (SELECT k, start, CASE WHEN i = 1 AND k % 3 = 1 THEN due + INTERVAL 2 HOUR ELSE due END AS occurs_at, CASE WHEN i = 1 AND k % 3 = 1 THEN due END AS moved_from FROM o WHERE NOT (i = 2 AND k % 2 = 0) AND NOT (i = 1 AND k % 3 = 2))
SELECT k AS o_orderkey, occurs_at, moved_from FROM x UNION ALL SELECT o_orderkey, o_orderdate::TIMESTAMP + INTERVAL 3 DAY, NULL FROM orders WHERE o_orderkey % 5 = 0""")
def calendar_exceptions(spark, d):
    """Orders that come again every week, three times, with occurrences left out, added, moved and cancelled."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    o = table(spark, d, "orders").select("o_orderkey", at.alias("start"), F.lit("FREQ=WEEKLY;COUNT=3").alias("rule"))
    later = lambda text: F.col("start") + F.expr(f"INTERVAL {text}")
    moved = o.where("o_orderkey % 3 > 0").select("o_orderkey", later("7 DAYS").alias("recurrence_id"), later("170 HOURS").alias("start"), F.when(k % 3 == 2, "cancelled").otherwise("confirmed").alias("status"))
    found = recurrence.occurrences(o, "o_orderkey", "start", "rule")
    return recurrence.with_exceptions(found, "o_orderkey", o.where("o_orderkey % 2 = 0").select("o_orderkey", later("14 DAYS").alias("at")), o.where("o_orderkey % 5 = 0").select("o_orderkey", later("3 DAYS").alias("at")), moved)


@book.query("SELECT p_partkey, (p_size + 10) * (p_size + 5) AS area FROM part")
def box_area(spark, d):
    box = F.from_json(F.concat(F.lit("[1, "), F.col("p_size") + 7, F.lit(", "), F.col("p_size") + 11, F.lit(", 2]")), "array<int>")
    return table(spark, d, "part").select("p_partkey", measures.box_area(box).alias("area"))


@book.query("SELECT a.p_partkey AS a, b.p_partkey AS b, bit_count(xor(a.p_partkey * 2654435761 % 1048576, b.p_partkey * 2654435761 % 1048576))::INT AS distance FROM part a JOIN part b ON a.p_partkey < b.p_partkey WHERE bit_count(xor(a.p_partkey * 2654435761 % 1048576, b.p_partkey * 2654435761 % 1048576)) <= 6")
def hamming_pairs(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 2654435761 % 1048576).alias("h"))
    return hashes.hamming_pairs(p, 20, 6)


_HASH64 = "xor(('0x' || substr(md5((p_partkey // 4)::VARCHAR), 2, 15))::BIGINT, xor(1::BIGINT << (p_partkey % 60), 1::BIGINT << (p_partkey * 7 % 60)))"


@book.query(f"SELECT a.id, min(CASE WHEN a.h = b.h THEN b.id END) AS class_id, count(*) - 1 AS links FROM (SELECT p_partkey AS id, {_HASH64} AS h FROM part) a JOIN (SELECT p_partkey AS id, {_HASH64} AS h FROM part) b ON bit_count(xor(a.h, b.h)) <= 10 GROUP BY a.id")
def near_hashes(spark, d):
    """How many other parts have a hash of 64 bits that differs in at most 10, for every part; groups of parts have hashes that differ in a few bits."""
    k = F.col("p_partkey")
    digest = F.conv(F.substring(F.md5(F.floor(k / 4).cast("bigint").cast("string")), 2, 15), 16, 10).cast("bigint")
    bit = lambda c: F.expr(f"shiftleft(1L, cast({c} % 60 AS int))")
    p = table(spark, d, "part").select(k.alias("id"), digest.bitwiseXOR(bit("p_partkey").bitwiseXOR(bit("p_partkey * 7"))).alias("h"))
    return hashes.link_counts(p, 64, 10)


@book.query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))), 3) AS metres FROM (SELECT n_nationkey, n_nationkey * 7.0 - 80 AS lat, n_nationkey * 13.0 - 170 AS lon FROM nation) a JOIN (SELECT n_nationkey, n_nationkey * 7.0 - 80 AS lat, n_nationkey * 13.0 - 170 AS lon FROM nation) b ON b.n_nationkey = (a.n_nationkey + 1) % 25")
def haversine_pairs(spark, d):
    k = F.col("n_nationkey").cast("double")
    n = table(spark, d, "nation").select("n_nationkey", (k * 7 - 80).alias("lat"), (k * 13 - 170).alias("lon"))
    b = n.select(F.col("n_nationkey").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    pairs = n.withColumn("b", (F.col("n_nationkey") + 1) % 25).join(b, "b")
    return pairs.select(F.col("n_nationkey").alias("a"), "b", F.round(measures.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 3).alias("metres"))


@book.query("SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, 'USD') AS currency, CASE WHEN n_nationkey % 3 = 0 THEN 'savings' ELSE 'checking' END AS account_type, false AS is_closed FROM nation")
def fill_defaults(spark, d):
    k = F.col("n_nationkey")
    raw = table(spark, d, "nation").select(k.cast("string").alias("id"), F.when(k % 2 == 0, F.col("n_name")).alias("currency"), F.when(k % 3 == 0, F.lit("savings")).alias("account_type"))
    return ingest.fill_defaults(raw, "accounts").select(F.col("id").cast("int").alias("n_nationkey"), "currency", "account_type", "is_closed")


@book.query("SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id FROM (SELECT c_custkey, sha256('generic:' || c_custkey) AS h FROM customer)")
def stable_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", texts.entity_id(F.lit("generic"), F.col("c_custkey").cast("string")).alias("id"))


@book.query("SELECT c_custkey, c_custkey % 3 = 0 AS is_merged FROM customer")
def is_merged(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", ingest.is_merged(F.when(k % 3 == 0, F.floor(k / 3))).alias("is_merged"))


@book.query(f"SELECT p_partkey, ['image/jpeg', 'video/mp4', 'audio/mpeg', 'application/pdf', NULL, NULL][p_partkey % 6 + 1] AS mime_type, ['image', 'video', 'audio', 'document', 'other', 'other'][p_partkey % 6 + 1] AS media_type FROM {_FILES}")
def mime_types(spark, d):
    name = F.element_at(F.array(*(F.lit(x) for x in ("x.JPG", "y.mp4", "z.mp3", "w.pdf", "none", "q.xyz"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    p = table(spark, d, "part").select("p_partkey", texts.mime_type(name).alias("mime_type"))
    return p.withColumn("media_type", F.coalesce(texts.type_of_mime(F.col("mime_type")), F.lit("other")))


_SHOTS = "(SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'image' WHEN 'view' THEN 'video' ELSE 'audio' END AS media_type, 'a' || user_id % 3 AS album_name, ts AS occurred_at FROM events)"


@book.query(f"SELECT id, occurred_at FROM {_SHOTS} WHERE media_type = 'image' AND album_name = 'a1' AND occurred_at >= TIMESTAMP '2024-01-03' AND occurred_at < TIMESTAMP '2024-01-20' ORDER BY occurred_at DESC, id LIMIT 25")
def gallery_filtered(spark, d):
    kind = F.when(F.col("event_type") == "click", "image").when(F.col("event_type") == "view", "video").otherwise("audio")
    shots = table(spark, d, "events").select(F.col("event_id").alias("id"), kind.alias("media_type"), F.concat(F.lit("a"), F.col("user_id") % 3).alias("album_name"), F.col("ts").alias("occurred_at"))
    return api.gallery(shots, 25, "image", "a1", "2024-01-03", "2024-01-20").select("id", "occurred_at")


@book.query("SELECT doc_id, c AS confidence FROM (SELECT doc_id, (doc_id % 140)::DOUBLE / 100 - 0.2 AS c FROM documents) WHERE c < 0 OR c > 1")
def validate_confidence(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.lit("x").alias("person_id"), F.lit("name").alias("alias_type"), F.lit("v").alias("value"), F.lit("manual").alias("source_type"), ((F.col("doc_id") % 140).cast("double") / 100 - 0.2).alias("confidence"))
    return ingest.validate(rows, "person_aliases")[1].select("doc_id", "confidence")


@book.query("SELECT o_orderkey, m AS month, CASE WHEN m BETWEEN 1 AND 12 THEN '' ELSE 'month:range' END AS violations FROM (SELECT o_orderkey, (o_orderkey % 15)::INT AS m FROM orders)")
def validate_budget_month(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 15).cast("int").alias("month"))
    return ingest.with_violations(rows, ingest.rules("budgets", ["month"])).withColumn("violations", F.array_join("violations", ","))


@book.query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate ELSE TIMESTAMP '2024-05-01 12:00:00' END AS created_at, TIMESTAMP '2024-05-01 12:00:00' AS updated_at FROM orders")
def stamp_rows(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("created_at"))
    return ingest.stamp(rows, F.lit("2024-05-01 12:00:00").cast("timestamp_ntz"))


@book.query("""
WITH b AS (SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id - 1 ELSE doc_id END AS k, doc_id AS v FROM documents), one AS (SELECT k, min(v) AS v FROM b GROUP BY k)
SELECT coalesce(one.k, old.k) AS k, coalesce(one.v, old.v) AS v FROM one FULL JOIN (SELECT doc_id AS k, -1 AS v FROM documents WHERE doc_id % 2 = 0) old ON one.k = old.k""")
def upsert_repeated_keys(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    i = F.col("doc_id")
    batch = docs.select(F.when(i % 3 == 0, i - 1).otherwise(i).alias("k"), i.alias("v"))
    return ingest.upsert(batch, docs.where("doc_id % 2 = 0").select(i.alias("k"), F.lit(-1).cast("bigint").alias("v")), ["k"], "v", [F.col("v")])


@book.query("SELECT n_nationkey, t AS occurs_at FROM (SELECT n_nationkey, t, row_number() OVER (PARTITION BY n_nationkey ORDER BY t) AS r FROM nation, (SELECT unnest(generate_series(TIMESTAMP '2024-01-03 09:00:00', TIMESTAMP '2025-12-31 09:00:00', INTERVAL 1 DAY)) AS t) WHERE CASE n_nationkey % 3 WHEN 0 THEN isodow(t) IN (1, 3) WHEN 1 THEN day(t) IN (1, 31) ELSE isodow(t) = 5 AND day(t) <= 7 END) WHERE r <= n_nationkey % 5 + 2")
def recurrences_by_part(spark, d):
    k = F.col("n_nationkey")
    rule = F.when(k % 3 == 0, "FREQ=WEEKLY;BYDAY=MO,WE").when(k % 3 == 1, "FREQ=MONTHLY;BYMONTHDAY=1,31").otherwise("FREQ=MONTHLY;BYDAY=1FR")
    n = table(spark, d, "nation").select("n_nationkey", F.lit("2024-01-03 09:00:00").cast("timestamp_ntz").alias("start"), F.concat(rule, F.lit(";COUNT="), k % 5 + 2).alias("rule"))
    return recurrence.occurrences(n, "n_nationkey", "start", "rule")


@book.query("SELECT c_custkey, upper(c_name) AS big, lpad(c_nationkey::VARCHAR, 4, '0') AS padded, regexp_replace(c_mktsegment, '[AEIOU]', '', 'g') AS bare, round(pow(c_nationkey, 2) + sqrt(c_nationkey), 6) AS number, list_sort([c_nationkey, 3, 1])::VARCHAR AS sorted, greatest(c_nationkey, 5) AS most FROM customer")
def builtin_functions(spark, d):
    k = F.col("c_nationkey")
    number = F.round(F.pow(k, F.lit(2)) + F.sqrt(k), 6)
    ordered = F.concat(F.lit("["), F.array_join(F.array_sort(F.array(k, F.lit(3), F.lit(1))), ", "), F.lit("]"))
    return table(spark, d, "customer").select("c_custkey", F.upper("c_name").alias("big"), F.lpad(k.cast("string"), 4, "0").alias("padded"), F.regexp_replace("c_mktsegment", "[AEIOU]", "").alias("bare"), number.alias("number"), ordered.alias("sorted"), F.greatest(k, F.lit(5)).alias("most"))


#: The given tables, as a catalogue lists them.
GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_KEYS = (("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"), ("lineitem", "l_partkey", "part"))


@book.query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{g}' AS target, '{g[0]}_{g}key' AS target_column, count(*) AS rows, count(DISTINCT {c}) AS different FROM {t}" for t, c, g in _KEYS))
def catalogue_join(spark, d):
    """What refers to what, from the columns that the stored tables have: a column whose name ends like another table's key refers to that; with what lies in it."""
    listed = [(t, c) for t in GIVEN for c in table(spark, d, t).columns]
    columns = spark.createDataFrame(listed, "table_name string, column_name string").withColumn("tail", F.regexp_extract("column_name", r"^[a-z]+_([a-z]+)key$", 1))
    own = columns.where(F.col("tail") == F.col("table_name")).select(F.col("table_name").alias("target"), F.col("column_name").alias("target_column"), "tail")
    edges = columns.where(F.col("tail") != F.col("table_name")).join(own, "tail").select("table_name", "column_name", "target", "target_column").collect()  # of the catalogue
    parts = [table(spark, d, r["table_name"]).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(r["column_name"]).alias("different")).select(*(F.lit(r[c]).alias(c) for c in r.asDict()), "rows", "different") for r in edges]
    return entities.union_all(parts)


@book.query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM (DESCRIBE {t})) AS columns, count(*) AS rows FROM {t}" for t in GIVEN))
def catalogue_listing(spark, d):
    """The stored tables with their columns and rows."""
    return entities.union_all([(t := table(spark, d, name)).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), F.lit(len(t.columns)).cast("long").alias("columns"), "rows") for name in GIVEN])


@book.query("SELECT n_nationkey AS id, n_name AS name, n_regionkey::VARCHAR AS region FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 = 1")
def active_sources(spark, d):
    k = F.col("n_nationkey")
    kinds = F.element_at(F.array(*(F.lit(x) for x in ("generic", "reddit", "ynab"))), (k % 3 + 1).cast("int"))
    sources = table(spark, d, "nation").select(k.alias("id"), kinds.alias("source_type"), F.col("n_name").alias("name"), F.to_json(F.struct(F.col("n_regionkey").cast("string").alias("region"))).alias("config"), (k % 2 == 0).alias("is_active"))
    return api.active_sources(sources, "reddit").select("id", "name", F.col("config.region").alias("region"))


@book.query("SELECT doc_id AS id, text AS content, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT CASE WHEN quality = 1 THEN 'quality' ELSE 'plain' END AS t FROM labels WHERE doc_id = 12)) AS tags, (SELECT count(*) FROM conversations WHERE conv_id = 12 AND role = 'assistant') AS items_done FROM documents WHERE doc_id = 12")
def note_resource(spark, d):
    notes = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    tags = table(spark, d, "labels").select(F.when(F.col("quality") == 1, "quality").otherwise("plain").alias("tag"), F.lit("knowledge_note").alias("entity_type"), F.col("doc_id").cast("string").alias("entity_id"))
    items = table(spark, d, "conversations").select(F.col("conv_id").alias("note_id"), F.col("text").alias("content"), (F.col("role") == "assistant").alias("is_checked"))
    return api.note(notes, tags, items, 12).select("id", "content", F.nullif(F.array_join("tags", ","), F.lit("")).alias("tags"), "items_done")


@book.query("SELECT page_id AS id, url AS file_path, html AS ocr_text, true AS has_text_content, (SELECT string_agg(n, ',' ORDER BY n) FROM (SELECT DISTINCT c_name AS n FROM customer WHERE c_custkey % 400 = 9)) AS people FROM pages WHERE page_id = 9")
def media_resource(spark, d):
    files = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("file_path"), F.col("html").alias("ocr_text"), F.lit(None).cast("string").alias("caption"), F.lit("").alias("transcript"))
    people = table(spark, d, "customer").select((F.col("c_custkey") % 400).alias("media_id"), F.col("c_name").alias("person"))
    return api.media(files, people, 9).select("id", "file_path", "ocr_text", "has_text_content", F.array_join("people", ",").alias("people"))

