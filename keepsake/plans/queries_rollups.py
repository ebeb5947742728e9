"""Aggregates, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keepsake.functions import measures, texts, times
from keepsake.operators import entities, graph, rollups, scan
from keepsake.plans import api
from keepsake.plans.registry import Book, table

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
_CENTS = "decimal(12,2)"


@book.query("SELECT conv_id, count(*) AS message_count, min(turn) AS first_message_at, max(turn) AS last_message_at, count(DISTINCT role) AS participant_count FROM conversations GROUP BY conv_id")
def thread_rollup(spark, d):
    return rollups.thread_rollup(table(spark, d, "conversations"), "conv_id", "turn", "role")


@book.query("SELECT conv_id, count(*) AS email_count, min(turn) AS first_email_at, max(turn) AS last_email_at, array_to_string(list_sort(list_distinct(flatten(list([role, 'cc' || turn % 2])))), ',') AS participants, bool_and(length(text) > 40) AS is_read FROM conversations GROUP BY conv_id")
def mail_thread_rollup(spark, d):
    c = table(spark, d, "conversations")
    out = rollups.mail_thread_rollup(c, "conv_id", "turn", [F.col("role"), F.concat(F.lit("cc"), F.col("turn") % 2), F.lit(None).cast("string")], F.length("text") > 40)
    return out.withColumn("participants", F.array_join("participants", ","))


@book.query("SELECT doc_id, count(l.d) AS labels, count(l.d) > 0 AS has_labels FROM documents LEFT JOIN (SELECT doc_id AS d FROM labels) l ON d = doc_id GROUP BY doc_id")
def child_counts(spark, d):
    return rollups.child_counts(table(spark, d, "documents").select("doc_id"), "doc_id", table(spark, d, "labels").withColumnRenamed("doc_id", "of"), "of", "labels")


@book.query("SELECT tag, count(*) AS usage_count FROM (SELECT 'quality' AS tag FROM labels WHERE quality = 1 UNION ALL SELECT 'toxic' FROM labels WHERE toxic = 1) GROUP BY tag")
def tag_usage(spark, d):
    return _tags(spark, d).groupBy("tag").agg(F.count(F.lit(1)).alias("usage_count"))


def _tags(spark, d):
    wide = table(spark, d, "labels")
    return wide.unpivot("doc_id", ["quality", "toxic"], "tag", "value").where("value = 1").select("doc_id", "tag")


@book.query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def untagged_docs(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@book.query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def tagged_docs(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id")


@book.query("SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def shared_tags(spark, d):
    tags = _tags(spark, d)
    return tags.where("tag = 'quality'").select("doc_id").intersect(tags.where("tag = 'toxic'").select("doc_id"))


@book.query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1")
def difference(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(_tags(spark, d).where("tag = 'quality'").select("doc_id"))


@book.query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))
    return a.union(b).distinct()


def _transactions(spark, d):
    """orders as transactions: every third an income, every seventh a transfer, the others expenses."""
    k = F.col("o_orderkey")
    kind = F.when(k % 7 == 0, "transfer").when(k % 3 == 0, "income").otherwise("expense")
    amount = F.col("o_totalprice").cast(_CENTS) * F.when(kind == "expense", -1).otherwise(1)
    return table(spark, d, "orders").select(k.alias("id"), F.col("o_custkey").alias("account"), F.col("o_orderdate").alias("occurred_at"), F.col("o_orderpriority").alias("category"), kind.alias("kind"), amount.cast(_CENTS).alias("amount"))


_TX = "(SELECT o_orderkey AS id, o_custkey AS account, o_orderdate AS occurred_at, o_orderpriority AS category, CASE WHEN o_orderkey % 7 = 0 THEN 'transfer' WHEN o_orderkey % 3 = 0 THEN 'income' ELSE 'expense' END AS kind, (o_totalprice::DECIMAL(12,2) * CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 3 = 0 THEN 1 ELSE -1 END)::DECIMAL(12,2) AS amount FROM orders)"


@book.query(f"SELECT year(occurred_at)::INT AS year, month(occurred_at)::INT AS month, category, -sum(amount)::DECIMAL(22,2) AS spent FROM {_TX} WHERE kind = 'expense' GROUP BY ALL")
def budget_vs_spent(spark, d):
    return rollups.spent_by_month(_transactions(spark, d), "occurred_at", "amount", "kind", "category").withColumn("spent", F.col("spent").cast("decimal(22,2)"))


@book.query(f"""
WITH s AS (SELECT category, year(occurred_at)::INT AS year, month(occurred_at)::INT AS month, -sum(amount) AS spent FROM {_TX} WHERE kind = 'expense' GROUP BY ALL),
b AS (SELECT *, 1000000.00::DECIMAL(22,2) - spent AS rest FROM s)
SELECT category, year, month, coalesce(sum(rest) OVER (PARTITION BY category ORDER BY year, month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DECIMAL(24,2) AS carryover,
       sum(rest) OVER (PARTITION BY category ORDER BY year, month ROWS UNBOUNDED PRECEDING)::DECIMAL(24,2) AS available FROM b""")
def budget_carryover(spark, d):
    spent = rollups.spent_by_month(_transactions(spark, d), "occurred_at", "amount", "kind", "category")
    out = rollups.budget_carryover(spent.withColumn("budgeted", F.lit("1000000.00").cast("decimal(22,2)")))
    return out.select("category", "year", "month", F.col("carryover").cast("decimal(24,2)").alias("carryover"), F.col("available").cast("decimal(24,2)").alias("available"))


@book.query(f"SELECT account, sum(amount)::DECIMAL(22,2) AS balance, count(*) AS transactions FROM {_TX} GROUP BY account")
def account_balance(spark, d):
    return rollups.balances(_transactions(spark, d), "account", "amount").withColumn("balance", F.col("balance").cast("decimal(22,2)"))


@book.query(f"SELECT id, sum(amount) OVER (PARTITION BY account ORDER BY occurred_at, id ROWS UNBOUNDED PRECEDING)::DECIMAL(22,2) AS balance FROM {_TX}")
def running_balance(spark, d):
    out = rollups.running_sum(_transactions(spark, d), ["account"], [F.asc("occurred_at"), F.asc("id")], F.col("amount"), "balance")
    return out.select("id", F.col("balance").cast("decimal(22,2)").alias("balance"))


@book.query("SELECT o_custkey, o_orderkey, turn_rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS turn_rank FROM orders) WHERE turn_rank <= 2")
def latest_per_account(spark, d):
    return rollups.top_per_group(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 2, "turn_rank").select("o_custkey", "o_orderkey", "turn_rank")


@book.query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def latest_per_thread(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("m")).select("conv_id", "m.turn", "m.text")


@book.query("SELECT domain, page_id, rank FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS domain, row_number() OVER (PARTITION BY lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) ORDER BY length(html) DESC, page_id) AS rank FROM pages) WHERE rank <= 3")
def domain_top_pages(spark, d):
    p = table(spark, d, "pages").withColumn("domain", texts.domain(F.col("url")))
    return rollups.top_per_group(p, ["domain"], [F.desc(F.length("html")), F.asc("page_id")], 3).select("domain", "page_id", "rank")


@book.query("SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS domain, count(*) AS visits FROM pages GROUP BY 1 ORDER BY visits DESC, domain LIMIT 20")
def top_domains(spark, d):
    p = table(spark, d, "pages").groupBy(texts.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("visits"))
    return p.orderBy(F.desc("visits"), F.asc_nulls_last("domain")).limit(20)


@book.query("SELECT user_id, session, started, ended, visits FROM (SELECT user_id, session, min(at_us) AS started, max(at_us) AS ended, count(*) AS visits FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT user_id, event_id, epoch_us(ts) AS at_us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL)")
def browse_sessions(spark, d):
    return rollups.sessions(table(spark, d, "events"), "user_id", times.epoch_micros(F.col("ts")), 1_800_000_000)


@book.query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_activity(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.col("ts").cast("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@book.query("SELECT c_mktsegment, c_nationkey, count(*) AS rows, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment), ())")
def grouping_sets_stats(spark, d):
    return rollups.counts_with_totals(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], F.round(F.sum("c_acctbal"), 2))


@book.query("SELECT l_returnflag, l_linestatus, count(*) AS rows FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_stats(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("rows"))


def _visits(spark, d):
    """lineitem as visits: a part of the day at a place."""
    start = F.col("l_shipdate").cast("timestamp_ntz") + F.make_interval(mins=(F.col("l_orderkey") % 600).cast("int"))
    end = F.when(F.col("l_linenumber") != 3, start + F.make_interval(mins=F.col("l_quantity").cast("int")))
    return table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("place"), "l_orderkey", "l_linenumber", start.cast("timestamp_ntz").alias("started_at"), end.cast("timestamp_ntz").alias("ended_at"))


_VISITS = "(SELECT l_suppkey % 50 AS place, l_orderkey, l_linenumber, l_shipdate + to_minutes((l_orderkey % 600)::INT) AS started_at, CASE WHEN l_linenumber <> 3 THEN l_shipdate + to_minutes((l_orderkey % 600)::INT) + to_minutes(l_quantity::INT) END AS ended_at FROM lineitem)"


@book.query(f"SELECT place, count(*) AS visits, count(DISTINCT started_at::DATE) AS days, sum(date_diff('minute', started_at, ended_at))::BIGINT AS minutes FROM {_VISITS} GROUP BY place")
def place_dwell(spark, d):
    v = _visits(spark, d).withColumn("minutes", times.minutes_between(F.col("started_at"), F.col("ended_at")))
    return v.groupBy("place").agg(F.count(F.lit(1)).alias("visits"), F.count_distinct(F.col("started_at").cast("date")).alias("days"), F.sum("minutes").alias("minutes"))


@book.query("SELECT o_custkey % 6 AS source_id, count(*) AS runs, sum(o_orderkey % 100)::BIGINT AS found, sum(o_orderkey % 7)::BIGINT AS created FROM orders GROUP BY 1")
def import_totals(spark, d):
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 6).alias("source_id")).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("o_orderkey") % 100).alias("found"), F.sum(F.col("o_orderkey") % 7).alias("created"))


@book.query("SELECT source_id, run FROM (SELECT o_custkey % 6 AS source_id, o_orderkey AS run, row_number() OVER (PARTITION BY o_custkey % 6 ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_run(spark, d):
    runs = table(spark, d, "orders").groupBy((F.col("o_custkey") % 6).alias("source_id")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return runs.select("source_id", F.col("m.o_orderkey").alias("run"))


@book.query("SELECT emoji, count(*) AS messages, sum(people)::BIGINT AS reactions FROM (SELECT ['+1', 'heart', 'x'][event_id % 3 + 1] AS emoji, event_id % 4 + 1 AS people FROM events) GROUP BY emoji")
def reactions(spark, d):
    k = F.col("event_id")
    emoji = F.element_at(F.array(F.lit("+1"), F.lit("heart"), F.lit("x")), (k % 3 + 1).cast("int"))
    people = F.transform(F.sequence(F.lit(0).cast("long"), k % 4), lambda i: F.concat(F.lit("p"), i))
    e = table(spark, d, "events").select("event_id", F.to_json(F.create_map(emoji, people)).alias("reactions"))
    rows = rollups.explode_json_map(e, "reactions", ["event_id"], "emoji", "people")
    return rows.groupBy("emoji").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.size("people")).alias("reactions"))


@book.query("SELECT o_orderpriority AS link_type, o_orderstatus AS linker_name, count(*) AS links, round(avg(o_orderkey % 101 / 100.0), 6) AS mean_confidence, max(o_orderkey % 101 / 100.0)::DOUBLE AS best FROM orders GROUP BY ALL")
def link_degrees(spark, d):
    sure = (F.col("o_orderkey") % 101).cast("double") / 100
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("link_type"), F.col("o_orderstatus").alias("linker_name")).agg(F.count(F.lit(1)).alias("links"), F.round(F.avg(sure), 6).alias("mean_confidence"), F.max(sure).alias("best"))


@book.query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT ts::DATE) AS days FROM events GROUP BY event_type")
def distinct_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.col("ts").cast("date")).alias("days"))


@book.query()
def approximate_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.percentile_approx("value", [0.5, 0.95], 10_000).alias("quantiles"))


@book.query("SELECT o_orderpriority AS calendar, count(*) FILTER (WHERE o_orderstatus = 'F') AS confirmed, count(*) FILTER (WHERE o_orderstatus = 'O') AS tentative, count(*) FILTER (WHERE o_orderstatus = 'P') AS cancelled FROM orders GROUP BY 1")
def event_status(spark, d):
    wide = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("calendar")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return wide.select("calendar", *(F.coalesce(c, F.lit(0)).alias(n) for c, n in (("F", "confirmed"), ("O", "tentative"), ("P", "cancelled"))))


@book.query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) - 1 AS position FROM part")
def folder_positions(spark, d):
    rows = rollups.running_sum(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], [F.asc("p_size"), F.asc("p_partkey")], F.lit(1), "position")
    return rows.select("p_partkey", (F.col("position") - 1).alias("position"))


@book.query("SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS latency FROM events")
def response_latency(spark, d):
    return rollups.since_previous(table(spark, d, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], times.epoch_micros(F.col("ts")), "latency").select("event_id", "latency")


@book.query("""
WITH p AS (SELECT event_id, user_id, ts, epoch_us(ts) AS at_us, event_id * 37 % 180 - 90.0 AS lat, event_id * 91 % 360 - 180.0 AS lon FROM events),
q AS (SELECT *, lag(at_us) OVER w AS at0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2)))) / ((at_us - at0) / 1000000.0), 4) AS metres_per_second FROM q WHERE at_us > at0""")
def ping_speed(spark, d):
    k = F.col("event_id")
    p = table(spark, d, "events").select("event_id", "user_id", "ts", times.epoch_micros(F.col("ts")).alias("at"), (k * 37 % 180 - 90).cast("double").alias("lat"), (k * 91 % 360 - 180).cast("double").alias("lon"))
    q = scan.scanned(p, ["user_id"], [F.asc("ts"), F.asc("event_id")], before={f"{c}0": F.col(c) for c in ("at", "lat", "lon")}).where("at > at0")
    metres = measures.haversine(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    return q.select("event_id", F.round(metres / ((F.col("at") - F.col("at0")) / 1e6), 4).alias("metres_per_second"))


@book.query("SELECT c_nationkey AS person, c_mktsegment AS alias_type, c_custkey AS alias FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey % 2 DESC, c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def primary_alias(spark, d):
    best = rollups.top_per_group(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], [F.desc(F.col("c_custkey") % 2), F.desc("c_acctbal"), F.asc("c_custkey")], 1)
    return best.select(F.col("c_nationkey").alias("person"), F.col("c_mktsegment").alias("alias_type"), F.col("c_custkey").alias("alias"))


@book.query("SELECT p_partkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS share, first_value(p_partkey) OVER w AS least, nth_value(p_partkey, 2) OVER w AS second, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS size_rank FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)")
def window_functions(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("share"), F.first("p_partkey").over(w).alias("least"), F.nth_value("p_partkey", 2).over(w).alias("second"), F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_size")).alias("size_rank"))


def _view(spark, d):
    parts = [
        entities.entity_rows(table(spark, d, "events"), "browsing_history", "event_id", "ts"),
        entities.entity_rows(table(spark, d, "orders"), "transaction", "o_orderkey", "o_orderdate"),
        entities.entity_rows(table(spark, d, "lineitem").select("l_shipdate", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id")), "location_visit", "id", "l_shipdate"),
        entities.entity_rows(table(spark, d, "documents"), "knowledge_note", "doc_id"),
    ]
    return entities.union_all(parts)


@book.query("WITH v AS (SELECT 'browsing_history' AS entity_type, ts AS at_ts FROM events UNION ALL SELECT 'transaction', o_orderdate FROM orders UNION ALL SELECT 'location_visit', l_shipdate FROM lineitem UNION ALL SELECT 'knowledge_note', NULL FROM documents) SELECT entity_type, count(*) AS entities, min(at_ts)::TIMESTAMP AS first_at, max(at_ts)::TIMESTAMP AS last_at FROM v GROUP BY ROLLUP (entity_type)")
def statistics(spark, d):
    return entities.statistics(_view(spark, d))


@book.query("SELECT * FROM (SELECT 'browsing_history' AS entity_type, event_id::VARCHAR AS entity_id, ts AS occurred_at FROM events UNION ALL SELECT 'transaction', o_orderkey::VARCHAR, o_orderdate FROM orders UNION ALL SELECT 'location_visit', l_orderkey || '-' || l_linenumber, l_shipdate FROM lineitem) WHERE occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-07' OR occurred_at >= TIMESTAMP '1996-03-01' AND occurred_at < TIMESTAMP '1996-03-02'")
def timeline_view(spark, d):
    view = _view(spark, d)
    return entities.timeline(view, ("2024-01-05", "2024-01-07"), ("1996-03-01", "1996-03-02"))


@book.query("WITH RECURSIVE t AS (SELECT n_nationkey AS node, n_nationkey AS root, 0 AS depth, n_name AS path FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.root, t.depth + 1, t.path || '/' || n.n_name FROM nation n JOIN t ON n.n_nationkey > 0 AND (n.n_nationkey - 1) // 2 = t.node) SELECT node, root, depth, path FROM t")
def tree_paths(spark, d):
    return graph.tree(_nations(spark, d), "node", "parent", "name")


def _nations(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(k.alias("node"), F.when(k > 0, F.floor((k - 1) / 2).cast("int")).alias("parent"), F.col("n_name").alias("name"))


@book.query("WITH RECURSIVE t AS (SELECT n_nationkey AS node, n_name AS path FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.path || '/' || n.n_name FROM nation n JOIN t ON n.n_nationkey > 0 AND (n.n_nationkey - 1) // 2 = t.node), c AS (SELECT c_nationkey AS node, count(*) AS n FROM customer GROUP BY 1) SELECT a.path, sum(coalesce(c.n, 0))::BIGINT AS total FROM t a JOIN t b ON b.path = a.path OR starts_with(b.path, a.path || '/') LEFT JOIN c ON c.node = b.node GROUP BY a.path")
def folder_totals(spark, d):
    paths = graph.tree(_nations(spark, d), "node", "parent", "name")
    counts = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return graph.subtree_totals(paths, counts, "c_nationkey", "n")


@book.query("SELECT conv_id || ':' || turn AS node, conv_id || ':0' AS root, turn::INT AS depth FROM conversations")
def reply_chains(spark, d):
    c = table(spark, d, "conversations")
    node = F.concat("conv_id", F.lit(":"), "turn")
    rows = c.select(node.alias("node"), F.when(F.col("turn") > 0, F.concat("conv_id", F.lit(":"), F.col("turn") - 1)).alias("parent"))
    return graph.tree(rows, "node", "parent")


@book.query("WITH RECURSIVE t AS (SELECT c_custkey AS node, CASE WHEN c_custkey % 3 = 0 THEN c_custkey // 3 ELSE c_custkey END AS up FROM customer WHERE c_custkey > 0), r AS (SELECT node, up FROM t UNION SELECT r.node, t.up FROM r JOIN t ON r.up = t.node) SELECT node, min(up) AS canonical FROM r GROUP BY node")
def canonical_person(spark, d):
    k = F.col("c_custkey")
    people = table(spark, d, "customer").where("c_custkey > 0").select(k.alias("node"), F.when(k % 3 == 0, F.floor(k / 3).cast("long")).alias("into"))
    return graph.canonical(people, "node", "into")


@book.query("SELECT c_custkey AS node, c_nationkey * 10 + c_custkey % 2 AS grp, min(c_custkey) OVER (PARTITION BY c_nationkey, c_custkey % 2) AS component FROM customer")
def connected_identities(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") * 10 + F.col("c_custkey") % 2).alias("grp"))
    near = c.withColumn("other", F.lag("c_custkey").over(Window.partitionBy("grp").orderBy(F.xxhash64("c_custkey"))))
    edges = near.select(F.col("c_custkey").alias("source"), F.coalesce("other", "c_custkey").alias("target"))
    return graph.connected(edges).join(c.withColumnRenamed("c_custkey", "node"), "node").select("node", "grp", "component")


@book.query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE 'synonym' || s_nationkey END AS word, n_name AS tag FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def tag_synonyms(spark, d):
    n = table(spark, d, "nation")
    synonyms = n.select(F.concat(F.lit("synonym"), "n_nationkey").alias("synonym"), F.col("n_name").alias("of"))
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    asked = s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("synonym"), "s_nationkey")).alias("word"))
    return asked.join(synonyms, F.col("word") == F.col("synonym"), "left").select("s_suppkey", "word", F.coalesce("of", "word").alias("tag"))


@book.query("WITH v AS (SELECT 'browsing_history' AS entity_type, event_type AS source, ts AS at_ts FROM events UNION ALL SELECT 'knowledge_note', source, NULL FROM documents UNION ALL SELECT 'transaction', o_orderstatus, o_orderdate FROM orders) SELECT entity_type, source, count(*) AS entities, min(at_ts) AS first_at, max(at_ts) AS last_at FROM v GROUP BY ROLLUP (entity_type, source)")
def statistics_by_source(spark, d):
    parts = [entities.entity_rows(table(spark, d, "events"), "browsing_history", "event_id", "ts", source=F.col("event_type")), entities.entity_rows(table(spark, d, "documents"), "knowledge_note", "doc_id", source=F.col("source")), entities.entity_rows(table(spark, d, "orders"), "transaction", "o_orderkey", "o_orderdate", source=F.col("o_orderstatus"))]
    return entities.statistics(entities.union_all(parts), ["source"])


@book.query("SELECT user_id AS id, max(ts) AS last_message_at, count(*) AS message_count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def recent_threads(spark, d):
    threads = rollups.thread_rollup(table(spark, d, "events").withColumnRenamed("user_id", "id"), "id", "ts", "event_type")
    return api.recent_threads(threads, 15).select("id", "last_message_at", "message_count")


@book.query("SELECT event_type, true AS users_near, true AS median_near FROM events GROUP BY event_type")
def approximate_errors(spark, d):
    """Whether the approximate counts and medians lie within their stated errors: 5 % of the users, and ranks 1 % around the middle."""
    e = table(spark, d, "events")
    users = F.abs(F.approx_count_distinct("user_id", 0.05 / 3) - F.count_distinct("user_id")) <= 0.05 * F.count_distinct("user_id") + 1
    median = F.approx_percentile("value", 0.5, 10_000)
    return e.groupBy("event_type").agg(users.alias("users_near"), median.between(F.expr("percentile(value, 0.48)"), F.expr("percentile(value, 0.52)")).alias("median_near"))
