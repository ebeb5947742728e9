"""Readers of exports: CSV, JSON, chat logs, calendars, text and image folders, and what kind of export a file is.

All read through Spark's own sources; columns are typed by the caller or by the table registry, never inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepsake import schema
from keepsake.functions import texts, times

#: "[31/12/2023, 23:59:01] Name: text", "31/12/2023, 23:59 - Name: text", and either with a 12-hour clock: "[12/31/23, 11:59:01 PM] Name: text".
CHAT_LINE = r"^‎?\[?(\d{1,2})[/.](\d{1,2})[/.](\d{2,4}),? (\d{1,2}:\d{2}(?::\d{2})?)(?:[ \u00a0\u202f]?([AaPp])\.?[ \u00a0\u202f]?[Mm]\.?)?\]?(?: -)? (?:([^:]+): )?(.*)$"


def csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """CSV with a header, quoted line feeds and doubled quotes; rows that don't parse have nulls."""
    return spark.read.csv(path, schema=ddl, header=True, multiLine=True, escape='"', mode="PERMISSIVE")


def json_documents(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """One JSON document (object or array) per file."""
    return spark.read.json(path, schema=ddl, multiLine=True)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Budget exports: Account, Date (MM/DD/YYYY), Payee, Category, Outflow, Inflow -> account, occurred_at, payee, category, amount (decimal), transaction_type."""
    raw = csv(spark, path, "Account string, Date string, Payee string, Category string, Outflow string, Inflow string")
    money = lambda c: F.coalesce(F.regexp_replace(F.col(c), r"[^0-9.\-]", "").try_cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)"))
    amount = (money("Inflow") - money("Outflow")).cast("decimal(12,2)")
    return raw.select(F.col("Account").alias("account"), F.try_to_timestamp("Date", F.lit("MM/dd/yyyy")).cast("timestamp_ntz").alias("occurred_at"), F.col("Payee").alias("payee"), F.col("Category").alias("category"), amount.alias("amount"), F.when(amount > 0, "income").otherwise("expense").alias("transaction_type"))


def social_archive(spark: SparkSession, path: str) -> DataFrame:
    """Posts of a social export: id, date, subreddit, title, body, url -> post_id, occurred_at, community_name, title, body, url, post_type."""
    raw = csv(spark, path, "id string, date string, subreddit string, title string, body string, url string")
    at = F.try_to_timestamp(F.regexp_replace("date", " UTC$", "")).cast("timestamp_ntz")
    return raw.select(F.col("id").alias("post_id"), at.alias("occurred_at"), F.col("subreddit").alias("community_name"), "title", "body", "url", F.when(texts.has_text(F.col("body")), "text").otherwise("link").alias("post_type"))


def ledger_accounts(transactions: DataFrame) -> DataFrame:
    """The accounts that a ledger names: name, account_type (by its name), current_balance."""
    name = F.lower("account")
    kind = F.when(name.contains("credit"), "credit_card").when(name.contains("saving"), "savings").when(name.contains("cash"), "cash").when(name.contains("loan"), "loan").when(name.contains("mortgage"), "mortgage").otherwise("checking")
    return transactions.where("account IS NOT NULL").groupBy("account").agg(F.sum("amount").cast("decimal(12,2)").alias("current_balance")).select(F.col("account").alias("name"), kind.alias("account_type"), "current_balance")


def ledger_budgets(spark: SparkSession, path: str) -> DataFrame:
    """Budget exports: Month (Jun 2024 or 2024-06), Category Group, Category, Budgeted, Activity, Available -> year, month, category_group, category, budgeted, spent, available."""
    raw = csv(spark, path, "Month string, `Category Group` string, Category string, Budgeted string, Activity string, Available string")
    money = lambda c: F.coalesce(F.regexp_replace(F.col(c), r"[^0-9.\-]", "").try_cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)"))
    at = F.coalesce(F.try_to_timestamp("Month", F.lit("MMM yyyy")), F.try_to_timestamp("Month", F.lit("yyyy-MM")))
    return raw.select(F.year(at).alias("year"), F.month(at).alias("month"), F.col("Category Group").alias("category_group"), F.col("Category").alias("category"), money("Budgeted").alias("budgeted"), (-money("Activity")).cast("decimal(12,2)").alias("spent"), money("Available").alias("available"))


def _social_time() -> Column:
    return F.try_to_timestamp(F.regexp_replace("date", " UTC$", "")).cast("timestamp_ntz")


def social_comments(spark: SparkSession, path: str) -> DataFrame:
    """Comments of a social export: id, permalink, date, subreddit, link, parent, body -> comment_id, occurred_at, community_name, permalink, post_id, parent_comment_id, body."""
    raw = csv(spark, path, "id string, permalink string, date string, ip string, subreddit string, gildings string, link string, parent string, body string")
    post = F.nullif(F.regexp_extract("link", r"/comments/([A-Za-z0-9]+)", 1), F.lit(""))
    return raw.select(F.col("id").alias("comment_id"), _social_time().alias("occurred_at"), F.col("subreddit").alias("community_name"), "permalink", post.alias("post_id"), F.nullif("parent", F.lit("")).alias("parent_comment_id"), "body")


def social_subscriptions(spark: SparkSession, path: str) -> DataFrame:
    """Subscriptions of a social export: subreddit -> platform, subscription_type, target_name, target_url."""
    raw = csv(spark, path, "subreddit string").where("subreddit IS NOT NULL")
    return raw.select(F.lit("reddit").alias("platform"), F.lit("subreddit").alias("subscription_type"), F.col("subreddit").alias("target_name"), F.concat(F.lit("https://www.reddit.com/r/"), "subreddit").alias("target_url"))


def social_saved(spark: SparkSession, path: str) -> DataFrame:
    """Saved posts and comments of a social export: id, permalink -> saved_id, permalink, kind (post or comment), post_id."""
    raw = csv(spark, path, "id string, permalink string")
    parts = lambda k: F.nullif(F.regexp_extract("permalink", r"/comments/([A-Za-z0-9]+)(?:/[^/]*/([A-Za-z0-9]+))?", k), F.lit(""))
    return raw.select(F.col("id").alias("saved_id"), "permalink", F.when(parts(2).isNotNull(), "comment").otherwise("post").alias("kind"), parts(1).alias("post_id"))


def photo_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """JSON files beside exported photos -> original_filename, caption, occurred_at, latitude, longitude, altitude, media_type, source_url; a place of 0, 0 is none."""
    raw = json_documents(spark, path, "title string, description string, url string, photoTakenTime struct<timestamp:string>, geoData struct<latitude:double,longitude:double,altitude:double>")
    seconds = F.col("photoTakenTime.timestamp").try_cast("bigint")
    there = (F.col("geoData.latitude") != 0) | (F.col("geoData.longitude") != 0)
    place = [F.when(there, F.col(f"geoData.{c}")).alias(c) for c in ("latitude", "longitude", "altitude")]
    at = F.timestamp_seconds(seconds)
    return raw.where("title IS NOT NULL").select(F.col("title").alias("original_filename"), F.nullif("description", F.lit("")).alias("caption"), F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")).alias("occurred_at"), *place, texts.media_type(F.col("title")).alias("media_type"), F.col("url").alias("source_url"))


def chat_export(spark: SparkSession, path: str) -> DataFrame:
    """Chat exports {"messages": [{creator: {name, email}, created_date, text, topic_id, message_id}]} -> thread (file), message_id, topic_id, sender, sender_email, occurred_at, content, message_type."""
    raw = json_documents(spark, path, "messages array<struct<creator:struct<name:string,email:string>,created_date:string,text:string,topic_id:string,message_id:string>>")
    rows = raw.select(F.col("_metadata.file_path").alias("thread"), F.explode("messages").alias("m"))
    stamp = F.regexp_replace(F.regexp_replace(F.col("m.created_date"), "[\u00a0\u202f]", " "), "^[A-Za-z]+day, ", "")
    at = F.coalesce(F.try_to_timestamp(stamp, F.lit("d MMMM yyyy 'at' HH:mm:ss 'UTC'")), F.try_to_timestamp(stamp, F.lit("MMMM d, yyyy 'at' h:mm:ss a 'UTC'")))
    return rows.select("thread", F.col("m.message_id").alias("message_id"), F.col("m.topic_id").alias("topic_id"), F.col("m.creator.name").alias("sender"), texts.alias(F.col("m.creator.email")).alias("sender_email"), F.coalesce(at.cast("timestamp_ntz"), times.parse_instant(stamp)).alias("occurred_at"), F.col("m.text").alias("content"), F.when(texts.has_text(F.col("m.text")), "text").otherwise("other").alias("message_type"))


def chat_media(messages: DataFrame) -> DataFrame:
    """The files that chat_log() messages carry: thread, position, occurred_at, sender, original_filename, media_type, caption (what else the message says)."""
    one = F.regexp_extract("content", r"(?:<attached: ([^>]+)>|(\S+\.[A-Za-z0-9]{2,4}) \(file attached\))", 1)
    two = F.regexp_extract("content", r"(?:<attached: ([^>]+)>|(\S+\.[A-Za-z0-9]{2,4}) \(file attached\))", 2)
    name = F.nullif(F.trim(F.concat(one, two)), F.lit(""))
    rest = F.nullif(F.regexp_replace(F.regexp_replace("content", r"<attached: [^>]+>|\S+\.[A-Za-z0-9]{2,4} \(file attached\)|\u200e", ""), r"^\s+|\s+$", ""), F.lit(""))
    return messages.select("thread", "position", "occurred_at", "sender", name.alias("original_filename"), texts.media_type(name).alias("media_type"), rest.alias("caption")).where("original_filename IS NOT NULL")


def browser_history(spark: SparkSession, path: str) -> DataFrame:
    """Browser export {"Browser History": [{title, url, time_usec}]} -> url, domain, title, occurred_at."""
    raw = json_documents(spark, path, "`Browser History` array<struct<title:string,url:string,time_usec:bigint,page_transition:string>>")
    rows = raw.select(F.explode("Browser History").alias("r"))
    at = F.timestamp_micros("r.time_usec")
    return rows.select(F.col("r.url").alias("url"), texts.domain(F.col("r.url")).alias("domain"), F.col("r.title").alias("title"), F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")).alias("occurred_at"), F.lower("r.page_transition").alias("transition_type"))


def location_history(spark: SparkSession, path: str) -> DataFrame:
    """Location export {"locations": [{latitudeE7, longitudeE7, timestamp, accuracy}]} -> latitude, longitude, accuracy_meters, timestamp."""
    raw = json_documents(spark, path, "locations array<struct<latitudeE7:bigint,longitudeE7:bigint,timestamp:string,accuracy:double>>")
    rows = raw.select(F.explode("locations").alias("r"))
    return rows.select((F.col("r.latitudeE7") / 1e7).alias("latitude"), (F.col("r.longitudeE7") / 1e7).alias("longitude"), F.col("r.accuracy").alias("accuracy_meters"), times.parse_instant(F.col("r.timestamp")).alias("timestamp"))


def chat_log(spark: SparkSession, path: str, day_first: bool | None = None) -> DataFrame:
    """Exported chats: thread (file), position, occurred_at, sender, content. A line without a date continues the message above.

    Clocks of 24 and of 12 hours are read (12 AM is hour 0; an hour over 12 stands as it is). day_first: whether a date begins with its day; None leaves
    that to the file, where a number over 12 tells, and a file without one begins with days. A date that there isn't gives a null time.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("thread"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    head = F.regexp_extract("text", CHAT_LINE, 1) != ""
    run = Window.partitionBy("thread").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    numbered = whole.where("text <> ''").withColumn("position", F.sum(head.cast("int")).over(run)).where("position > 0")
    joined = numbered.groupBy("thread", "position").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    first = F.regexp_extract("text", "^[^\n]*", 0)
    part = lambda k: F.regexp_extract(first, CHAT_LINE, k)
    if day_first is None:
        most = lambda k: F.max(part(k).cast("int")).over(Window.partitionBy("thread"))
        joined = joined.withColumn("_days", (most(1) > 12) | (most(2) <= 12))
    else:
        joined = joined.withColumn("_days", F.lit(day_first))
    day, month = (F.when(F.col("_days"), part(a)).otherwise(part(b)) for a, b in ((1, 2), (2, 1)))
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    said = F.split(part(4), ":", 2)[0].cast("int")
    hour = F.when((part(5) == "") | (said > 12), said).otherwise(said % 12 + F.when(F.lower(part(5)) == "p", 12).otherwise(0))
    at = F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.split(part(4), ":", 2)[1])
    sender = F.when(part(6) != "", part(6))
    content = F.concat(part(7), F.substring("text", F.length(first) + 1, F.length("text")))
    return joined.select("thread", "position", at.try_cast("timestamp_ntz").alias("occurred_at"), sender.alias("sender"), content.alias("content"), F.when(sender.isNull(), "system").otherwise("text").alias("message_type"))


def calendar(spark: SparkSession, path: str) -> DataFrame:
    """iCalendar files: a row for each VEVENT with ical_uid, title, location_name, start_time, end_time, is_all_day, timezone, rrule, status.

    Times are in UTC: a local time of a named zone (TZID) is turned, one with a Z or without a zone is UTC already. timezone keeps the zone for display.
    """
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\r?\n[ \t]", "").alias("v"))
    events = whole.select(F.explode(F.regexp_extract_all("v", F.lit(r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"), 1)).alias("e"))
    value = lambda name: F.nullif(F.trim(F.regexp_extract("e", rf"(?m)^{name}(?:;(?:[^:\n\"]|\"[^\"]*\")*)?:(.*)$", 1)), F.lit(""))
    zone = lambda name: F.nullif(F.regexp_extract("e", rf"(?m)^{name}(?:;[^:\n]*?)?;TZID=\"?/?([^;:\"\n]+)", 1), F.lit(""))

    def at(name: str) -> Column:
        text = F.regexp_replace(value(name), "Z$", "")
        local = F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")
        day = F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("timestamp_ntz")
        return F.coalesce(F.when(value(name).endswith("Z"), local).otherwise(times.to_utc(local, zone(name))), day)

    columns = {"ical_uid": value("UID"), "title": value("SUMMARY"), "location_name": value("LOCATION"), "start_time": at("DTSTART"), "end_time": at("DTEND"), "is_all_day": F.coalesce(F.length(value("DTSTART")) == 8, F.lit(False)), "timezone": zone("DTSTART"), "rrule": value("RRULE"), "status": F.lower(F.coalesce(value("STATUS"), F.lit("CONFIRMED")))}
    return events.select(*(c.alias(n) for n, c in columns.items()))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """A note for each text or markdown file: path, title (first heading or line), content, content_hash."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content"))
    heading = F.regexp_extract("content", r"(?m)^\s*#*\s*(\S.*)$", 1)
    return raw.select("file_path", F.trim(heading).alias("title"), "content", F.sha2("content", 256).alias("content_hash"))


def media_folder(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file, without its bytes: file_path, original_filename, file_size, media_type, file_hash, modified."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(F.col("path").alias("file_path"), name.alias("original_filename"), F.col("length").alias("file_size"), texts.media_type(name).alias("media_type"), F.sha2("content", 256).alias("file_hash"), F.col("modificationTime").cast("timestamp_ntz").alias("modified_at"))


def export_kind(path: Column, head: Column) -> Column:
    """What a file is, by its path first and by its first bytes where that doesn't tell."""
    by_path = F.when(path.rlike("(?i)takeout"), "google_takeout").when(path.rlike("(?i)reddit"), "reddit").when(path.rlike("(?i)whatsapp"), "whatsapp").when(path.rlike("(?i)(ynab|register|budget)"), "ynab")
    by_head = F.when(head.rlike(r"\A\[?\d{1,2}[/.]\d{1,2}[/.]\d{2,4},"), "whatsapp").when(head.rlike(r"\A\s*[\[{]"), "json").when(head.startswith("BEGIN:VCALENDAR"), "calendar").when(head.startswith("From "), "mbox").when(head.startswith("PK\u0003\u0004"), "zip").when(head.rlike(r"\A[^\n]*,[^\n]*\n"), "csv")
    return F.coalesce(by_path, by_head, F.lit("generic"))


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A stored table with its declared columns."""
    return spark.read.schema(schema.schema(table)).parquet(f"{folder}/{table}")


def write_table(df: DataFrame, folder: str, table: str, mode: str = "append", by: str | None = None) -> None:
    """Appends a table's rows as Parquet, with its declared columns, beside a file that names the model's fingerprint.

    by names a time column: then rows lie in folders by its month, so that a range of time reads only its own; null times have a folder too.
    """
    rows = df.select(*(F.col(c.name).cast(c.type) for c in schema.columns(table)))
    if by is None:
        rows.write.mode(mode).parquet(f"{folder}/{table}")
    else:
        rows.withColumn("month_of", F.date_format(by, "yyyy-MM")).write.mode(mode).partitionBy("month_of").parquet(f"{folder}/{table}")
    spark = df.sparkSession
    spark.createDataFrame([(table, schema.fingerprint(table))], "table_name string, fingerprint string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/_model/{table}")


class SchemaMismatchError(RuntimeError):
    """A stored table was written under another model, or under none."""


def check_table(spark: SparkSession, folder: str, table: str) -> None:
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.parquet(f"{folder}/_model/{table}").first()
    except AnalysisException as e:
        raise SchemaMismatchError(f"{table} has no fingerprint in {folder}") from e
    if found is None or found["fingerprint"] != schema.fingerprint(table):
        raise SchemaMismatchError(f"{table} in {folder} was written under another model")


def probe(spark: SparkSession) -> bool:
    """Whether the session answers."""
    return spark.sql("SELECT 1 AS one").first()["one"] == 1


def manual(spark: SparkSession, table: str, rows: list[dict]) -> DataFrame:
    """Rows entered by hand, of source type manual, with the table's columns; what is left out has its default or null."""
    own = {c.name: c for c in schema.columns(table)}
    filled = [{"source_type": "manual", **r} for r in rows]
    loose = T.StructType([T.StructField(n, c.type, True) for n, c in own.items()])
    from keepsake.operators.ingest import fill_defaults

    return fill_defaults(spark.createDataFrame([tuple(r.get(n) for n in own) for r in filled], loose), table)
