"""The service's tools as functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsake.functions import texts, times
from keepsake.operators import entities, graph, ingest, joins, search
from keepsake.sources import readers


def search_knowledge(corpus: DataFrame, query: list[str], probe: list[float] | Column, k: int = 10) -> DataFrame:
    """Hybrid search over (id, content, embedding): the k best by fused ranks, from whole rankings by words and by vectors."""
    words = search.ranked(search.word_scores(corpus, "id", "content", query))
    vectors = search.ranked(search.vector_scores(corpus, "id", "embedding", probe))
    return search.fuse(words, vectors).orderBy(F.desc("score"), "id").limit(k)


def get_entity(view: DataFrame, entity_type: str, entity_id: object) -> DataFrame:
    return entities.get_entity(view, entity_type, entity_id)


def create_note(spark: SparkSession, content: str, tags: list[str], now: str, source_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(note, tags, assignments) rows; ids follow from source_id and tag names, so that a retry makes no second note."""
    note = readers.manual(spark, "knowledge_notes", [{"content": content, "source_id": source_id}])
    note = note.withColumn("id", texts.entity_id(F.lit("manual"), F.lit(source_id))).withColumn("content_hash", ingest.content_hash(F.col("content")))
    note = ingest.stamp(note.drop("created_at"), F.lit(now).cast("timestamp_ntz")).select(note.columns)
    names = spark.createDataFrame([(t,) for t in dict.fromkeys(tags)], "name string").withColumn("id", texts.entity_id(F.lit("tag"), texts.alias(F.col("name"))))
    pairs = names.crossJoin(note.select(F.col("id").alias("entity_id"))).select(F.col("id").alias("tag_id"), F.lit("knowledge_note").alias("entity_type"), "entity_id")
    return note, names, pairs


def find_related(links: DataFrame, start: str, hops: int = 2) -> DataFrame:
    """Entities within hops of start over links (source, target)."""
    spark = links.sparkSession
    first = spark.createDataFrame([(start,)], "node string")
    return graph.within_hops(links, first, hops).where("hops > 0")


def timeline_view(view: DataFrame, start: str, end: str) -> DataFrame:
    return entities.timeline(view, (start, end))


def timeline_day(view: DataFrame, day: str) -> DataFrame:
    from datetime import date, timedelta

    return entities.timeline(view, (day, str(date.fromisoformat(day) + timedelta(days=1))))


def search_by_location(places: DataFrame, latitude: float, longitude: float, radius: float) -> DataFrame:
    """Entities with latitude and longitude at most radius metres from a point, nearest first."""
    return joins.around(places, latitude, longitude, radius).orderBy("distance_m")


def search_by_person(edges: DataFrame, canonical: DataFrame, person: object) -> DataFrame:
    """Entities of a person and of all who were merged into them; edges: person_id, role, entity_type, entity_id, occurred_at."""
    own = edges.join(canonical, F.col("person_id") == F.col("node")).withColumn("person_id", F.col("canonical")).drop("node", "canonical")
    return entities.of_person(own, F.lit(person))


def get_statistics(view: DataFrame) -> DataFrame:
    return entities.statistics(view)


def conversation(messages: DataFrame, thread: Column, order: list[Column]) -> DataFrame:
    return messages.where(thread).orderBy(*order)


def in_zone(df: DataFrame, at: str, zone: str) -> DataFrame:
    return df.withColumn("local_time", times.from_utc(F.col(at), F.lit(zone)))


def note(notes: DataFrame, tags: DataFrame, checklists: DataFrame, note_id: object) -> DataFrame:
    """One note with its contents, its tags in order and its open and done items; raises EntityNotFoundError where there is none.

    tags: tag, entity_type, entity_id. checklists: note_id, content, is_checked.
    """
    own = entities.lookup_in(notes, "id", note_id)
    if own.isEmpty():
        raise entities.EntityNotFoundError("knowledge_note", note_id)
    named = tags.where((F.col("entity_type") == "knowledge_note") & (F.col("entity_id") == str(note_id))).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    items = checklists.where(F.col("note_id").cast("string") == str(note_id)).agg(F.count_if("is_checked").alias("items_done"), F.count_if(~F.col("is_checked")).alias("items_open"))
    return own.crossJoin(F.broadcast(named)).crossJoin(F.broadcast(items))  # one row each


def media(files: DataFrame, people: DataFrame, media_id: object) -> DataFrame:
    """One medium with its contents (text that was read in it, caption, transcript) and who is in it; raises EntityNotFoundError where there is none. people: media_id, person."""
    own = entities.lookup_in(files, "id", media_id)
    if own.isEmpty():
        raise entities.EntityNotFoundError("media", media_id)
    shown = people.where(F.col("media_id").cast("string") == str(media_id)).agg(F.array_sort(F.collect_set("person")).alias("people"))
    return own.withColumn("has_text_content", texts.has_text(*(F.col(c) for c in ("ocr_text", "caption", "transcript")))).crossJoin(F.broadcast(shown))


def recent_threads(threads: DataFrame, k: int = 20) -> DataFrame:
    """The k threads with the latest last_message_at; ties go to the smaller id, threads without a message come last."""
    return threads.orderBy(F.desc_nulls_last("last_message_at"), "id").limit(k)


def gallery(files: DataFrame, k: int = 20, media_type: str | None = None, album: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The newest k media of a kind, an album and a half-open range of time, each if it is named; files: id, media_type, album_name, occurred_at."""
    for column, value in (("media_type", media_type), ("album_name", album)):
        files = files if value is None else files.where(F.col(column) == value)
    at = F.col("occurred_at")
    files = files if start is None else files.where(at >= F.lit(start).cast("timestamp_ntz"))
    files = files if end is None else files.where(at < F.lit(end).cast("timestamp_ntz"))
    return files.orderBy(F.desc_nulls_last("occurred_at"), "id").limit(k)


def active_sources(sources: DataFrame, source_type: str | None = None) -> DataFrame:
    """Registered sources that are active, of one type if it is named, with their configuration as a map."""
    own = sources.where("is_active")
    own = own if source_type is None else own.where(F.col("source_type") == source_type)
    return own.withColumn("config", F.from_json("config", "map<string,string>"))
