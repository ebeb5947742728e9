"""The data model: tables, enumerations, join edges and JSON columns, and what follows from them.

Where the two published descriptions of a table differ, a table here has the columns of both, and a column that only one
of them has is nullable.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Enumerations in their stored, lower-case form.
ENUMS: dict[str, tuple[str, ...]] = {
    "SourceType": ("google_takeout", "reddit", "whatsapp", "ynab", "generic", "manual"),
    "TimestampPrecision": ("year", "month", "day", "hour", "minute", "second"),
    "LinkType": ("same_time", "before", "after", "during", "same_location", "near", "related", "similar", "references", "reply_to", "quote", "mentions", "about", "sent_by", "received_by", "custom"),
    "EntityType": ("media", "chat_message", "email", "social_post", "social_comment", "knowledge_note", "calendar_event", "transaction", "location_visit", "browsing_history", "bookmark", "person"),
    "ImportStatus": ("pending", "running", "completed", "failed", "cancelled"),
    "AliasType": ("name", "email", "phone", "username", "social_handle"),
    "MessageType": ("text", "image", "video", "audio", "document", "sticker", "location", "contact", "poll", "system", "deleted", "other"),
    "ThreadType": ("direct", "group", "channel", "community"),
    "MediaType": ("image", "video", "audio", "document", "other"),
    "EmbeddingType": ("clip", "ocr", "caption", "audio_transcript"),
    "EmailFolder": ("inbox", "sent", "drafts", "trash", "spam", "archive", "starred", "important", "custom"),
    "Platform": ("reddit", "youtube", "twitter", "facebook", "instagram", "linkedin", "tiktok", "other"),
    "PostType": ("text", "link", "image", "video", "poll", "crosspost", "other"),
    "SubscriptionType": ("subreddit", "user", "channel", "page", "hashtag", "topic", "other"),
    "EventStatus": ("confirmed", "tentative", "cancelled"),
    "EventVisibility": ("default", "public", "private", "confidential"),
    "ResponseStatus": ("needs_action", "accepted", "declined", "tentative"),
    "AccountType": ("checking", "savings", "credit_card", "cash", "investment", "loan", "mortgage", "balance", "other"),
    "TransactionType": ("income", "expense", "transfer", "refund", "adjustment"),
    "LocationType": ("home", "work", "school", "gym", "restaurant", "store", "transit", "airport", "hotel", "attraction", "unknown", "other"),
}
#: Columns with an enumeration, by table and column or by column alone.
ENUM_COLUMNS: dict[str, str] = {
    "occurred_at_precision": "TimestampPrecision", "link_type": "LinkType", "import_runs.status": "ImportStatus", "alias_type": "AliasType", "message_type": "MessageType", "thread_type": "ThreadType",
    "media_type": "MediaType", "embedding_type": "EmbeddingType", "emails.folder": "EmailFolder", "platform": "Platform", "post_type": "PostType", "subscription_type": "SubscriptionType",
    "calendar_events.status": "EventStatus", "visibility": "EventVisibility", "response_status": "ResponseStatus", "account_type": "AccountType", "transaction_type": "TransactionType", "location_type": "LocationType",
    "entity_links.source_type": "EntityType", "entity_links.target_type": "EntityType",
}
#: Tables whose source_type is free text.
FREE_SOURCE = ("chat_threads", "locations", "location_visits", "location_history")
# Links that hold in both directions.
BIDIRECTIONAL = ("same_time", "same_location", "near", "related", "similar")
# Inclusive ranges by column.
RANGES: dict[str, tuple[float, float]] = {"latitude": (-90, 90), "longitude": (-180, 180), "confidence": (0, 1), "budgets.month": (1, 12)}
# jSON held as text.
JSON: dict[str, str] = {
    "chat_messages.reactions": "map<string,array<string>>", "knowledge_notes.linked_entities": "array<struct<entity_type:string,entity_id:string>>", "face_encodings.bounding_box": "array<int>",
    "chat_threads.participant_ids": "array<string>", "email_threads.participant_emails": "array<string>", "email_threads.labels": "array<string>",
    "emails.to_addresses": "array<string>", "emails.cc_addresses": "array<string>", "emails.bcc_addresses": "array<string>", "emails.labels": "array<string>",
    "calendar_events.reminder_minutes": "array<int>", "calendar_events.attachment_urls": "array<string>", "social_posts.media_urls": "array<string>", "social_posts.tags": "array<string>",
}

# Columns that several tables share.
SHARED: dict[str, str] = {
    "simple": "id string!, created_at timestamp!, updated_at timestamp!",
    "source": "source_type string!, source_id string, content_hash string",
    "time": "occurred_at timestamp, occurred_at_precision string! = second, source_timezone string",
    "place": "latitude double, longitude double, altitude double, location_name string",
}


@dataclass(frozen=True)
class Column:
    name: str
    kind: str
    required: bool
    default: str | None

    @property
    def type(self) -> T.DataType:
        if self.kind.startswith("vector"):
            return T.ArrayType(T.FloatType(), containsNull=False)
        if self.kind.startswith("decimal"):
            return T.DecimalType(*map(int, re.findall(r"\d+", self.kind)))
        return {"string": T.StringType, "int": T.IntegerType, "double": T.DoubleType, "boolean": T.BooleanType, "date": T.DateType, "timestamp": T.TimestampNTZType}[self.kind]()

    @property
    def length(self) -> int | None:
        """Components of a vector."""
        return int(self.kind.removeprefix("vector")) if self.kind.startswith("vector") else None


def _table(shared: str, own: str) -> tuple[Column, ...]:
    """Columns from "name type", with "!" for required ones and "= value" for defaults."""
    text = ", ".join([*(SHARED[s] for s in shared.split()), own])
    out = []
    for part in re.split(r", (?=[a-z_0-9]+ )", text):
        name, kind, must, default = re.fullmatch(r"(\w+) ([\w(),]+)(!?)(?: = (.+))?", part).groups()
        out.append(Column(name, kind, bool(must), default))
    return tuple(out)


# The tables' columns.
TABLES: dict[str, tuple[Column, ...]] = {
    "import_sources": _table(
        "simple",
        "source_type string!, name string!, description string, config string, is_active boolean! = true",
    ),
    "import_runs": _table(
        "",
        "id string!, source_id string!, started_at timestamp!, completed_at timestamp, status string! = pending, error_message string, entities_found int! = 0, entities_created "
        "int! = 0, entities_updated int! = 0, entities_skipped int! = 0, entities_failed int! = 0, progress_current int! = 0, progress_total int, current_file string",
    ),
    "people": _table(
        "simple",
        "display_name string!, photo_url string, date_of_birth date, notes string, is_self boolean! = false, merged_into_id string",
    ),
    "person_aliases": _table(
        "",
        "id string!, person_id string!, alias_type string!, value string!, normalized_value string, source_type string!, is_primary boolean! = false, confidence double! = 1.0, "
        "created_at timestamp!",
    ),
    "media": _table(
        "simple source time place",
        "tags string, file_path string!, original_filename string, file_size int, mime_type string, media_type string! = other, file_hash string, perceptual_hash string, width "
        "int, height int, duration_seconds double, exif_data string, camera_make string, camera_model string, ocr_text string, caption string, transcript string, source_url "
        "string, album_name string",
    ),
    "media_embeddings": _table(
        "",
        "id string!, media_id string!, embedding_type string!, model_name string!, embedding vector768!, created_at timestamp!",
    ),
    "face_encodings": _table(
        "",
        "id string!, person_id string!, media_id string!, embedding vector128!, bounding_box string, confidence double! = 1.0, is_confirmed boolean! = false, created_at timestamp!",
    ),
    "media_person_links": _table(
        "",
        "media_id string!, person_id string!, source_type string!, confidence double! = 1.0, is_confirmed boolean! = false, created_at timestamp!",
    ),
    "chat_threads": _table(
        "simple",
        "source_type string!, source_id string, thread_type string! = direct, name string, description string, participant_count int, participant_ids string, first_message_at "
        "timestamp, last_message_at timestamp, message_count int! = 0, is_archived boolean! = false, is_muted boolean! = false",
    ),
    "chat_messages": _table(
        "simple source time",
        "thread_id string!, sender_id string, sender_name string, sender_phone string, message_type string! = text, content string, content_json string, media_id string, "
        "media_caption string, reply_to_id string, forwarded_from string, is_from_me boolean! = false, is_read boolean! = false, is_starred boolean! = false, is_deleted boolean! = "
        "false, reactions string, tags string",
    ),
    "chat_thread_participants": _table(
        "",
        "thread_id string!, person_id string!, role string, nickname string, joined_at timestamp, left_at timestamp, is_active boolean! = true",
    ),
    "email_threads": _table(
        "simple source",
        "tags string, subject string, participant_count int! = 0, participant_emails string, email_count int! = 0, first_email_at timestamp, last_email_at timestamp, is_read "
        "boolean! = false, is_starred boolean! = false, is_important boolean! = false, labels string",
    ),
    "emails": _table(
        "simple source time",
        "thread_id string, message_id string, in_reply_to string, references string, sender_id string, from_address string!, from_name string, to_addresses string, cc_addresses "
        "string, bcc_addresses string, reply_to_address string, subject string, body_text string, body_html string, snippet string, folder string! = inbox, labels string, is_read "
        "boolean! = false, is_starred boolean! = false, is_important boolean! = false, is_draft boolean! = false, is_sent boolean! = false, is_spam boolean! = false, is_trash "
        "boolean! = false, attachment_count int! = 0, has_attachments boolean! = false, size_bytes int, tags string",
    ),
    "email_attachments": _table(
        "",
        "id string!, email_id string!, media_id string, filename string!, mime_type string, size_bytes int, content_id string, is_inline boolean! = false, created_at timestamp!, "
        "updated_at timestamp",
    ),
    "social_posts": _table(
        "simple source time",
        "platform string!, post_type string! = text, post_id string, url string, permalink string, author_id string, author_name string, is_own_post boolean! = false, "
        "community_name string, community_id string, title string, body string, body_html string, link_url string, link_domain string, media_id string, thumbnail_url string, "
        "media_urls string, score int, upvotes int, downvotes int, comment_count int, view_count int, share_count int, is_nsfw boolean! = false, is_spoiler boolean! = false, "
        "is_pinned boolean! = false, is_locked boolean! = false, is_archived boolean! = false, is_deleted boolean! = false, is_saved boolean! = false, is_liked boolean! = false, "
        "saved_at timestamp, flair string, tags string, crosspost_parent_id string",
    ),
    "social_comments": _table(
        "simple source time",
        "post_id string, platform string!, comment_id string, permalink string, author_id string, author_name string, is_own_comment boolean! = false, parent_comment_id string, "
        "depth int! = 0, body string, body_html string, post_title string, community_name string, score int, upvotes int, downvotes int, is_edited boolean! = false, edited_at "
        "timestamp, is_deleted boolean! = false, is_stickied boolean! = false, is_saved boolean! = false, is_liked boolean! = false, tags string",
    ),
    "subscriptions": _table(
        "",
        "id string!, created_at timestamp!, source_type string!, platform string!, subscription_type string!, target_id string, target_name string!, target_url string, "
        "target_description string, subscribed_at timestamp, unsubscribed_at timestamp, is_active boolean! = true, subscriber_count int, post_count int, notifications_enabled "
        "boolean! = true",
    ),
    "browsing_history": _table(
        "simple source time",
        "url string!, url_hash string, domain string, title string, favicon_url string, visit_duration_seconds int, transition_type string, referrer_url string, browser string, "
        "device string, search_query string, tags string",
    ),
    "bookmark_folders": _table(
        "",
        "id string!, created_at timestamp!, source_type string!, name string!, parent_id string, full_path string, position int, folder_created_at timestamp, folder_modified_at "
        "timestamp, updated_at timestamp",
    ),
    "bookmarks": _table(
        "simple source",
        "url string!, url_hash string, domain string, title string, description string, favicon_url string, icon_uri string, folder_id string, folder_path string, position int, "
        "bookmarked_at timestamp, is_favorite boolean! = false, is_archived boolean! = false, tags string",
    ),
    "knowledge_notes": _table(
        "simple",
        "source_type string, source_id string, content_hash string, occurred_at timestamp, note_type string, title string, content string!, content_html string, content_markdown string, is_task boolean, is_completed boolean, "
        "completed_at timestamp, due_at timestamp, priority int, folder string, labels string, keywords string, is_pinned boolean, is_archived boolean, is_trashed boolean, url "
        "string, linked_media_ids string, reminder_at timestamp, has_reminder boolean, embedding vector768, color string, tags string, created_by string, linked_entities string",
    ),
    "note_checklists": _table(
        "",
        "id string!, note_id string!, content string!, is_checked boolean!, position int!, created_at timestamp!",
    ),
    "locations": _table(
        "simple",
        "source_type string!, name string!, location_type string! = other, latitude double!, longitude double!, address string, street string, city string, state string, country "
        "string, postal_code string, place_id string, google_maps_url string, phone string, website string, notes string, person_id string",
    ),
    "location_visits": _table(
        "",
        "id string!, location_id string, source_type string!, latitude double!, longitude double!, accuracy_meters double, started_at timestamp!, ended_at timestamp, "
        "duration_minutes int, place_name string, address string, place_id string, activity_type string, confidence double",
    ),
    "location_history": _table(
        "",
        "id string!, source_type string!, latitude double!, longitude double!, altitude double, accuracy_meters double, vertical_accuracy double, timestamp timestamp!, speed_mps "
        "double, heading double, device_id string, source string",
    ),
    "calendar_events": _table(
        "simple source time place",
        "tags string, event_id string, ical_uid string, calendar_name string, summary string, description string, start_time timestamp!, end_time timestamp, is_all_day boolean! = "
        "false, timezone string, is_recurring boolean! = false, recurrence_rule string, recurring_event_id string, status string! = confirmed, visibility string! = default, "
        "location_text string, organizer_id string, organizer_email string, organizer_name string, my_response_status string, is_organizer boolean! = false, has_reminders boolean! "
        "= false, reminder_minutes string, conference_url string, conference_type string, attachment_urls string, event_created_at timestamp, event_updated_at timestamp, color "
        "string",
    ),
    "event_participants": _table(
        "",
        "id string!, event_id string!, person_id string, email string, display_name string, is_organizer boolean! = false, is_optional boolean! = false, response_status string! = "
        "needs_action, comment string, created_at timestamp!, updated_at timestamp",
    ),
    "accounts": _table(
        "simple source",
        "tags string, name string!, account_type string! = checking, institution string, current_balance decimal(12,2), currency string! = USD, account_number_last4 string, "
        "is_closed boolean! = false, closed_at timestamp, is_on_budget boolean! = true, is_tracking boolean! = false, notes string",
    ),
    "transactions": _table(
        "simple source time",
        "tags string, account_id string!, transaction_type string! = expense, amount decimal(12,2)!, currency string! = USD, payee string, payee_id string, description string, "
        "original_description string, category string, category_group string, is_cleared boolean! = false, is_reconciled boolean! = false, is_pending boolean! = false, is_transfer "
        "boolean! = false, transfer_account_id string, merchant_location string, latitude double, longitude double",
    ),
    "budgets": _table(
        "",
        "id string!, created_at timestamp!, source_type string!, year int!, month int!, category string!, category_group string, budgeted decimal(12,2)!, spent decimal(12,2)! = "
        "0.00, available decimal(12,2), carryover decimal(12,2)! = 0.00, currency string! = USD, updated_at timestamp",
    ),
    "entity_links": _table(
        "",
        "id string!, created_at timestamp!, source_type string!, source_id string!, target_type string!, target_id string!, link_type string!, custom_type string, confidence "
        "double! = 1.0, is_automatic boolean! = true, is_confirmed boolean! = false, notes string, link_metadata string, linker_name string, linker_version string",
    ),
    "tags": _table(
        "simple",
        "name string, display_name string, category string, description string, color string, icon string, parent_id string, full_path string, usage_count int, is_system "
        "boolean, is_hidden boolean",
    ),
    "tag_assignments": _table(
        "",
        "id string!, tag_id string!, entity_type string!, entity_id string!, created_at timestamp!, is_automatic boolean, confidence double, assigned_by string, updated_at "
        "timestamp",
    ),
    "tag_synonyms": _table(
        "",
        "id string!, tag_id string!, synonym string!, created_at timestamp!",
    ),
}

# Join edges as "table.column target", "?" where the column is nullable.
_EDGES = """
import_runs.source_id import_sources
people.merged_into_id people ?
person_aliases.person_id people
media_embeddings.media_id media
face_encodings.person_id people
face_encodings.media_id media
media_person_links.media_id media
media_person_links.person_id people
chat_messages.thread_id chat_threads
chat_messages.sender_id people ?
chat_messages.media_id media ?
chat_messages.reply_to_id chat_messages ?
chat_thread_participants.thread_id chat_threads
chat_thread_participants.person_id people
emails.thread_id email_threads ?
emails.sender_id people ?
email_attachments.email_id emails
email_attachments.media_id media ?
social_posts.author_id people ?
social_posts.media_id media ?
social_comments.post_id social_posts ?
social_comments.author_id people ?
social_comments.parent_comment_id social_comments ?
bookmark_folders.parent_id bookmark_folders ?
bookmarks.folder_id bookmark_folders ?
note_checklists.note_id knowledge_notes
location_visits.location_id locations ?
calendar_events.organizer_id people ?
event_participants.event_id calendar_events
event_participants.person_id people ?
transactions.account_id accounts
transactions.payee_id people ?
transactions.transfer_account_id accounts ?
tags.parent_id tags ?
tag_assignments.tag_id tags
tag_synonyms.tag_id tags
locations.person_id people ?
"""


@dataclass(frozen=True)
class Edge:
    """table.column refers to target.id; optional edges are joined by left joins."""

    table: str
    column: str
    target: str
    optional: bool


EDGES = tuple(Edge(*at.split("."), target, bool(rest)) for at, target, *rest in (line.split() for line in _EDGES.strip().splitlines()))


def columns(table: str) -> tuple[Column, ...]:
    if table not in TABLES:
        raise KeyError(f"no table {table}")
    return TABLES[table]


def schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(c.name, c.type, not c.required) for c in columns(table)])


def enum_of(table: str, column: str) -> tuple[str, ...] | None:
    """The values that a column may have, or None where it is free."""
    if column == "source_type" and f"{table}.{column}" not in ENUM_COLUMNS:
        return None if table in FREE_SOURCE else ENUMS["SourceType"]
    name = ENUM_COLUMNS.get(f"{table}.{column}") or ENUM_COLUMNS.get(column)
    return ENUMS[name] if name else None


def range_of(table: str, column: str) -> tuple[float, float] | None:
    return RANGES.get(f"{table}.{column}") or RANGES.get(column)


def edges_of(table: str) -> tuple[Edge, ...]:
    return tuple(e for e in EDGES if e.table == table)


def listing() -> list[tuple[str, str, str, bool, str | None, str | None]]:
    """The catalogue in order: table, column, type, required, default, and the table that the column refers to."""
    targets = {(e.table, e.column): e.target for e in EDGES}
    return [(t, c.name, c.kind, c.required, c.default, targets.get((t, c.name))) for t in sorted(TABLES) for c in sorted(columns(t), key=lambda c: c.name)]


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def fingerprint(table: str) -> str:
    """A digest of a table's columns, stored beside written tables to notice a changed model."""
    return hashlib.sha256(", ".join(f"{c.name} {c.kind} {c.required}" for c in columns(table)).encode()).hexdigest()[:16]
