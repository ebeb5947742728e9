"""Text rules: normalised aliases, URLs, paths, headers, tokens, HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_GAP = r"[^\p{L}\p{N}]+"
# Extensions by kind of media.
EXTENSIONS = {
    "image": ("jpg", "jpeg", "png", "gif", "webp", "heic", "bmp", "tiff"),
    "video": ("mp4", "mov", "avi", "mkv", "webm"),
    "audio": ("mp3", "wav", "ogg", "opus", "m4a", "flac"),
    "document": ("pdf", "doc", "docx", "txt", "md", "odt", "html"),
}


# MIME types by extension.
MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "heic": "image/heic", "bmp": "image/bmp", "tiff": "image/tiff",
    "mp4": "video/mp4", "mov": "video/quicktime", "avi": "video/x-msvideo", "mkv": "video/x-matroska", "webm": "video/webm", "mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg", "opus": "audio/opus", "m4a": "audio/mp4", "flac": "audio/flac",
    "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "md": "text/markdown", "odt": "application/vnd.oasis.opendocument.text", "html": "text/html",
}


def alias(value: Column) -> Column:
    """The form in which names and addresses are compared."""
    return F.lower(F.trim(value))


def phone(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9+]", "")


def domain(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def search_query(url: Column) -> Column:
    """The decoded value of q in a search address."""
    return F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("q")))


def snippet(text: Column, length: int = 100) -> Column:
    return F.substring(F.regexp_replace(text, r"\s+", " "), 1, length)


def extension(path: Column) -> Column:
    """Lower-case extension of the last part of a path; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def mime_type(path: Column) -> Column:
    """By extension; null where that is unknown."""
    return F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))[extension(path)]


def type_of_mime(mime: Column) -> Column:
    """Kind of media of a MIME type: its first part, documents for text and application."""
    first = F.lower(F.regexp_extract(mime, "^([^/]+)/", 1))
    return F.when(first.isin("image", "video", "audio"), first).when(first.isin("text", "application"), "document").otherwise("other")


def media_type(path: Column) -> Column:
    ext, out = extension(path), F.lit("other")
    for kind, own in EXTENSIONS.items():
        out = F.when(ext.isin(*own), kind).otherwise(out)
    return out


def parent_path(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def message_ids(header: Column) -> Column:
    """The ids of a References header, in order."""
    return F.regexp_extract_all(header, F.lit("<[^>]+>"), 0)


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits; no stemming and no stop words."""
    return F.filter(F.split(F.lower(text), TOKEN_GAP), lambda x: x != "")


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title>\s*(.*?)\s*</title>", 1)


def html_text(html: Column) -> Column:
    """Text between tags, without scripts and styles, white space as single blanks."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def has_text(*columns: Column) -> Column:
    """Whether any of the columns has text; an empty string has none."""
    out = F.lit(False)
    for c in columns:
        out = out | (F.length(F.coalesce(c, F.lit(""))) > 0)
    return out


def entity_id(source_type: Column, source_id: Column) -> Column:
    """A stable id from where a record comes from, so that importing it again makes no second one."""
    h = F.sha2(F.concat_ws(":", source_type, source_id), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
