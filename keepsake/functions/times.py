"""Time rules: what a timestamp means in UTC, and which span a precision stands for."""

from __future__ import annotations

from functools import lru_cache
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

PRECISIONS = ("year", "month", "day", "hour", "minute", "second")


@lru_cache(maxsize=1)
def zones() -> list[str]:
    """Names that count as time zones; offsets like +05:00 do not."""
    return sorted(available_timezones())


def is_zone(zone: Column) -> Column:
    return F.coalesce(zone.isin(zones()), F.lit(False))


def to_utc_field(at: Column) -> Column:
    """A field's own rule: a timestamp without zone already is UTC, whatever zone the row names."""
    return at.cast("timestamp_ntz")


def to_utc(at: Column, zone: Column) -> Column:
    """A local time of a named zone in UTC; without a zone, or with an unknown one, it already is UTC."""
    local = at.cast("timestamp_ntz")
    known = F.when(is_zone(zone), zone).otherwise(F.lit("UTC"))
    return F.convert_timezone(known, F.lit("UTC"), local)


def from_utc(at: Column, zone: Column) -> Column:
    """For display: a UTC time in a zone, or unchanged where the zone is unknown."""
    known = F.when(is_zone(zone), zone).otherwise(F.lit("UTC"))
    return F.convert_timezone(F.lit("UTC"), known, at.cast("timestamp_ntz"))


def parse_instant(text: Column) -> Column:
    """ISO text in UTC: an offset is applied, without one the text is UTC already; null where it can't be read."""
    body = F.regexp_replace(F.trim(text), r"\s*(Z|[+-]\d{2}:?\d{2})$", "")
    offset = F.regexp_extract(text, r"([+-])(\d{2}):?(\d{2})\s*$", 0)
    sign = F.when(F.substring(offset, 1, 1) == "-", F.lit(1)).otherwise(F.lit(-1))
    digits = F.regexp_replace(offset, "[^0-9]", "")
    minutes = F.when(F.length(digits) == 4, sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int"))).otherwise(F.lit(0))
    return body.try_cast("timestamp_ntz") + F.make_interval(mins=minutes)


def span_start(at: Column, precision: Column) -> Column:
    out = at.cast("timestamp_ntz")
    for p in PRECISIONS[:-1]:
        out = F.when(precision == p, F.date_trunc(p, at).cast("timestamp_ntz")).otherwise(out)
    return F.when(precision == "second", F.date_trunc("second", at).cast("timestamp_ntz")).otherwise(out)


def span_end(at: Column, precision: Column) -> Column:
    """The first instant behind the span that at stands for."""
    one = {p: F.expr(f"INTERVAL 1 {p.upper()}") for p in PRECISIONS}
    start = span_start(at, precision)
    out = start + one["second"]
    for p in PRECISIONS[:-1]:
        out = F.when(precision == p, start + one[p]).otherwise(out)
    return out.cast("timestamp_ntz")


def epoch_micros(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    local = at.cast("timestamp_ntz")
    days = F.unix_date(local.cast("date")).cast("bigint")
    seconds = (days * 24 + F.hour(local)) * 60 + F.minute(local)
    return seconds * 60_000_000 + (F.extract(F.lit("SECOND"), local) * 1_000_000).cast("bigint")


def epoch_seconds(at: Column) -> Column:
    return F.floor(epoch_micros(at) / 1_000_000).cast("bigint")


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes, null where an end is missing."""
    return ((epoch_micros(end) - epoch_micros(start)) / 60_000_000).cast("bigint")
