"""Event-time buckets and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, rounded down, whatever the session's zone."""
    return (F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def bucket_start(seconds: Column, bucket_seconds: int) -> Column:
    return seconds - F.pmod(seconds, F.lit(bucket_seconds).cast("long"))


def bucket_index(seconds: Column, bucket_seconds: int, bucket_count: int) -> Column:
    """Slot of a bucket in a ring of ``bucket_count``."""
    return F.pmod(F.floor(seconds / bucket_seconds), F.lit(bucket_count)).cast("int")


def is_aligned(micros: Column, bucket_seconds: int) -> Column:
    return F.pmod(micros, F.lit(bucket_seconds * 1_000_000)) == 0


def within_lateness(now: Column, start: Column, window_seconds: int, lateness_seconds: int) -> Column:
    return (now - start).between(0, window_seconds + lateness_seconds)


def is_live(now: Column, start: Column, window_seconds: int, bucket_seconds: int) -> Column:
    """Whether a bucket still counts: start in (bucket of now - window, bucket of now]."""
    age = bucket_start(now, bucket_seconds) - start
    return (age >= 0) & (age < window_seconds)


def parse_rfc3339(text: Column) -> Column:
    """A timestamp from ISO 8601 text with any offset; without one it is UTC; null if it is none."""
    zoned = F.when(text.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.try_to_timestamp(zoned)


def format_rfc3339(ts: Column) -> Column:
    """UTC with a Z; seconds, and six decimals if there is a fraction."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(utc, "SSSSSS")
    return F.concat(whole, F.when(part != "000000", F.concat(F.lit("."), part)).otherwise(F.lit("")), F.lit("Z"))
