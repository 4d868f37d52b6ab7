"""Identifiers: event ids, partitions, keyed hashes."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "\x1f"
#: Fixed values of the 32-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
#: Slots that unknown agents are throttled by.
AGENT_SLOTS = 4096


def event_id(agent_id: Column, sequence: Column, event_type: Column, subject: Column | None = None) -> Column:
    """SHA-256 of the parts joined by the unit separator; a null subject is left out."""
    parts = [agent_id, sequence.cast("string"), event_type, *([subject] if subject is not None else [])]
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def dedup_key(agent_id: Column, sequence: Column) -> Column:
    return F.concat_ws(SEPARATOR, agent_id, sequence.cast("string"))


def fnv1a(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as BIGINT."""
    raw = F.hex(text.cast("binary"))
    byte = lambda i: F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    places = F.when(F.length(raw) > 0, F.sequence(F.lit(0), (F.length(raw) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(FNV_OFFSET).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * FNV_PRIME).bitwiseAND(F.lit(4294967295)))


def partition_for(key: Column, partitions: int) -> Column:
    return (fnv1a(key) % partitions).cast("int")


def keyed_hash(secret: bytes):
    """HMAC-SHA256 in hexadecimal, as a column function."""

    @F.pandas_udf(T.StringType())
    def digest(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else hmac.new(secret, t.encode(), hashlib.sha256).hexdigest())

    return digest


def agent_slot(secret: bytes, slots: int = AGENT_SLOTS):
    """The throttling slot of an agent id: its keyed hash modulo ``slots``."""

    @F.pandas_udf(T.IntegerType())
    def slot(text: pd.Series) -> pd.Series:
        return text.map(lambda t: int.from_bytes(hmac.new(secret, t.encode(), hashlib.sha256).digest(), "big") % slots)

    return slot
