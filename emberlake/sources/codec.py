"""JSON envelopes to rows and back, with native functions.

Integers may come as 5 or 5.0, not as "5" or true, so numbers are read as text and
checked by pattern. Payload fields that a type does not name are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.functions.hashing import event_id
from emberlake.functions.timebuckets import parse_rfc3339
from emberlake.sources.schemas import ENVELOPE

SCHEMA_VERSION = 1
_WHOLE = r"^-?[0-9]+(?:\.0+)?$"


def json_integer(raw: Column, path: str) -> Column:
    """A whole number at ``path`` of a JSON text; null for strings, booleans, fractions and what is missing."""
    text = F.get_json_object(raw, path)
    name = path.rsplit(".", 1)[-1]
    quoted = raw.rlike(rf'"{name}"\s*:\s*"')
    return F.when(~quoted & text.rlike(_WHOLE), F.split_part(text, F.lit("."), F.lit(1)).try_cast("bigint"))


def decimal_text(text: Column) -> Column:
    """Whether a text is a decimal number without sign or leading zeros, as capacities are written."""
    return F.coalesce(text.rlike("^(?:0|[1-9][0-9]*)$"), F.lit(False))


def decode(log: DataFrame, event_type: str, payload: str) -> DataFrame:
    """Rows of a log (…, value) with the envelope's columns, payload, and problem: why a value is unusable, null if it is fine.

    The event_id in the value is never trusted; it is computed again and compared.
    """
    body = F.from_json("value", f"{ENVELOPE}, payload struct<{_as_struct(payload)}>", {"mode": "PERMISSIVE"})
    out = log.withColumn("_e", body)
    e = lambda name: F.col(f"_e.{name}")
    rightful = event_id(e("agent_id"), e("sequence"), e("event_type"), e("subject"))
    problem = (
        F.when(F.try_parse_json("value").isNull(), "json")
        .when(json_integer(F.col("value"), "$.schema_version").isNull() | (e("schema_version") != SCHEMA_VERSION), "schema_version")
        .when(e("event_type").isNull() | (e("event_type") != event_type), "event_type")
        .when(e("agent_id").isNull() | e("sequence").isNull() | (e("sequence") < 0), "identity")
        .when(parse_rfc3339(e("timestamp")).isNull(), "timestamp")
        .when(e("payload").isNull(), "payload")
        .when(e("event_id").isNull() | (e("event_id") != rightful), "event_id")
    )
    names = [f.split()[0] for f in ENVELOPE.split(", ")]
    return out.select(*[log[c] for c in log.columns], *[e(n).alias(n) for n in names if n not in log.columns], e("payload").alias("payload"), problem.alias("problem"))


def _as_struct(ddl: str) -> str:
    """Column list to struct fields, at the top level only."""
    out, depth, field = [], 0, ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = field.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            field = ""
        else:
            field += ch
    return ", ".join(out)


def encode(rows: DataFrame, event_type: str, payload: list[str], subject: Column | None = None) -> DataFrame:
    """Adds event_id and value, compact JSON without null fields, to rows with agent_id, sequence, config_version and timestamp text."""
    subject = subject if subject is not None else F.lit(None).cast("string")
    ident = event_id(F.col("agent_id"), F.col("sequence"), F.lit(event_type), subject)
    body = F.struct(ident.alias("event_id"), "agent_id", "sequence", F.lit(event_type).alias("event_type"), "config_version", "timestamp", F.lit(SCHEMA_VERSION).alias("schema_version"), subject.alias("subject"), F.struct(*payload).alias("payload"))
    return rows.withColumn("event_id", ident).withColumn("value", F.to_json(body))


def observation_problem() -> Column:
    """For a decoded observation event: one entry, and its address equal to key and subject; null if so."""
    obs = F.col("payload.observations")
    return F.when(F.coalesce(F.size(obs), F.lit(0)) != 1, "entries").when(~(obs[0]["ip"].eqNullSafe(F.col("key")) & F.col("subject").eqNullSafe(F.col("key"))), "key")


def hot_ip_problem(families: tuple[str, ...] = ("ipv4", "ipv6")) -> Column:
    """For a decoded hot-address event: key and subject must be its address, and its family served."""
    ip = F.col("payload.ip")
    family = F.when(ip.contains(":"), "ipv6").otherwise("ipv4")
    return F.when(~(ip.eqNullSafe(F.col("key")) & F.col("subject").eqNullSafe(F.col("key"))), "key").when(~family.isin(*families), "family").when(~F.col("payload.type").isin("HotIpAdded", "HotIpRemoved"), "type")
