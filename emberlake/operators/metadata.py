"""Prefix metadata: declarations, inheritance down the path, conflicts.

A declaration is a row (length, network, key, kind, tag, bits, override). On the way
from /0 to an address, tags unite, bitmasks are or-ed, and the most specific override
wins. Declarations are operator input, a small dimension; they are joined on exploded
(length, network) keys, by broadcast while Spark finds them small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.functions.addressing import mask
from emberlake.operators.prefixes import ancestors


def combined(rows: DataFrame, by: list[str]) -> DataFrame:
    """Folds declaration rows of the same key: (by, key, kind, tags, bits, override)."""
    return rows.groupBy(*by, "key", "kind").agg(
        F.sort_array(F.collect_set("tag")).alias("tags"),
        F.bit_or("bits").alias("bits"),
        F.max_by("override", "length").alias("override"),
    )


def effective(addresses: DataFrame, declared: DataFrame) -> DataFrame:
    """What applies to each address (ip): everything declared on its path."""
    return combined(ancestors(addresses.select("ip"), 0).join(declared, ["length", "network"]), ["ip"])


def _path(prefixes: DataFrame, declared: DataFrame, strict: bool) -> DataFrame:
    own = prefixes.select(F.col("length").alias("own_length"), F.col("network").alias("own_network"))
    last = F.col("own_length") - 1 if strict else F.col("own_length")
    lengths = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return own.withColumn("length", F.explode(lengths)).withColumn("network", mask(F.col("own_network"), F.col("length"))).join(declared, ["length", "network"])


def local(prefixes: DataFrame, declared: DataFrame) -> DataFrame:
    """A prefix's own declaration."""
    return combined(prefixes.select("length", "network").join(declared, ["length", "network"]), ["length", "network"])


def inherited(prefixes: DataFrame, declared: DataFrame) -> DataFrame:
    """What strict ancestors declare."""
    return combined(_path(prefixes, declared, True), ["own_length", "own_network"])


def effective_for_prefix(prefixes: DataFrame, declared: DataFrame) -> DataFrame:
    """What ancestors and the prefix itself declare."""
    return combined(_path(prefixes, declared, False), ["own_length", "own_network"])


def conflicts(declared: DataFrame) -> DataFrame:
    """(length, network, key, kind, other_length, other_kind): declarations whose key has another kind on the same path."""
    own = declared.select("length", "network", "key", "kind").distinct()
    path = own.select(F.col("length").alias("own_length"), F.col("network").alias("own_network"), F.col("key").alias("own_key"), F.col("kind").alias("own_kind"), F.explode(F.sequence(F.lit(0), F.col("length"))).alias("_length"))
    above = path.withColumn("_network", mask(F.col("own_network"), F.col("_length")))
    on = (F.col("_length") == F.col("length")) & (F.col("_network") == F.col("network")) & (F.col("own_key") == F.col("key"))
    return above.join(own, on).where("own_kind != kind").select(F.col("own_length").alias("length"), F.col("own_network").alias("network"), F.col("own_key").alias("key"), F.col("own_kind").alias("kind"), F.col("length").alias("other_length"), F.col("kind").alias("other_kind"))


def declared_now(log: DataFrame) -> DataFrame:
    """The declarations in force after a log of (version, length, network, document or null): the newest document of each prefix, none if revoked."""
    last = log.groupBy("length", "network").agg(F.max_by(F.struct("document"), "version").alias("_last"))
    return last.where("_last.document is not null").select("length", "network", "_last.document")
