"""Prefix counts over the hot set: roll-ups, changelogs, look-ups.

Containment is always an equality on (length, masked network) keys, never a range
join. Running counts are summed in two steps, within and across spans of time, so that
the short prefixes, which every change touches, do not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.functions.addressing import MIN_LENGTH, VIEW_LENGTHS, capacity, capacity_text, format_ipv6, format_prefix, hot_ratio, mask, mask_ipv6, unsigned_order
from emberlake.operators.ordering import numbered, running_sum


def ancestors(rows: DataFrame, min_length: int = MIN_LENGTH["ipv4"], max_length: int = 32, address: str = "ip") -> DataFrame:
    """Each row once for every prefix length, with the masked network."""
    out = rows.withColumn("length", F.explode(F.sequence(F.lit(min_length), F.lit(max_length))))
    return out.withColumn("network", mask(F.col(address), F.col("length")))


def prefix_counts(hot: DataFrame, min_length: int = MIN_LENGTH["ipv4"]) -> DataFrame:
    """(length, network, hot_count) of all prefixes with hot addresses, from distinct addresses (ip).

    Level by level: each length is counted from the next longer one, so the rows to
    move shrink on the way up.
    """
    level = hot.select(F.lit(32).alias("length"), F.col("ip").alias("network"), F.lit(1).cast("long").alias("hot_count"))
    spans = [32, 24, 16, 8, 0]
    out = None
    for top, bottom in zip(spans[:-1], spans[1:], strict=True):
        if top < min_length:
            break
        low = max(bottom + 1 if bottom else 0, min_length)
        lengths = F.explode(F.sequence(F.lit(low), F.lit(top)))
        part = level.select(lengths.alias("length"), F.col("network").alias("_from"), "hot_count")
        part = part.select("length", mask(F.col("_from"), F.col("length")).alias("network"), "hot_count").groupBy("length", "network").agg(F.sum("hot_count").alias("hot_count"))
        out = part if out is None else out.unionByName(part)
        level = level.select(F.lit(bottom).alias("length"), mask(F.col("network"), bottom).alias("network"), "hot_count").groupBy("length", "network").agg(F.sum("hot_count").alias("hot_count"))
    return out


def prefix_counts_ipv6(hot: DataFrame, min_length: int = MIN_LENGTH["ipv6"]) -> DataFrame:
    """(length, hi, lo, hot_count) of all IPv6 prefixes with hot addresses, from distinct addresses (hi, lo).

    Host routes are counted level by level as for IPv4; halves are masked apart.
    """
    level, out, top = hot.select("hi", "lo", F.lit(1).cast("long").alias("hot_count")), None, 128
    while top >= min_length:
        low = max(top - 7, min_length)
        rows = level.select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "hot_count", F.explode(F.sequence(F.lit(low), F.lit(top))).alias("length"))
        hi, lo = mask_ipv6(F.col("_hi"), F.col("_lo"), F.col("length"))
        part = rows.select("length", hi.alias("hi"), lo.alias("lo"), "hot_count").groupBy("length", "hi", "lo").agg(F.sum("hot_count").alias("hot_count"))
        out = part if out is None else out.unionByName(part)
        level, top = part.where(F.col("length") == low).drop("length"), low - 1
    return out


def with_stats_ipv6(counts: DataFrame) -> DataFrame:
    """Adds prefix, capacity as decimal text, hot_ratio, and order: the listing's sort key (longest first, then by address)."""
    prefix = F.concat(format_ipv6(F.col("hi"), F.col("lo")), F.lit("/"), F.col("length").cast("string"))
    order = F.struct(-F.col("length"), unsigned_order(F.col("hi")), unsigned_order(F.col("lo")))
    return counts.withColumn("prefix", prefix).withColumn("capacity", capacity_text(F.col("length"), 128)).withColumn("hot_ratio", hot_ratio(F.col("hot_count"), F.col("length"), 128)).withColumn("order", order)


def rolled_up(counts: DataFrame, length: int) -> DataFrame:
    """Counts of one length from counts of a longer one: parents are the sums of their parts."""
    return counts.groupBy(mask(F.col("network"), length).alias("network")).agg(F.sum("hot_count").alias("hot_count")).select(F.lit(length).alias("length"), "network", "hot_count")


def merged(*shards: DataFrame) -> DataFrame:
    """Counts of shards that hold different addresses, added."""
    every = shards[0]
    for s in shards[1:]:
        every = every.unionByName(s)
    return every.groupBy("length", "network").agg(F.sum("hot_count").alias("hot_count"))


def with_stats(counts: DataFrame) -> DataFrame:
    """Adds prefix, capacity and hot_ratio; the ratio is derived, never summed."""
    return counts.withColumn("prefix", format_prefix(F.col("network"), F.col("length"))).withColumn("capacity", capacity(F.col("length"))).withColumn("hot_ratio", hot_ratio(F.col("hot_count"), F.col("length")))


def effective_changes(log: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The events of a hot-address log that change the set: redundant adds and removes are no changes; the first must be an add."""
    before = F.lag("type", 1, "HotIpRemoved").over(Window.partitionBy("ip").orderBy(*order))
    return log.withColumn("_before", before).where("type != _before").drop("_before")


def stats_changelog(changes: DataFrame, min_length: int = MIN_LENGTH["ipv4"]) -> DataFrame:
    """A row for each effective change and ancestor, with the count after it: 25 for an IPv4 address."""
    signed = changes.withColumn("delta", F.when(F.col("type") == "HotIpAdded", 1).otherwise(-1).cast("long"))
    rows = running_sum(ancestors(signed, min_length), ["length", "network"], "delta", "t", ["t", "phase", "ip"])
    return with_stats(rows.withColumnRenamed("running", "hot_count"))


def latest_stats(changelog: DataFrame) -> DataFrame:
    """The newest row of each prefix."""
    return changelog.groupBy("length", "network").agg(F.max_by(F.struct("hot_count", "t"), F.struct("t", "phase", "ip")).alias("_last")).select("length", "network", "_last.*")


def hot_set(log: DataFrame, order: tuple[str, ...] = ("t", "phase")) -> DataFrame:
    """Addresses whose last event is an add, with what it carried; a redundant add replaces the record."""
    last = log.groupBy("ip").agg(F.max_by(F.struct("type", "attributes", "window_count", "t"), F.struct(*order)).alias("_last"))
    return last.where("_last.type = 'HotIpAdded'").select("ip", "_last.attributes", F.col("_last.window_count").alias("request_count"), F.col("_last.t").alias("since"))


def attribute_bytes(hot: DataFrame) -> DataFrame:
    return hot.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.octet_length("attributes")), F.lit(0)).alias("bytes"))


def log_position(log: DataFrame, keys: tuple[str, ...] = ("shard",)) -> DataFrame:
    """as_of and event_sequence of each shard: the greatest timestamp applied, and the last offset plus one."""
    return log.groupBy(*keys).agg(F.max("t").alias("as_of"), (F.max("sequence") + 1).alias("event_sequence"))


def node_counts(counts: DataFrame, hot: DataFrame) -> DataFrame:
    """Nodes of a binary trie (positive prefixes, the root included when not empty) and of a path-compressed one (2n - 1)."""
    n = hot.agg(F.count("*").alias("hot_ips"))
    return counts.agg(F.count("*").alias("binary_nodes")).crossJoin(n).withColumn("compressed_nodes", F.greatest(2 * F.col("hot_ips") - 1, F.lit(0)))  # one row each


def hot_counts_of(prefixes: DataFrame, counts: DataFrame) -> DataFrame:
    """(length, network) rows with their hot_count; 0 where nothing is hot."""
    return prefixes.join(counts.select("length", "network", "hot_count"), ["length", "network"], "left").withColumn("hot_count", F.coalesce("hot_count", F.lit(0).cast("long")))


def ancestor_counts(addresses: DataFrame, counts: DataFrame, min_length: int = 0) -> DataFrame:
    """Each address with its count at every length, zeros included."""
    return hot_counts_of(ancestors(addresses, min_length), counts)


def longest_match(addresses: DataFrame, counts: DataFrame) -> DataFrame:
    """The longest prefix of each address with hot addresses; null where none has any."""
    hits = ancestors(addresses.select("ip").distinct(), 0).join(counts.where("hot_count > 0").select("length", "network", "hot_count"), ["length", "network"])
    best = hits.groupBy("ip").agg(F.max_by(F.struct("length", "network", "hot_count"), "length").alias("_best"))
    return addresses.join(best, "ip", "left").select(*addresses.columns, "_best.*")


def preorder(counts: DataFrame) -> DataFrame:
    """Adds position, from 1, in a depth-first walk over all prefixes, branch 0 first. Numbers are dealt by /16, so no task walks the whole tree."""
    one = counts.withColumn("_tree", F.lit(0))
    return numbered(one, ["_tree"], F.shiftright("network", 16), ["network", "length"], "_nth").withColumn("position", F.col("_nth") + 1).drop("_tree", "_nth")


def declarations_in_order(declared: DataFrame) -> DataFrame:
    """Declared prefixes once each, shortest first, then by address: the order in which a path's declarations apply."""
    return declared.select("length", "network").distinct().orderBy("length", "network")


def view_lengths() -> tuple[int, ...]:
    return VIEW_LENGTHS
