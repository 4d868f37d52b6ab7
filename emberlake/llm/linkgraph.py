"""URL filter: rules first, then trust and distrust spread over the host link graph.

Native DataFrame operations only. Hosts with pages that a rule allows are trusted
seeds, hosts with pages that a rule blocks are blocked seeds, in proportion to those
pages. Personalised PageRank carries trust along the links between hosts (a host
shares its trust among the hosts it links to), and distrust against them (a host
shares its distrust among the hosts that link to it). A host is blocked when its
distrust exceeds ``RATIO`` times its trust; a host that neither reaches is allowed.

Links are counted per pair of hosts before anything is joined, so the tables of the
iteration have a row for each pair of hosts, not for each page. Each iteration is
written to the shared folder; it ends when the values move by less than ``EPSILON``
in sum. Each moves them by ``DAMPING`` times what the one before did at most, so that
takes no more than ``ROUNDS``; a graph that needs more is an error.

Defined results: a null url, or one without ://, has an empty host and path and no
rule; a null html has no links; relative links and links within a host are no edges;
repeated pages count repeatedly; of two rules of equal length the first listed wins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.shared import cut, drop

#: (rule, verdict): a host and the beginning of a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
DAMPING = 0.85
EPSILON = 1e-6
#: Two vectors of sum 1 at most move by 4 at most in the first round.
ROUNDS = 2 + math.ceil(math.log(EPSILON / 4) / math.log(DAMPING))
RATIO = 1.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
_HREF = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in reversed(sorted(rules, key=lambda r: -len(r[0]))):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)))).alias("to"))
    absolute = F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))
    return links.select("src", host_of(absolute).alias("dst")).where("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, epsilon: float = EPSILON) -> DataFrame:
    """(kind, host, value) from (src, dst, links) and seeds (kind, host, value), kind being trust or distrust."""
    total = seeds.groupBy("kind").agg(F.sum("value").alias("_total"))
    start = cut(seeds.join(F.broadcast(total), "kind").where("_total > 0").select("kind", "host", (F.col("value") / F.col("_total")).alias("value")), "seeds")  # two rows of totals
    out = edges.groupBy("src").agg(F.sum("links").alias("_sum"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("_sum"))
    forward = edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("links") / F.col("_sum")).alias("share"))
    back = edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("links") / F.col("_sum")).alias("share"))
    flow = cut(forward.union(back), "flow")
    base = start.select("kind", "host", ((1 - damping) * F.col("value")).alias("value"))
    value, moved = start, 1.0
    if not flow.take(1):
        return start
    for _ in range(rounds):
        sent = value.join(flow, ["kind", "host"]).select("kind", F.col("to").alias("host"), (damping * F.col("value") * F.col("share")).alias("value"))
        fresh = cut(sent.union(base).groupBy("kind", "host").agg(F.sum("value").alias("value")), "ranks")
        change = fresh.union(value.select("kind", "host", -F.col("value"))).groupBy("kind", "host").agg(F.abs(F.sum("value")).alias("d"))
        moved = change.agg(F.sum("d")).first()[0]
        if value is not start:
            drop(value)
        value = fresh
        if moved < epsilon:
            return value
    raise ValueError(f"the values still move by {moved} after {rounds} rounds")


def host_verdicts(ranks: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(host, trust, distrust, host_verdict)."""
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("value")).otherwise(0.0))
    by_host = ranks.groupBy("host").agg(part("trust").alias("trust"), part("distrust").alias("distrust"))
    return by_host.withColumn("host_verdict", F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow"))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    ruled = rows.withColumn("rule", rule).withColumn("rule_verdict", verdict)
    seeds = ruled.where("rule is not null").groupBy("host", "rule_verdict").agg(F.count("*").cast("double").alias("value"))
    seeds = seeds.select(F.when(F.col("rule_verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host", "value")
    hosts = host_verdicts(propagate(cut(host_edges(pages), "host-edges"), seeds)).withColumnRenamed("host", "_host")
    judged = ruled.join(hosts, F.col("host") == F.col("_host"), "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "host_verdict", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op1_url_filter(pages: DataFrame) -> DataFrame:
    return judge_urls(pages)
