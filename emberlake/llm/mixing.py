"""Mix sources to target weights: floor(rate) copies of each document plus one hash-seeded Bernoulli copy.

Native DataFrame operations only. Per-source sums are pre-aggregated before the
shuffle, so a source with a third of all rows costs no more than any other; the
sources themselves (one row each) meet in one window.

Defined results: a null text has size 0; a null source is a source of its own, last
in order; an empty table gives an empty table; rows that share a doc_id, or have none,
draw by their texts, equal rows the same number; other columns, whatever their names,
are passed through by ``mix``, unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.shared import cut, own_names

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def text_size(text: Column) -> Column:
    """Number of words separated by ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, target, rate) from (source, size).

    Sources in code-point order, null last, get the weights in turn. The total is
    shared by weight; no target exceeds ``cap`` times its source's size. What is cut
    off goes to the others by weight: with sources ordered by size per weight the
    capped ones are a prefix, so running sums give the final level directly.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    share = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    before = lambda c: F.coalesce(F.sum(c).over(fill), F.lit(0))
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", share)
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("size_before", before("source_size"))
        .withColumn("weight_before", before("weight"))
        .withColumn("capped", (cap * F.col("source_size")).cast("double") * (F.col("all_weight") - F.col("weight_before")) <= F.col("weight").cast("double") * (F.col("all_size") - cap * F.col("size_before")))
        .withColumn("free_size", F.col("all_size") - cap * F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(everything), F.lit(0)))
        .withColumn("free_weight", F.col("all_weight") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(everything), F.lit(0)))
        .withColumn("target", F.when(F.col("capped"), (cap * F.col("source_size")).cast("double")).otherwise((F.col("weight") * F.col("free_size")).cast("double") / F.nullif(F.col("free_weight"), F.lit(0))))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .select("source", "source_size", "target", "rate")
    )


def copies(rate: Column, doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """floor(rate), plus 1 with probability rate - floor(rate), drawn from a hash of the seed, doc_id and text."""
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit(""))))), 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies."""
    sizes = cut(docs.select("source", text_size(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "mix-sources")
    per = source_targets(sizes, weights, cap).withColumnRenamed("source", "_source")
    rows = docs.select("doc_id", "source", "text")
    out = rows.join(per, rows["source"].eqNullSafe(per["_source"]), "left")
    return out.select("doc_id", "source", text_size(F.col("text")).alias("size"), "source_size", "target", "rate", copies(F.col("rate"), F.col("doc_id"), F.col("text"), seed).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = SEED) -> DataFrame:
    """All columns of ``docs``, each row as many times as the mix takes it."""
    sizes = cut(docs.select("source", text_size(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "mix-sources")
    names = own_names(docs, "source", "rate", "copy")
    per = source_targets(sizes, weights, cap).select(F.col("source").alias(names["source"]), F.col("rate").alias(names["rate"]))
    out = docs.join(per, docs["source"].eqNullSafe(per[names["source"]]), "left")
    out = out.withColumn(names["copy"], F.explode(F.array_repeat(F.lit(1), copies(F.col(names["rate"]), F.col("doc_id"), F.col("text"), seed).cast("int"))))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS body FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1 AS weight FROM s),
a AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS all_size, CAST(sum(weight) OVER () AS BIGINT) AS all_weight,
  CAST(coalesce(sum(source_size) OVER f, 0) AS BIGINT) AS size_before, CAST(coalesce(sum(weight) OVER f, 0) AS BIGINT) AS weight_before
  FROM w WINDOW f AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (3 * source_size)::DOUBLE * (all_weight - weight_before) <= weight::DOUBLE * (all_size - 3 * size_before) AS capped FROM a),
t AS (SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE
  (weight * (all_size - 3 * coalesce(sum(source_size) FILTER (WHERE capped) OVER (), 0)))::DOUBLE / (all_weight - coalesce(sum(weight) FILTER (WHERE capped) OVER (), 0))::DOUBLE END AS target FROM c),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || body), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM r
"""


def op6_mixing(docs: DataFrame) -> DataFrame:
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
