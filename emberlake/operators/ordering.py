"""Ordered work in two levels: within spans of a key, then over the spans.

A key that most rows share (a short prefix, a busy shard or agent) never has all its
rows in one task: a span of it has, and what the spans come to is one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a span of time.
SPAN = 86400


def _with_base(rows: DataFrame, keys: list[str], per_span: DataFrame, base: Column) -> DataFrame:
    """``rows`` with _span, joined with what the spans before a row's own come to, as _base."""
    other = per_span.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_span").alias("_span2"), base.alias("_base"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_span") == F.col("_span2")]
    return rows.join(other, on).drop(*[f"_{k}" for k in keys], "_span2")


def _earlier(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)


def _span_of(time: str | Column, span: int) -> Column:
    return F.floor(F.col(time) / span) if isinstance(time, str) else time


def running_sum(rows: DataFrame, keys: list[str], value: str, time: str | Column, order: list[str], span: int = SPAN) -> DataFrame:
    """Adds running: the sum of ``value`` up to each row of its key. ``time`` is the first column of the order, or a span number that grows with the order."""
    spans = rows.withColumn("_span", _span_of(time, span))
    totals = spans.groupBy(*keys, "_span").agg(F.sum(value).alias("_total"))
    inside = Window.partitionBy(*keys, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = _with_base(spans.withColumn("_inside", F.sum(value).over(inside)), keys, totals, F.coalesce(F.sum("_total").over(_earlier(keys)), F.lit(0)))
    return joined.withColumn("running", F.col("_base") + F.col("_inside")).drop("_span", "_base", "_inside")


def numbered(rows: DataFrame, keys: list[str], time: str | Column, order: list[str], name: str, span: int = SPAN) -> DataFrame:
    """Adds ``name``: the number of each row within its key, from 0."""
    return running_sum(rows.withColumn("_one", F.lit(1).cast("long")), keys, "_one", time, order, span).withColumn(name, (F.col("running") - 1).cast("long")).drop("_one", "running")


def previous(rows: DataFrame, keys: list[str], value: str, time: str, order: list[str], default: Column, name: str, span: int = SPAN) -> DataFrame:
    """Adds ``name``: ``value`` (never null) of the row before, within the key."""
    spans = rows.withColumn("_span", _span_of(time, span))
    lasts = spans.groupBy(*keys, "_span").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    inside = Window.partitionBy(*keys, "_span").orderBy(*order)
    joined = _with_base(spans.withColumn("_lag", F.lag(value).over(inside)), keys, lasts, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_span")))
    return joined.withColumn(name, F.coalesce("_lag", "_base", default)).drop("_span", "_lag", "_base")


def greatest_before(rows: DataFrame, keys: list[str], value: str, time: str, order: list[str], name: str, span: int = SPAN) -> DataFrame:
    """Adds ``name``: the greatest ``value`` of all rows before, within the key; null for the first."""
    spans = rows.withColumn("_span", _span_of(time, span))
    mosts = spans.groupBy(*keys, "_span").agg(F.max(value).alias("_most"))
    inside = Window.partitionBy(*keys, "_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = _with_base(spans.withColumn("_inside", F.max(value).over(inside)), keys, mosts, F.max("_most").over(_earlier(keys)))
    return joined.withColumn(name, F.greatest("_inside", "_base")).drop("_span", "_inside", "_base")
