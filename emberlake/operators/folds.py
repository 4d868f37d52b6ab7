"""Ordered folds: state that each row changes in a way no window function expresses.

Long folds (an agent's calls, a shard's lease) stream: rows are dealt by key, sorted
within partitions, and folded as they pass in Arrow batches, so a key's rows are never
held together. Short ones (repeats of one message) are native aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _streamed(rows: DataFrame, key: str, columns: list[str], added: list[tuple[str, str, pa.DataType]], start: Callable[[], object], fold: Callable[..., tuple]) -> DataFrame:
    """``rows`` (key, columns) in order of the columns within each key, with what ``fold(state, *columns)`` makes of each stretch of one key: (state, *lists)."""
    ordered = rows.select(key, *columns).repartition(key).sortWithinPartitions(key, *columns)
    kinds = dict(ordered.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in (key, *columns)] + [f"{name} {kind}" for name, kind, _ in added])
    names, types = [key, *columns, *(a[0] for a in added)], [a[2] for a in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for batch in batches:
            ends = np.flatnonzero(pc.not_equal(batch.column(0)[1:], batch.column(0)[:-1]).fill_null(True).to_numpy(zero_copy_only=False)) + 1 if batch.num_rows else []
            edges = [0, *(int(e) for e in ends), batch.num_rows]
            out: list[list] = [[] for _ in added]
            values = [c.to_pylist() for c in batch.columns[1:]]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi > lo:
                    if (k := batch.column(0)[lo].as_py()) != current:
                        current, state = k, start()
                    state, *parts = fold(state, *(v[lo:hi] for v in values))
                    for o, x in zip(out, parts, strict=True):
                        o += x
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names=names)

    return ordered.mapInArrow(run, schema)


def token_bucket(calls: DataFrame, rate: float, burst: float, key: str = "agent_id") -> DataFrame:
    """(key, t, id, cost, allowed, tokens, problem) from calls (key, t, id, cost), in order of (t, id).

    The bucket starts full and refills at ``rate`` a second up to ``burst``. A call
    passes if it can pay; one that cannot takes nothing. tokens: what is left after it.
    A cost that is null, not positive or more than the bucket ever holds is an error of
    the call, not a refusal: problem says so, and the bucket is not touched.
    """
    if not (math.isfinite(rate) and rate > 0 and math.isfinite(burst) and burst > 0):
        raise ValueError(f"rate and burst must be positive and finite: {rate}, {burst}")
    rate, burst = float(rate), float(burst)

    def fold(state, times, _, costs):
        tokens, last = state
        allowed, left, problem = [], [], []
        for t, cost in zip(times, costs, strict=True):
            wrong = cost is None or not 0 < cost <= burst
            if not wrong:
                if last is None:
                    last = t
                elif t > last:
                    tokens, last = min(burst, tokens + (t - last) * rate), t
            passes = not wrong and tokens >= cost
            if passes:
                tokens -= cost
            allowed.append(None if wrong else passes)
            left.append(tokens)
            problem.append("cost" if wrong else None)
        return (tokens, last), allowed, left, problem

    return _streamed(calls, key, ["t", "id", "cost"], [("allowed", "boolean", pa.bool_()), ("tokens", "double", pa.float64()), ("problem", "string", pa.string())], lambda: (burst, None), fold)


def lease_history(requests: DataFrame, ttl: int, key: str = "shard") -> DataFrame:
    """(key, t, id, owner, action, granted) from requests (key, t, id, owner, action), in order of (t, id).

    ``acquire`` is granted if nobody's lease is live or the caller holds it, and runs for
    ``ttl`` from then; ``release`` is granted to the holder of a live lease.
    """

    def fold(state, times, _, owners, actions):
        holder, until = state
        out = []
        for t, owner, action in zip(times, owners, actions, strict=True):
            live = holder is not None and until > t
            granted = live and holder == owner if action != "acquire" else not live or holder == owner
            if granted:
                holder, until = (owner, t + ttl) if action == "acquire" else (None, until)
            out.append(granted)
        return (holder, until), out

    return _streamed(requests, key, ["t", "id", "owner", "action"], [("granted", "boolean", pa.bool_())], lambda: (None, 0), fold)


def claims(messages: DataFrame, ttl: int, key: tuple[str, ...] = ("agent_id", "sequence")) -> DataFrame:
    """(key, t, id, claimed) from messages (key, t, id), in order of (t, id).

    The first message of an identity claims it for ``ttl`` seconds; until then repeats
    are refused and do not extend the claim; after that the next one claims it anew.
    """
    ordered = messages.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("t", "id"))).alias("_messages"))
    start = F.struct(F.lit(None).cast("long").alias("until"), F.array().cast("array<struct<t:bigint,id:bigint,claimed:boolean>>").alias("out"))

    def step(acc, m):
        free = acc["until"].isNull() | (m["t"] >= acc["until"])
        row = F.struct(m["t"].cast("long").alias("t"), m["id"].cast("long").alias("id"), free.alias("claimed"))
        return F.struct(F.when(free, m["t"] + ttl).otherwise(acc["until"]).cast("long").alias("until"), F.concat(acc["out"], F.array(row)).alias("out"))

    return ordered.select(*key, F.inline(F.aggregate("_messages", start, step, lambda acc: acc["out"])))
