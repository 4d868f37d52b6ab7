"""Structured Streaming form of the activity pipeline.

State is kept by address: a map of live buckets, and the current total and state.
Whatever is due is expired by row time before a row is added, as the batch form does;
event-time timers only serve addresses that fall quiet. Late rows are classified and
diverted beforehand; the watermark trails by the allowed lateness and a bucket, so no
row that was applied is dropped, and a quiet address's timer fires that much later (its
transition still carries the time at which the bucket ended).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberlake.config import DetectionConfig

TRANSITION = "ip long, t long, phase int, total long, state int"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class WindowProcessor(StatefulProcessor):
    """Sliding total and hysteresis of one address; emits its state changes."""

    def __init__(self, window_seconds: int, hot: int, cold: int):
        self.window, self.hot, self.cold = window_seconds, hot, cold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "bucket long", "requests long")
        self.status = handle.getValueState("status", "total long, state int")

    def _evaluate(self, ip: int, t: int, phase: int, total: int, state: int, out: list[tuple]) -> int:
        now = 1 if total >= self.hot else 0 if total < self.cold else state
        if now != state:
            out.append((ip, t, phase, total, now))
        return now

    def _run(self, ip: int, rows: list[tuple[int, int]], until: int | None, out: list[tuple]) -> None:
        total, state = (int(x) for x in self.status.get()) if self.status.exists() else (0, 0)
        live = {int(k[0]): int(v[0]) for k, v in self.buckets.iterator()}
        known = set(live)

        def expire(t: int) -> None:
            nonlocal total, state
            for b in sorted(b for b in live if b + self.window <= t):
                total -= live.pop(b)
                state = self._evaluate(ip, b + self.window, 0, total, state, out)

        for bucket, requests in sorted(rows):
            expire(bucket)
            live[bucket] = live.get(bucket, 0) + requests
            total += requests
            state = self._evaluate(ip, bucket, 1, total, state, out)
        if until is not None:
            expire(until)
        for b in known - set(live):
            self.buckets.removeKey((b,))
        for b, n in live.items():
            self.buckets.updateValue((b,), (n,))
        if not live and not state:
            self.status.clear()  # an idle COLD address leaves nothing behind
        else:
            self.status.update((total, state))
        for b in set(live) - known:
            self.handle.registerTimer((b + self.window) * 1000)

    def _frame(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=["ip", "t", "phase", "total", "state"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = [(int(b), int(n)) for part in rows for b, n in zip(part["bucket"], part["requests"], strict=True)]
        out: list[tuple] = []
        self._run(int(key[0]), got, None, out)
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out: list[tuple] = []
        self._run(int(key[0]), [], expiredTimerInfo.getExpiryTimeInMs() // 1000, out)
        yield from self._frame(out)

    def close(self) -> None:
        pass


def transitions(stream: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """State changes of a stream (ip, bucket, requests, at timestamp), as they happen. Start it within ``rocksdb_state``, as ``run_to_end`` does."""
    keyed = stream.withWatermark("at", f"{cfg.allowed_lateness_seconds + cfg.bucket_seconds} seconds").groupBy("ip")
    processor = WindowProcessor(cfg.window_seconds, cfg.hot_threshold, cfg.cold_threshold)
    schema = T.StructType([T.StructField("ip", T.LongType()), T.StructField("t", T.LongType()), T.StructField("phase", T.IntegerType()), T.StructField("total", T.LongType()), T.StructField("state", T.IntegerType())])
    return keyed.transformWithStateInPandas(processor, outputStructType=schema, outputMode="append", timeMode="EventTime")


def deduplicated(stream: DataFrame, ttl_seconds: int) -> DataFrame:
    """First of each (agent_id, sequence) within a time to live, by event time ``at``."""
    return stream.withWatermark("at", f"{ttl_seconds} seconds").dropDuplicatesWithinWatermark(["agent_id", "sequence"])


def prefix_deltas(changes: DataFrame, min_length: int = 8) -> DataFrame:
    """The materialised view of counts: hot_count of each prefix over a stream of changes (ip, state); use update mode."""
    from emberlake.operators.prefixes import ancestors

    signed = changes.withColumn("delta", F.when(F.col("state") == 1, 1).otherwise(-1).cast("long"))
    return ancestors(signed, min_length).groupBy("length", "network").agg(F.sum("delta").alias("hot_count"))


def idempotent_sink(path: str, key: str, remember: int | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer: each batch goes to its own folder, which a repeated batch overwrites; keys that other batches wrote are left out.

    ``remember``: how many batches back a key can come again; folders before those are
    not read, so the cost of a batch does not grow with the sink. None: all of them.
    """

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([key])
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(path).where(F.col("batch") != number)
            old = old if remember is None else old.where(F.col("batch") >= number - remember)
            fresh = fresh.join(old.select(key), key, "left_anti")
        except Exception as error:  # noqa: BLE001  the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session is then as before."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run over all there is, then stop: replay to readiness. What was written, read back."""
    with rocksdb_state(stream.sparkSession):
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A folder of its own in the one that driver and executors share."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir", None)
    if not where:
        if not conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="emberlake-streams-")
    return f"{where.rstrip('/')}/stream-{uuid.uuid4().hex}"


def transitions_of_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transitions of the stored events, computed as a stream over written buckets, up to the last bucket."""
    from emberlake.operators.activity import bucket_counts
    from emberlake.sources.derived import CONFIG, observations

    base = shared_folder(spark)
    buckets = bucket_counts(observations(spark, sf_dir))
    end = buckets.agg(F.max("bucket").alias("now"))  # one row
    past = CONFIG.allowed_lateness_seconds + 2 * CONFIG.bucket_seconds
    clock = end.where("now is not null").select(F.lit(-1).cast("long").alias("ip"), (F.col("now") + past).alias("bucket"), F.lit(0).cast("long").alias("requests"))
    rows = buckets.unionByName(clock).withColumn("at", F.timestamp_seconds("bucket"))  # the clock's row lets the timers up to the last bucket fire
    rows.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    out = run_to_end(transitions(stream, CONFIG), f"{base}/out", f"{base}/checkpoint")
    return out.crossJoin(F.broadcast(end)).where("t <= now").drop("now")


def view_of_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The materialised view of prefix counts over a stream of the stored transitions: the last update of each prefix."""
    from emberlake.plans.catalogue import _log

    base = shared_folder(spark)
    changes = _log(spark, sf_dir).select("ip", F.when(F.col("type") == "HotIpAdded", 1).otherwise(0).alias("state"))
    changes.write.parquet(f"{base}/in")
    view = prefix_deltas(spark.readStream.schema(changes.schema).parquet(f"{base}/in"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/view/batch={number}")

    query = view.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/view").groupBy("length", "network").agg(F.max_by("hot_count", "batch").alias("hot_count"))
