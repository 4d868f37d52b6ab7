"""Streams give what batches give."""

import pytest
from pyspark.sql import functions as F

from emberlake.operators import activity
from emberlake.plans import catalogue
from emberlake.sources.derived import CONFIG
from emberlake.streaming import activity_stream as S

T0 = 1_800_000_000


def test_stream_equals_batch(spark, sf_dir):
    batch = catalogue.ip_state_timeline(spark, sf_dir)
    end = catalogue._now(spark, sf_dir).first()["now"]
    want = sorted(tuple(r) for r in activity.edges(batch).where(F.col("t") <= end).select("ip", "t", "phase", "total", "state").collect())
    got = sorted(tuple(r) for r in S.transitions_of_stored(spark, sf_dir).collect())
    assert got == want


def test_restart_continues(spark, tmp_path):
    """Two runs over one checkpoint: state carries over, nothing is emitted twice."""
    schema = "ip long, bucket long, requests long, at timestamp"
    rows = [(k, T0 + b, n) for k, b, n in [(1, 0, 150), (1, 3600, 60), (2, 0, 10), (1, 7200, 1), (2, 172800, 500), (1, 176400, 1), (3, 176400, 1)]]
    src = str(tmp_path / "in")
    put = lambda part: spark.createDataFrame(part, "ip long, bucket long, requests long").withColumn("at", F.timestamp_seconds("bucket")).coalesce(1).write.mode("append").parquet(src)
    put(rows[:3])
    stream = lambda: S.transitions(spark.readStream.schema(schema).parquet(src), CONFIG)
    run = lambda: S.run_to_end(stream(), str(tmp_path / "out"), str(tmp_path / "check"))
    first = sorted(map(tuple, run().collect()))
    assert first == [(1, T0 + 3600, 1, 210, 1)]
    put(rows[3:])
    assert sorted(map(tuple, run().collect())) == sorted([*first, (1, T0 + 172800, 0, 61, 0), (2, T0 + 172800, 1, 500, 1)])


def test_deduplicated_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1, 0), ("a", 1, 5), ("a", 2, 5), ("b", 1, 6)], "agent_id string, sequence long, s long").withColumn("at", F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(src)
    stream = S.deduplicated(spark.readStream.schema("agent_id string, sequence long, at timestamp").parquet(src), 60)
    out = S.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted((r["agent_id"], r["sequence"]) for r in out.collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_idempotent_sink(spark, tmp_path):
    write = S.idempotent_sink(str(tmp_path / "sink"), "event_id")
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "event_id string")
    write(frame(["a", "b", "b"]), 0)
    write(frame(["b", "c"]), 1)
    write(frame(["b", "c"]), 1)  # a batch repeated after a failure
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "sink")).collect()) == ["a", "b", "c"]
    few = S.idempotent_sink(str(tmp_path / "few"), "event_id", remember=1)
    frame = lambda *ids: spark.createDataFrame([(x,) for x in ids], "event_id string")
    for number, ids in enumerate((("a", "b"), ("b", "c"), ("c", "a"))):
        few(frame(*ids), number)
    assert sorted((r["batch"], r["event_id"]) for r in spark.read.parquet(str(tmp_path / "few")).collect()) == [(0, "a"), (0, "b"), (1, "c"), (2, "a")]
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_prefix_view_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    changes = [(169090561, 1), (169090562, 1), (169090561, 0)]
    spark.createDataFrame(changes, "ip long, state int").coalesce(1).write.parquet(src)
    seen = {}

    def keep(batch, _):
        seen.update({(r["length"], r["network"]): r["hot_count"] for r in batch.collect()})

    query = S.prefix_deltas(spark.readStream.schema("ip long, state int").parquet(src), 24).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen[24, 169090560] == 1 and seen[32, 169090562] == 1 and seen[32, 169090561] == 0


@pytest.mark.parametrize("late", [0, 1])
def test_late_delta_into_a_live_bucket(spark, tmp_path, late):
    """Deltas of one bucket add up, whatever batch they come in."""
    src = str(tmp_path / f"in{late}")
    parts = [[(1, T0, 120), (1, T0 + 3600, 1)], [(1, T0 + 3600, 90)]]
    for part in parts if late else [[x for p in parts for x in p]]:
        spark.createDataFrame(part, "ip long, bucket long, requests long").withColumn("at", F.timestamp_seconds("bucket")).coalesce(1).write.mode("append").parquet(src)
    out = S.run_to_end(S.transitions(spark.readStream.option("maxFilesPerTrigger", 1).schema("ip long, bucket long, requests long, at timestamp").parquet(src), CONFIG), str(tmp_path / "out"), str(tmp_path / "check"))
    assert [tuple(r) for r in out.collect()] == [(1, T0 + 3600, 1, 211, 1)]
