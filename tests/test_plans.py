"""Plans: pruned scans, no Python, no nested loops but over one-row tables, few exchanges."""

import re

import pytest
from pyspark.sql import functions as F

from emberlake.functions import addressing as A
from emberlake.plans import catalogue

#: Queries that join a single row of totals or of the current moment.
ONE_ROW = set("shard_gauges cold_eviction_candidates capacity_victims hot_set_current request_count_latest attribute_bytes log_positions prefix_counts prefix_counts_ipv6 prefix_stats prefix_rollup_hierarchical total_hot prefix_stats_changelog latest_prefix_stats hot_prefixes hot_prefixes_minimal classification_changes detections_since detection_gauges ancestor_counts longest_match ip_view prefix_view snapshot_plus_tail shard_merge audit_counts audit_records hot_prefix_walk".split())
PYTHON = {"canonical_attributes", "stream_equals_batch", "rate_limit_decisions", "lease_history"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - PYTHON))
def test_no_python_and_no_nested_loops(spark, sf_dir, name):
    text = plan(catalogue.queries()[name](spark, sf_dir))
    assert not re.search("Python|Pandas|Arrow", text)
    assert "CartesianProduct" not in text or name in ("total_hot", "detection_gauges")
    if name not in ONE_ROW:
        assert "NestedLoop" not in text


def test_scans_read_what_they_need(spark, sf_dir):
    text = plan(catalogue.bucket_counts(spark, sf_dir))
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", text)) == {"ts:timestamp_ntz,user_id:bigint,value:double"}


def test_few_exchanges(spark, sf_dir):
    count = lambda name: len(re.findall(r"Exchange hashpartitioning", plan(catalogue.queries()[name](spark, sf_dir))))
    assert count("bucket_counts") == 1 and count("sliding_window_total") == 2
    assert count("window_ticks") == count("ip_state_timeline") == count("ip_transitions")  # sums, states and edges share one


def test_containment_is_pushed_down(spark, tmp_path):
    spark.range(1000).withColumnRenamed("id", "ip").write.parquet(str(tmp_path / "p"))
    text = plan(spark.read.parquet(str(tmp_path / "p")).where(A.contains(F.lit(256).cast("long"), F.lit(24), F.col("ip"))))
    assert "GreaterThanOrEqual(ip,256)" in text and "LessThanOrEqual(ip,511)" in text
