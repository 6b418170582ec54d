"""What the plans must look like: pushed filters, narrow scans, no nested loops, hot keys reduced before the shuffle."""

import contextlib
import datetime as dt
import io

import pytest

from __spark_entry__ import queries
from rowtide.operators import filters
from rowtide.plans.inputs import base
from rowtide.session import scratch_path
from rowtide.sources import sinks

QUERIES = queries()


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_time_filter_reaches_the_scan(spark, sf):
    text = plan(filters.recent(base(spark, sf, "events").select("event_id", "ts"), "ts", 3, "day", dt.datetime(2024, 1, 31)))
    assert "GreaterThanOrEqual(ts,2024-01-28T00:00)" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_month_filter_prunes_folders(spark, sf):
    path = scratch_path(spark, "pruned")
    sinks.write_month_partitioned(base(spark, sf, "orders"), path, "o_orderdate", ["o_orderkey"])
    df = spark.read.schema(base(spark, sf, "orders").schema.add("yyyymm", "string")).parquet(path)
    recent = filters.recent(df, "o_orderdate", 40, "day", dt.datetime(2001, 8, 1), month_col="yyyymm")
    assert "PartitionFilters: [isnotnull(yyyymm" in plan(recent)
    assert len(recent.inputFiles()) >= 1 and recent.select("yyyymm").distinct().count() <= 3


@pytest.mark.parametrize(
    "name", ["d4_latest_per_key_semi", "d5_latest_by_max_id", "d6_not_whitelisted", "d7_orphan_keys", "d12_either_key", "y3_window_replace", "y11_reconcile_rows", "x3_apply_changes", "m2_breaches"]
)
def test_no_pairwise_joins(spark, sf, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(QUERIES[name](spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["d4_latest_per_key_semi", "d5_latest_by_max_id", "y14_compact_latest", "x4_apply_key_change"])
def test_hot_keys_are_reduced_before_the_shuffle(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert text.index("WindowGroupLimit") < text.index("Exchange") or text.count("WindowGroupLimit") >= 2
    assert "Partial" in text


def test_row_comparison_shuffles_hashes_only(spark, sf):
    text = plan(QUERIES["y11_reconcile_rows"](spark, sf))
    assert "HashAggregate" in text and "SortMergeJoin" not in text


def test_ordered_operators_partition_by_key_and_chunk(spark, sf):
    for name in ("w3_runs", "w4_counter_delta", "w5_fail_streak"):
        text = plan(QUERIES[name](spark, sf))
        assert "SinglePartition" not in text and "_chunk" in text or "file_no" in text


def test_a_hot_month_is_written_by_several_tasks(spark):
    df = spark.range(200_000).selectExpr("id as order_id", "timestamp_ntz '2001-07-01 00:00:00' + make_dt_interval(if(id % 3 = 0, cast(id % 500 as int), 0)) as updated_at")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128k")
    try:
        path = scratch_path(spark, "hot")
        sinks.write_month_partitioned(df, path, "updated_at", ["order_id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = spark.read.format("binaryFile").load(f"{path}/yyyymm=200107").count()
    assert files > 3
    assert spark.read.parquet(path).count() == 200_000


@pytest.mark.parametrize("name", ["w3_runs", "w5_fail_streak"])
def test_rows_and_their_chunk_summary_share_one_shuffle(spark, sf, name):
    df = QUERIES[name](spark, sf)
    df.collect()
    assert "ReusedExchange" in plan(df)
