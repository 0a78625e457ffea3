"""What Spark makes of the operators: pruning, pushdown, early limits."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from millrace.operators.aggregates import aggregate_levels
from millrace.operators.joins import asof_join, not_in, top_n_per_row
from millrace.operators.windows import rank_rows
from millrace.plans import QUERIES
from millrace.skew import plan_split
from millrace.sources.files import write_partitioned
from millrace.sources.tables import load_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def columns_read(df):
    found = re.findall(r"ReadSchema: struct<(.*?)>", plan(df))
    return [sorted(c.split(":")[0] for c in s.split(",")) for s in found]


def test_flagship_reads_only_what_it_uses(spark, sf_dir):
    read = columns_read(QUERIES["flagship_nation_revenue"](spark, sf_dir))
    assert ["l_discount", "l_extendedprice", "l_orderkey"] in read
    assert ["o_custkey", "o_orderkey"] in read


def test_filters_reach_the_scan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(QUERIES["b1_project_filter"](spark, sf_dir))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "GreaterThanOrEqual(o_totalprice,50000.0)" in pushed and "In(o_orderstatus" in pushed


def test_windows_without_large_groups_take_one_shuffle(spark, sf_dir):
    events = load_table(spark, sf_dir, "events")
    ranked = rank_rows(events, ["user_id"], ["ts"], 4)
    assert plan(ranked).count("Exchange hashpartitioning") == 1
    assert "Join" not in plan(ranked)


def test_asof_takes_one_shuffle(spark, sf_dir):
    events = load_table(spark, sf_dir, "events")
    right = events.select("user_id", F.col("ts").alias("rt"), F.col("value").alias("rv"))
    joined = asof_join(events, right, ["user_id"], "ts", "rt")
    assert plan(joined).count("Exchange hashpartitioning") == 1
    assert "Join" not in plan(joined)


def test_pieces_spread_a_large_group(spark, sf_dir):
    events = load_table(spark, sf_dir, "events").withColumn("k", F.col("user_id") * 0)
    split = plan_split(events, ["k"], ["ts"], 50)
    ranked = rank_rows(events, ["k"], ["ts"], split=split)
    assert re.search(r"Exchange hashpartitioning\(k#\d+L, _piece#\d+", plan(ranked))
    assert "NestedLoop" not in plan(ranked)


def test_top_n_is_cut_before_the_shuffle(spark, sf_dir):
    customer = load_table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    orders = load_table(spark, sf_dir, "orders")
    best = top_n_per_row(customer, orders, ["o_custkey"], ["o_totalprice desc", "o_orderkey"], 3)
    assert plan(best).count("WindowGroupLimit") == 2


def test_not_in_needs_no_null_aware_broadcast(spark, sf_dir):
    orders = load_table(spark, sf_dir, "orders")
    lines = load_table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in plan(not_in(orders, lines, "o_orderkey"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_levels_copy_rows_after_the_first_aggregate(spark, sf_dir):
    orders = load_table(spark, sf_dir, "orders")
    levels = aggregate_levels(
        orders, ["o_orderstatus", "o_orderpriority"], {"n": ("count", "o_orderkey")}, "cube"
    )
    text = plan(levels)
    assert text.index("Expand") < text.rindex("HashAggregate")


def test_partition_writes_are_rebalanced(spark, sf_dir, monkeypatch):
    seen = []
    frame = type(spark.range(1))
    original = frame.hint
    monkeypatch.setattr(frame, "hint", lambda df, *a: seen.append(original(df, *a)) or seen[-1])
    from millrace.session import scratch_path

    orders = load_table(spark, sf_dir, "orders")
    write_partitioned(orders, scratch_path(spark, "rebalanced"), ["o_orderstatus"])
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(seen[0])
