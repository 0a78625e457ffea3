"""Cutting large groups must not change any result."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace import skew
from millrace.operators import windows as w
from millrace.operators.joins import salted_join
from tests.conftest import rows

ORDERS = [["ts"], ["ts desc"], ["value", "event_id desc"], ["value desc", "event_id"]]


def same(df_plain, df_split):
    columns = sorted(df_plain.columns)
    assert rows(df_plain, *columns) == rows(df_split, *columns)


@pytest.mark.parametrize("by", [["user_id"], []])
@pytest.mark.parametrize("order", ORDERS)
def test_rank_rows(events, by, order):
    same(
        w.rank_rows(events, by, order, 7, group_rows=None),
        w.rank_rows(events, by, order, 7, group_rows=40),
    )


def test_rank_rows_keeps_ties_together(events):
    columns = ["event_id", "rank", "dense_rank", "cume_dist", "percent_rank"]
    plain = w.rank_rows(events, ["user_id"], ["value desc"], group_rows=None)
    split = w.rank_rows(events, ["user_id"], ["value desc"], group_rows=20)
    assert rows(plain, *columns) == rows(split, *columns)


@pytest.mark.parametrize("by", [["user_id"], []])
@pytest.mark.parametrize("order", ORDERS)
def test_running(events, by, order):
    aggs = {
        "s": ("sum", "value"),
        "n": ("count", "value"),
        "lo": ("min", "value"),
        "hi": ("max", "value"),
        "t": ("total", "value"),
    }
    same(w.running(events, by, order, aggs, None), w.running(events, by, order, aggs, 40))


@pytest.mark.parametrize("by", [["user_id"], []])
@pytest.mark.parametrize("order", ORDERS)
def test_frame_rows(events, by, order):
    exprs = {
        "back": lambda x: F.lag("event_id", 2).over(x),
        "next": lambda x: F.lead("event_id").over(x),
        "high": lambda x: F.max("event_id").over(x.rowsBetween(-2, 3)),
    }
    same(
        w.frame_rows(events, by, order, exprs, 2, 3, None),
        w.frame_rows(events, by, order, exprs, 2, 3, 50),
    )


def test_output_names_do_not_hide_columns(events):
    named = events.withColumnRenamed("event_id", "rank")
    with pytest.raises(ValueError):
        w.rank_rows(named, ["user_id"], ["ts"])
    exprs = {"back": lambda x: F.lag("rank").over(x)}
    same(
        w.frame_rows(named, ["user_id"], ["ts"], exprs, 1, 0, None),
        w.frame_rows(named, ["user_id"], ["ts"], exprs, 1, 0, 40),
    )


def test_number_rows(events):
    for by in (["user_id"], []):
        same(
            w.number_rows(events, by, ["ts desc"], "n", None),
            w.number_rows(events, by, ["ts desc"], "n", 40),
        )


@pytest.mark.parametrize(("before", "after"), [(7200, 60), (0, 3600), (50, 0), (0, 0)])
def test_frame_range(events, before, after):
    aggs = {"high": ("max", "value"), "low": ("min", "value"), "n": ("count", "value"),
            "total": ("sum", "value"), "mean": ("avg", "value")}
    holes = events.withColumn("ts", F.when(F.col("event_id") % 50 != 0, F.date_trunc("minute", F.col("ts").cast("timestamp"))))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    functions = {"max": F.max, "min": F.min, "count": F.count, "sum": F.sum, "avg": F.avg}
    for by in (["user_id"], []):
        frame = Window.partitionBy(*by).orderBy(us).rangeBetween(-before * 1_000_000, after * 1_000_000)
        plain = holes.withColumns({o: functions[f](c).over(frame) for o, (f, c) in aggs.items()})
        for group_rows in (None, 60):
            same(plain, w.frame_range(holes, by, "ts", aggs, before, after, group_rows))


def test_one_wide_block_is_cut_by_size(spark):
    """One key and a frame as wide as the data: no piece holds much more than the threshold."""
    df = spark.range(6000, numPartitions=8).select(
        F.lit(1).alias("k"), F.timestamp_micros(F.col("id") * 1_000_000).alias("ts"), "id"
    )
    found = w.frame_range(df, ["k"], "ts", {"s": ("sum", "id"), "n": ("count", "id")}, 6000, 0, 1000)
    assert found.where("s <> id * (id + 1) / 2 OR n <> id + 1").count() == 0
    assert found.count() == 6000
    edges = df.select("k", F.unix_micros("ts").alias("_at"), F.lit(0).alias("_block"))
    split = skew.plan_split(edges, ["k", "_block"], ["_at desc"], 1000)
    assert split.tag(edges).groupBy(skew.PIECE).count().agg(F.max("count")).first()[0] < 2500


def test_dense_frames_take_time_in_proportion_to_rows(spark):
    def seconds(n):
        df = spark.range(n).select(
            F.lit(1).alias("k"), F.timestamp_micros((F.col("id") * 43_200_000_000 / n).cast("long")).alias("ts"), "id"
        )
        start = time.perf_counter()
        found = w.frame_range(df, ["k"], "ts", {"m": ("max", "id"), "n": ("count", "id")}, 21_600)
        found.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(400_000) < 60


def test_hot_keys_that_cannot_be_looked_up(spark):
    """A hot NaN, a hot array and a map column, at a threshold that splits them."""
    base = spark.range(600).select(
        F.when(F.col("id") % 3 != 0, F.lit(float("nan"))).otherwise(F.col("id") % 5).alias("x"),
        F.when(F.col("id") % 3 != 0, F.array(F.lit(1))).otherwise(F.array("id")).alias("a"),
        F.create_map(F.lit("k"), "id").alias("m"),
        "id",
    )
    for by in ("x", "a"):
        plain = w.number_rows(base, [by], ["id"], "rn", None)
        cut = w.number_rows(base, [by], ["id"], "rn", 20)
        assert rows(plain.select("id", "rn")) == rows(cut.select("id", "rn"))
    joined = salted_join(base, base.select("x").distinct().withColumn("t", F.lit(1)), ["x"], 4, group_rows=20)
    assert joined.count() == 600


@pytest.mark.parametrize("order", [["ts", "event_id"], ["ts desc", "event_id desc"]])
def test_fill_forward(events, order):
    for by in (["user_id"], []):
        same(
            w.fill_forward(events, by, order, ["value"], None),
            w.fill_forward(events, by, order, ["value"], 40),
        )


@pytest.mark.parametrize("following", [False, True])
def test_neighbour(events, following):
    args = (["user_id"], ["ts"], F.col("value"), "near", following)
    same(w.neighbour(events, *args, None), w.neighbour(events, *args, 40))


def test_pieces_are_small_and_ordered(events):
    split = skew.plan_split(events, ["user_id"], ["ts"], 20)
    tagged = split.tag(events)
    sizes = tagged.where(F.col(skew.PIECE).isNotNull()).groupBy("user_id", skew.PIECE).count()
    assert sizes.agg(F.max("count")).first()[0] < 100
    spans = tagged.groupBy("user_id", skew.PIECE).agg(
        F.min("ts").alias("lo"), F.max("ts").alias("hi")
    )
    a, b = spans.alias("a"), spans.alias("b")
    wrong = a.join(b, F.expr("a.user_id <=> b.user_id AND a._piece < b._piece AND a.hi >= b.lo"))
    assert wrong.isEmpty()


def test_many_cuts_use_three_levels(spark):
    df = spark.range(20_000)
    split = skew.plan_split(df, [], ["id"], 10)
    assert split.fan > 5
    tagged = split.tag(df)
    pieces = tagged.groupBy(skew.PIECE).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    found = [(r["lo"], r["hi"]) for r in pieces.orderBy(skew.PIECE).collect()]
    assert len(found) > 500
    assert all(hi + 1 == lo for (_, hi), (lo, _) in zip(found, found[1:], strict=False))


def test_no_split_without_a_large_group(events):
    split = skew.plan_split(events, ["user_id"], ["ts"])
    assert split.cuts is None and split.keys == ["user_id"]


def test_divide_cuts_copies(spark):
    df = spark.range(8000, numPartitions=16).select(F.lit("x").alias("k"), F.lit(1).alias("v"))
    pieces = skew.divide(df, ["k"], 1000)
    assert pieces.count() == 8000
    assert pieces.select(skew.PIECE).distinct().count() > 4


def test_order_text():
    assert skew.parse_order(["a", "b desc", "c asc"]) == [("a", False), ("b", True), ("c", False)]
    with pytest.raises(ValueError):
        skew.parse_order(["a down"])


def test_rank_rows_divides_rows_of_one_value(spark):
    from millrace.skew import PIECE, divide

    df = spark.range(20_000, numPartitions=8).select(
        F.lit(1).alias("k"), (F.col("id") % 2).cast("double").alias("v"), F.lit("copy").alias("w")
    )
    pieces = divide(df, ["k", "v"], 1000).groupBy("v", PIECE).count()
    assert pieces.agg(F.max("count")).first()[0] <= 2000
    ranked = w.rank_rows(df, ["k"], ["v desc"], 3, group_rows=1000)
    found = ranked.groupBy("v", "rank", "dense_rank", "cume_dist", "percent_rank").count()
    assert rows(found) == [
        (0.0, 10_001, 2, 1.0, 10_000 / 19_999, 10_000),
        (1.0, 1, 1, 0.5, 0.0, 10_000),
    ]
    numbers = ranked.agg(
        F.count_distinct("row_number"), F.min("row_number"), F.max("row_number"),
        F.max(F.when(F.col("v") == 1, F.col("row_number"))),
    ).first()
    assert tuple(numbers) == (20_000, 1, 20_000, 10_000)
    assert sorted(r["count"] for r in ranked.groupBy("ntile").count().collect()) == [6666, 6667, 6667]


def test_orders_of_all_types_are_cut_alike(spark):
    """Mixed directions over columns with nulls, ties, NaN and texts that begin like others."""
    i = F.col("id")
    some = F.when(i % 7 != 0, i * 37 % 60)
    df = spark.range(300).select(
        "id",
        F.lit("x").alias("k"),
        (some > 20).alias("flag"),
        some.cast("int").alias("whole"),
        F.when(i % 11 == 0, F.lit(float("nan"))).otherwise((some - 20) / 4).alias("real"),
        (some - 20).cast("decimal(9,3)").alias("exact"),
        F.date_add(F.lit("1970-01-20").cast("date"), -some.cast("int")).alias("day"),
        F.timestamp_micros(some - 30).alias("at"),
        F.timestamp_micros(some - 30).cast("timestamp_ntz").alias("plain"),
        F.substring(F.repeat(F.lit("aé\u0001"), 40), 1, some.cast("int")).alias("word"),
        F.array(some).alias("list"),
    )
    for n, c in enumerate(df.columns[2:]):
        by = [["k"], []][n % 2]
        cut, order = df.select(*by, "id", c), [f"{c} desc", "id"]
        split = skew.plan_split(cut, by, order, 10)
        assert split.pieces > 5
        found = w.number_rows(cut, by, order, "n", split=split).select("id", "n")
        same(w.number_rows(cut, by, order, "n", None).select("id", "n"), found)


@pytest.mark.parametrize("by", [["user_id"], []])
def test_tables_of_cuts_and_carries_too_big_to_broadcast(events, monkeypatch, by):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(skew, "BROADCAST_CUTS", 5)
    aggs = {"s": ("sum", "value"), "n": ("count", "value"), "t": ("total", "value")}
    args = (by, ["ts"], F.col("value"), "near", True)
    found = w.running(events, by, ["ts"], aggs, 40)
    same(w.running(events, by, ["ts"], aggs, None), found)
    same(w.neighbour(events, *args, None), w.neighbour(events, *args, 40))
    same(w.fill_forward(events, by, ["ts"], ["value"], None), w.fill_forward(events, by, ["ts"], ["value"], 40))
    # The window finds its rows where the join with the carries has put them.
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("ShuffledHashJoin [_piece") == 1 and "NestedLoop" not in text


def test_very_many_pieces_take_time_in_proportion_to_rows(spark):
    """A row meets a few nodes of a tree of cuts, not all cuts of its group."""
    df = spark.range(640_000, numPartitions=8).select("id", (F.col("id") % 2).cast("string").alias("k"))
    start = time.perf_counter()
    for by in ([], ["k"]):
        split = skew.plan_split(df, by, ["id"], 4)
        assert split.pieces > 30_000
        found = w.running(df, by, ["id"], {"n": ("count", "id")}, split=split)
        number = (F.floor(F.col("id") / 2) if by else F.col("id")) + 1
        assert found.agg(F.count_if(F.col("n") == number)).first()[0] == 640_000
    assert time.perf_counter() - start < 100


@pytest.mark.parametrize("broadcast", [skew.BROADCAST_ROWS, 5])
def test_frames_that_begin_and_end_where_no_rows_are(spark, monkeypatch, broadcast):
    """Bursts of rows whose frames' edges lie between them, in pieces that hold questions alone."""
    monkeypatch.setattr(skew, "BROADCAST_ROWS", broadcast)
    us = (F.col("id") % 3) * 40_000_000 + (F.col("id") / 3).cast("long") * 1000
    df = spark.range(1500, numPartitions=4).select(
        "id",
        F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("k"),
        F.when(F.col("id") % 50 > 0, F.timestamp_micros(us)).alias("ts"),
        F.when(F.col("id") % 4 > 0, (F.col("id") * 7 % 100).cast("decimal(5,2)")).alias("v"),
    )
    aggs = {"low": ("min", "v"), "n": ("count", "v"), "total": ("sum", "v"), "mean": ("avg", "v")}
    functions = {"min": F.min, "count": F.count, "sum": F.sum, "avg": F.avg}
    frame = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-61_000_000, 20_200_000)
    plain = df.withColumns({o: functions[f](c).over(frame) for o, (f, c) in aggs.items()})
    plain = plain.withColumns({"mean": F.col("mean").cast("double"), "total": F.col("total").cast("decimal(38,2)")})
    found = w.frame_range(df, ["k"], "ts", aggs, 61, 20.2, 40)
    assert found.schema["total"].dataType.simpleString() == "decimal(38,2)"
    mean = F.round("mean", 4)  # Spark's own is a decimal of some places
    same(plain.withColumn("mean", mean), found.withColumn("mean", mean))


def test_range_frames_shuffle_their_copies_once(spark):
    """Both running aggregates run over the same pieces: rows are copied once, not for each carry too."""
    df = spark.range(3000, numPartitions=4).select(F.lit(1).alias("k"), F.timestamp_seconds("id").alias("ts"), "id")
    found = w.frame_range(df, ["k"], "ts", {"m": ("max", "id")}, 500, 100, 100)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("Generate explode") == 2  # the copies, and the numbers of all pieces
