"""Aggregates, series and top-n."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import aggregates as a
from millrace.operators import series as s
from millrace.operators.windows import latest_per_key, top_with_ties
from millrace.session import checkpointed
from millrace.sources.tables import load_table
from tests.conftest import rows

T0 = datetime(2024, 1, 1)


def test_levels_tell_nulls_from_subtotals(spark):
    df = spark.createDataFrame([("x", None, 1), ("x", "p", 2)], "d STRING, e STRING, v INT")
    found = a.aggregate_levels(df, ["d", "e"], {"total": F.sum("v")}, "rollup")
    assert rows(found, "level", "d", "e", "total") == [
        ("d", "x", None, 3),
        ("d+e", "x", None, 1),
        ("d+e", "x", "p", 2),
        ("total", None, None, 3),
    ]
    assert a.aggregate_levels(df, ["d", "e"], {"n": F.count("*")}, "cube").count() == 6
    pairs = {"s": ("sum", "v"), "n": ("count", "e"), "lo": ("min", "v"), "hi": ("max", "v")}
    columns = {"s": F.sum("v"), "n": F.count("e"), "lo": F.min("v"), "hi": F.max("v")}
    for mode in ("rollup", "cube", [["d"], []]):
        two_steps = a.aggregate_levels(df, ["d", "e"], pairs, mode)
        assert rows(two_steps) == rows(a.aggregate_levels(df, ["d", "e"], columns, mode))


def test_pivot_and_unpivot(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (2, "b", 7)], "i INT, c STRING, v INT")
    wide = a.pivot_table(df, ["i"], "c", ["a", "b", "c"], F.sum("v"))
    assert rows(wide) == [(1, 11, None, None), (2, None, 7, None)]
    assert a.unpivot_table(wide, ["i"], ["a", "b", "c"]).count() == 6
    assert rows(a.unpivot_table(wide, ["i"], ["a", "b"], False)) == [(1, "a", 11), (2, "b", 7)]


def test_mode_of_takes_the_smallest_on_a_tie(spark):
    df = spark.createDataFrame([("g", 2), ("g", 1), ("g", 1), ("g", 2), ("h", None)], "k STRING, v INT")
    assert rows(a.mode_of(df, ["k"], "v")) == [("g", 1, 2)]


@pytest.mark.parametrize("group_rows", [None, 30])
def test_exact_percentiles(events, group_rows):
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    found = a.exact_percentiles(events, ["user_id"], "value", probs, group_rows)
    pdf = events.toPandas()
    for row in found.collect():
        user = row["user_id"]
        group = pdf[pdf.user_id.isna() if user is None else pdf.user_id == user].value.dropna()
        for name, p in probs.items():
            assert row[f"{name}_cont"] == pytest.approx(np.quantile(group, p))
            assert row[f"{name}_disc"] == np.quantile(group, p, method="inverted_cdf")
    whole = a.exact_percentiles(events, [], "value", {"m": 0.5}, group_rows).first()
    assert whole["m_cont"] == pytest.approx(np.quantile(pdf.value.dropna(), 0.5))


def test_approx_profile_stays_within_its_bounds(spark):
    df = spark.range(20_000).select((F.col("id") % 5000).cast("double").alias("v"))
    df = df.unionByName(spark.range(5000).select(F.lit(7.0).alias("v")))
    row = a.approx_profile(df, [], "v", heavy=1).first()
    assert abs(row["approx_distinct"] - 5000) < 5000 * 0.1
    values = np.sort(df.toPandas().v.to_numpy())
    for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        lo, hi = np.searchsorted(values, [row[name]], "left")[0], np.searchsorted(values, [row[name]], "right")[0]
        assert lo / len(values) - 0.03 <= p <= hi / len(values) + 0.03
    assert row["heavy"][0]["item"] == 7.0


def test_merged_sketches_equal_one_pass(spark):
    """Distinct registers merge without loss; quantiles stay in bounds; groups without a value."""
    df = spark.range(60_000, numPartitions=6).select(
        (F.col("id") % 3).alias("g"),
        (F.col("id") % 20).alias("day"),
        F.when(F.col("id") % 3 != 2, F.pmod(F.xxhash64("id"), F.lit(7000)).cast("double")).alias("v"),
    )
    probs = {"q10": 0.1, "q50": 0.5}
    daily = checkpointed(a.sketch_table(df, ["g", "day"], "v"))
    assert daily.count() == 60
    merged = a.sketch_estimates(a.merge_sketches(daily, ["g"]), ["g"], probs)
    once = a.sketch_estimates(a.sketch_table(df, ["g"], "v"), ["g"], probs)
    plain = {r["g"]: r for r in once.collect()}
    for r in merged.collect():
        assert (r["rows"], r["nulls"]) == (plain[r["g"]]["rows"], plain[r["g"]]["nulls"]) == (20_000, 20_000 * (r["g"] == 2))
        if r["g"] == 2:
            assert r["approx_distinct"] == 0 and r["q50"] is None
            continue
        true = df.where(F.col("g") == r["g"]).agg(F.count_distinct("v")).first()[0]
        for found in (r, plain[r["g"]]):
            assert abs(found["approx_distinct"] - true) <= 0.064 * true
            assert abs(found["q10"] - 700) < 7000 * 0.04 and abs(found["q50"] - 3500) < 7000 * 0.04


def test_histogram_counts_every_row(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (4.9,), (5.0,), (10.0,), (None,)], "v DOUBLE")
    df = df.unionByName(df.sparkSession.sql("SELECT double(v) AS v FROM VALUES 'NaN', 'Infinity' t(v)"))
    found = a.histogram(df, "v", 0.0, 10.0, 2)
    assert rows(found, "bin", "rows") == [(-1, 1), (0, 1), (1, 2), (2, 1), (3, 3)]


def test_pareto_classes(spark):
    df = spark.createDataFrame([("a", 60), ("a", 10), ("b", 20), ("c", 5), ("d", 5)], "k STRING, v INT")
    for group_rows in (None, 1):
        found = a.pareto_classes(df, "k", "v", {"A": 0.5, "B": 0.95}, group_rows=group_rows)
        assert rows(found, "k", "position", "class") == [
            ("a", 1, "A"),
            ("b", 2, "B"),
            ("c", 3, "B"),
            ("d", 4, "C"),
        ]


def test_islands(spark):
    days = [1, 1, 2, 3, 7, 8, 20]
    data = [("u", T0 + timedelta(days=d, hours=i)) for i, d in enumerate(days)] + [("u", None)]
    found = s.islands(spark.createDataFrame(data, "k STRING, t TIMESTAMP"), ["k"], "t")
    assert rows(found) == [
        ("u", date(2024, 1, 2), date(2024, 1, 4), 3, 4),
        ("u", date(2024, 1, 8), date(2024, 1, 9), 2, 2),
        ("u", date(2024, 1, 21), date(2024, 1, 21), 1, 1),
    ]


def test_sessionize_matches_session_window(spark):
    rng = np.random.default_rng(5)
    seconds = rng.integers(0, 20_000, 400)
    data = [(int(i % 3), T0 + timedelta(seconds=int(x))) for i, x in enumerate(seconds)]
    data += [(9, T0), (9, T0 + timedelta(seconds=60)), (9, T0 + timedelta(seconds=121))]
    df = spark.createDataFrame(data, "k INT, t TIMESTAMP")
    found = s.sessionize(df, ["k"], "t", 60)
    builtin = df.groupBy("k", F.session_window("t", "60 seconds").alias("w")).count()
    expected = builtin.select("k", F.col("w.start"), F.col("w.end") - F.expr("INTERVAL 60 SECONDS"), "count")
    assert rows(found) == rows(expected)
    assert rows(found.where("k = 9"), "rows") == [(1,), (2,)]


def test_gap_fill(spark):
    df = spark.createDataFrame(
        [("a", datetime(2024, 1, 31), 1), ("a", datetime(2024, 2, 3), None), ("b", T0, 5)],
        "k STRING, t TIMESTAMP_NTZ, v INT",
    )
    days = [datetime(2024, 1, 31), datetime(2024, 2, 1), datetime(2024, 2, 2), datetime(2024, 2, 3)]
    expected = {"null": [1, None, None, None], "zero": [1, 0, 0, None], "last": [1, 1, 1, 1]}
    for fill, values in expected.items():
        found = s.gap_fill(df, ["k"], "t", "1 day", ["v"], fill)
        assert rows(found) == sorted(
            [("a", d, v) for d, v in zip(days, values, strict=True)] + [("b", T0, 5)]
        , key=lambda r: r[:2])


def test_gap_fill_makes_long_gaps_in_blocks_and_splits_keys(spark):
    df = spark.createDataFrame([(T0, 1), (T0 + timedelta(days=1), 2)], "t TIMESTAMP_NTZ, v INT")
    found = s.gap_fill(df, [], "t", "1 second", ["v"], "last")
    assert found.count() == found.select("t").distinct().count() == 86_401
    assert found.where("v = 1").count() == 86_400
    days = [("a", T0 + timedelta(days=i * i), i) for i in range(40)] + [("b", None, 1), ("b", T0, 2)]
    many = spark.createDataFrame(days, "k STRING, t TIMESTAMP_NTZ, v INT")
    whole = s.gap_fill(many, ["k"], "t", "1 day", ["v"], "last", None)
    assert rows(whole) == rows(s.gap_fill(many, ["k"], "t", "1 day", ["v"], "last", 5))
    assert rows(whole.where("k = 'b'")) == [("b", None, 1), ("b", T0, 2)]
    pieces = s.sessionize(many, ["k"], "t", 100_000, 5)
    assert rows(pieces) == rows(s.sessionize(many, ["k"], "t", 100_000, None))


def test_gap_fill_keeps_rows_off_the_grid(spark):
    df = spark.createDataFrame(
        [(T0, 1), (T0 + timedelta(hours=5), 2), (T0 + timedelta(days=1), 3)], "t TIMESTAMP_NTZ, v INT"
    )
    assert rows(s.gap_fill(df, [], "t", "1 day", ["v"]), "v") == [(1,), (2,), (3,)]


def test_period_change_ignores_older_periods(spark):
    data = [(datetime(2024, 1, 1), 10), (datetime(2024, 2, 1), 15), (datetime(2024, 4, 1), 30)]
    found = s.period_change(spark.createDataFrame(data, "m TIMESTAMP_NTZ, v INT"), [], "m", "v")
    assert rows(found, "m", "v", "previous", "change", "change_ratio") == [
        (datetime(2024, 1, 1), 10, None, None, None),
        (datetime(2024, 2, 1), 15, 10, 5, 0.5),
        (datetime(2024, 3, 1), None, 15, None, None),
        (datetime(2024, 4, 1), 30, None, None, None),
    ]


def test_gap_fill_makes_nothing_after_the_last_row(spark):
    ends = [(datetime(1900, 1, 1), 1), (datetime(2000, 1, 1), 2)]
    df = spark.createDataFrame(ends, "t TIMESTAMP_NTZ, v INT")
    found = s.gap_fill(df, [], "t", "50 years", ["v"], "zero")
    assert rows(found) == [(datetime(1900, 1, 1), 1), (datetime(1950, 1, 1), 0), (datetime(2000, 1, 1), 2)]
    one = spark.createDataFrame(ends[:1], "t TIMESTAMP_NTZ, v INT")
    assert rows(s.gap_fill(one, [], "t", "50 years", ["v"])) == ends[:1]


def test_period_change_equals_a_window_over_the_filled_table(spark):
    days = [("a", T0 + timedelta(days=i * i), i) for i in range(30)]
    days += [("b", T0 + timedelta(days=i, hours=i % 3), i * 7) for i in range(30)]
    df = spark.createDataFrame([*days, ("c", T0, 1)], "k STRING, t TIMESTAMP_NTZ, v INT")
    filled = s.gap_fill(df, ["k"], "t", "1 day", ["v"])
    before = F.lag("v").over(Window.partitionBy("k").orderBy("t"))
    expected = rows(filled.select("k", "t", "v", before.alias("previous")))
    for group_rows in (None, 7):
        found = s.period_change(df, ["k"], "t", "v", "1 day", group_rows)
        assert rows(found, "k", "t", "v", "previous") == expected


def test_calendar(spark):
    found = s.calendar(spark, date(2024, 2, 28), date(2024, 3, 1))
    assert rows(found, "day", "iso_week", "weekday", "is_month_end") == [
        (date(2024, 2, 28), 9, 3, False),
        (date(2024, 2, 29), 9, 4, True),
        (date(2024, 3, 1), 9, 5, False),
    ]


def test_top_with_ties(spark):
    df = spark.createDataFrame([(5,), (5,), (4,), (4,), (None,)], "v INT")
    assert rows(top_with_ties(df, ["v desc"], 3)) == [(4,), (4,), (5,), (5,)]
    assert top_with_ties(df, ["v desc"], 99).count() == 5
    assert rows(top_with_ties(df, ["v"], 2)) == [(None,), (4,), (4,)]
    assert top_with_ties(df.limit(0), ["v"], 2).count() == 0


def test_latest_per_key_limits_before_the_shuffle(spark, sf_dir):
    orders = load_table(spark, sf_dir, "orders")
    newest = latest_per_key(orders, ["o_custkey"], ["o_orderdate desc", "o_orderkey"])
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_gap_fill_counts_months_from_the_first_time(spark):
    ends = [datetime(2024, 1, 30), datetime(2024, 2, 29), datetime(2024, 5, 30)]
    df = spark.createDataFrame([(t, 1) for t in ends], "t TIMESTAMP_NTZ, v INT")
    found = s.gap_fill(df, [], "t", "1 month", ["v"])
    assert rows(found, "t") == [
        (datetime(2024, 1, 30),),
        (datetime(2024, 2, 29),),
        (datetime(2024, 3, 30),),
        (datetime(2024, 4, 30),),
        (datetime(2024, 5, 30),),
    ]
    dates = spark.createDataFrame([(date(2024, 1, 1), 1), (date(2024, 1, 22), 2)], "t DATE, v INT")
    filled = s.gap_fill(dates, [], "t", "1 week", ["v"], "zero")
    assert rows(filled) == [
        (date(2024, 1, 1), 1),
        (date(2024, 1, 8), 0),
        (date(2024, 1, 15), 0),
        (date(2024, 1, 22), 2),
    ]
    with pytest.raises(ValueError):
        s.gap_fill(df, [], "t", "fortnight", ["v"])
