from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import joins as j
from tests.conftest import rows

T0 = datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + timedelta(minutes=minutes)


def table(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def quotes(spark):
    data = [("a", at(0), 1), ("a", at(10), 2), ("a", at(10), 3), ("b", at(5), 9), (None, at(0), 7)]
    data.append(("a", None, 8))
    return table(spark, data, "k STRING, qt TIMESTAMP, q INT")


@pytest.fixture(scope="module")
def trades(spark):
    data = [("a", at(-1), 1), ("a", at(0), 2), ("a", at(9), 3), ("a", at(25), 4), ("b", at(4), 5)]
    data += [("c", at(5), 6), (None, at(5), 7), ("a", None, 8)]
    return table(spark, data, "k STRING, tt TIMESTAMP, t INT")


@pytest.mark.parametrize("group_rows", [None, 1])
def test_asof_backward(trades, quotes, group_rows):
    found = j.asof_join(trades, quotes, ["k"], "tt", "qt", group_rows=group_rows)
    expected = [(1, None), (2, 1), (3, 1), (4, 3), (5, None), (6, None), (7, None), (8, None)]
    assert rows(found, "t", "q") == expected


@pytest.mark.parametrize("group_rows", [None, 1])
def test_asof_forward(trades, quotes, group_rows):
    found = j.asof_join(
        trades, quotes, ["k"], "tt", "qt", direction="forward", group_rows=group_rows
    )
    expected = [(1, 1), (2, 1), (3, 3), (4, None), (5, 9), (6, None), (7, None), (8, None)]
    assert rows(found, "t", "q") == expected


def test_asof_tolerance(trades, quotes):
    found = j.asof_join(trades, quotes, ["k"], "tt", "qt", tolerance=9 * 60)
    assert rows(found, "t", "q")[1:4] == [(2, 1), (3, 1), (4, None)]


def test_asof_many_rows_without_time_or_key(spark):
    """They go round the window: no task of the cut join gets more of them than of others."""
    left = [(k, None, i) for i in range(300) for k in (1, None)] + [(1, T0, -1)] * 2
    right = [(1, T0 - timedelta(minutes=1), 7), (1, None, 8), (None, T0, 9)]
    for direction, want in (("backward", 7), ("forward", None)):
        found = j.asof_join(
            table(spark, left, "k INT, lt TIMESTAMP, l INT"),
            table(spark, right, "k INT, rt TIMESTAMP, r INT"),
            ["k"], "lt", "rt", direction=direction, group_rows=50,
        )
        assert found.columns == ["k", "lt", "l", "rt", "r"]
        assert rows(found.where("l >= 0").select("k", "lt", "l", "r")) == rows(
            table(spark, [(k, t, i, None) for k, t, i in left[:-2]], "k INT, lt TIMESTAMP, l INT, r INT")
        )
        assert [r["r"] for r in found.where("l < 0").collect()] == [want] * 2


def test_asof_empty_right(trades, quotes):
    found = j.asof_join(trades, quotes.limit(0), ["k"], "tt", "qt")
    assert found.count() == 8 and found.where("q IS NOT NULL").isEmpty()


def test_asof_rejects_clashing_names(trades):
    with pytest.raises(ValueError):
        j.asof_join(trades, trades, ["k"], "tt", "tt")


@pytest.mark.parametrize("lo,hi", [(-120, 300), (0, 0), (60, 61), (-7200, -60)])
def test_interval_join(spark, lo, hi):
    rng = random.Random(7)
    left = [(rng.randint(0, 2), T0 + timedelta(seconds=rng.randint(0, 9000)), i) for i in range(80)]
    right = [(rng.randint(0, 2), T0 + timedelta(seconds=rng.randint(0, 9000)), i) for i in range(80)]
    found = j.interval_join(
        table(spark, [*left, (0, None, -1)], "k INT, lt TIMESTAMP, l INT"),
        table(spark, [*right, (0, None, -1)], "k INT, rt TIMESTAMP, r INT"),
        ["k"],
        "lt",
        "rt",
        lo,
        hi,
    )
    expected = sorted(
        (a[2], b[2])
        for a in left
        for b in right
        if a[0] == b[0] and lo <= (b[1] - a[1]).total_seconds() <= hi
    )
    assert rows(found, "l", "r") == expected


@pytest.mark.parametrize("bin_seconds", [1, 600, 10**7])
def test_overlap_join(spark, bin_seconds):
    rng = random.Random(3)

    def ranges(n):
        made = []
        for i in range(n):
            start = T0 + timedelta(seconds=rng.randint(0, 50_000))
            made.append((start, start + timedelta(seconds=rng.choice([0, 1, 60, 4000, 10**8])), i))
        return made

    left, right = ranges(60), ranges(60)
    found = j.overlap_join(
        table(spark, left, "ls TIMESTAMP, le TIMESTAMP, l INT"),
        table(spark, right, "rs TIMESTAMP, re TIMESTAMP, r INT"),
        ("ls", "le"),
        ("rs", "re"),
        bin_seconds,
    )
    expected = sorted(
        (a[2], b[2])
        for a in left
        for b in right
        if a[0] < a[1] and b[0] < b[1] and a[0] < b[1] and b[0] < a[1]
    )
    assert rows(found, "l", "r") == expected


def test_not_in(spark):
    left = table(spark, [(1,), (2,), (None,)], "k INT")
    with_null = table(spark, [(1,), (None,)], "k INT")
    plain = table(spark, [(1,)], "k INT")
    empty = table(spark, [], "k INT")
    assert rows(j.not_in(left, with_null, "k")) == []
    assert rows(j.not_in(left, plain, "k")) == [(2,)]
    assert rows(j.not_in(left, empty, "k")) == [(None,), (1,), (2,)]
    assert rows(j.not_in(left, with_null, "k", "ignore")) == [(None,), (2,)]


def test_top_n_per_row(spark):
    left = table(spark, [(1,), (1,), (2,), (3,)], "k INT")
    right = table(spark, [(1, 10), (1, 30), (1, 20), (2, 5)], "k INT, v INT")
    best = j.top_n_per_row(left, right, ["k"], ["v desc"], 2)
    assert rows(best) == [(1, 20), (1, 20), (1, 30), (1, 30), (2, 5)]
    assert rows(j.top_n_per_row(left, right, ["k"], ["v"], 1, outer=True)) == [
        (1, 10),
        (1, 10),
        (2, 5),
        (3, None),
    ]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain(spark, how, tmp_path):
    big = spark.range(3000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 1)
        .when(F.col("id") % 3 == 1, None)
        .otherwise(F.col("id") % 50)
        .alias("k"),
        F.lit("copy").alias("v"),
    )
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    small = small.unionByName(small.where("k = 1"))
    salted = j.salted_join(big, small, ["k"], 8, how, group_rows=100)
    plain = big.join(small, ["k"], how)
    assert salted.columns == plain.columns
    assert rows(salted) == rows(plain)
    salted.write.parquet(str(tmp_path / how))


def edits(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        line, last = [i], line
        for k, y in enumerate(b, 1):
            line.append(min(last[k] + 1, line[-1] + 1, last[k - 1] + (x != y)))
    return line[-1]


@pytest.mark.parametrize("budget", [50_000, 300, 0])
@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_fuzzy_join_finds_every_pair(spark, monkeypatch, distance, budget):
    """With a lower budget more texts, then all of them, go by their parts."""
    monkeypatch.setattr(j, "_VARIANT_BUDGET", budget)
    rng = random.Random(distance)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(120)]
    left = [(i % 2, x) for i, x in enumerate(words[:60])]
    right = [(i % 2, x) for i, x in enumerate(words[60:])]
    found = j.fuzzy_join(
        table(spark, [*left, (0, None)], "b INT, l STRING"),
        table(spark, [*right, (None, "aa")], "b INT, r STRING"),
        "b",
        "l",
        "r",
        distance,
    )
    expected = {
        (b, x, y, edits(x, y), left.count((b, x)), right.count((b, y)))
        for b, x in left
        for c, y in right
        if b == c and edits(x, y) <= distance
    }
    assert rows(found) == sorted(expected)
