"""Vectorised functions against plain Python."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import pandas_functions as p
from millrace.functions import trimmed as t
from tests.conftest import rows


def cells_of(values):
    v = np.asarray(values, float)
    return v, v, np.ones(len(v), np.int64), v


def exact(values, trim):
    v = np.sort(np.asarray(values, float))
    cut = len(v) * trim.numerator // trim.denominator
    return v[cut : len(v) - cut].mean()


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=80), min_size=1, max_size=6),
    st.sampled_from([Fraction(0), Fraction(1, 10), Fraction(29, 100), Fraction(49, 100)]),
    st.integers(2, 20),
)
def test_trimmed_bounds_hold_however_digests_are_merged(lists, trim, cells):
    parts = [t.joined_cells(*cells_of(values), cells) for values in lists]
    whole = t.joined_cells(*(np.concatenate(c) for c in zip(*parts, strict=True)), cells)
    assert len(whole[0]) <= cells + 1
    every = [v for values in lists for v in values]
    n, mean, low, high = t.trimmed_bounds(*whole, trim)
    assert n == len(every)
    assert low <= exact(every, trim) <= high
    assert low <= mean <= high


def test_trimmed_mean_over_many_tasks(spark):
    df = spark.range(40_000, numPartitions=9).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 4).alias("k"),
        F.when(F.col("id") % 100 == 7, float("nan"))
        .when(F.col("id") % 100 == 8, None)
        .when(F.col("id") % 100 == 9, float("inf"))
        .otherwise(F.pmod(F.xxhash64("id"), F.lit(10_007)).cast("double") ** 2)
        .alias("v"),
        F.lit("x").alias("mean"),
    )
    kept = {}
    for k, v in df.select("k", "v").collect():
        if v is not None and np.isfinite(v):
            kept.setdefault(k, []).append(v)
    found = {r["k"]: r for r in t.trimmed_mean(df, ["k"], "v", 0.1).collect()}
    assert found.keys() == kept.keys()
    for k, values in kept.items():
        r, true = found[k], exact(values, Fraction(1, 10))
        assert r["rows"] == len(values)
        assert r["mean_low"] <= true <= r["mean_high"]
        assert r["mean_high"] - r["mean_low"] < 0.02 * true
    whole = t.trimmed_mean(df, [], "v", 0.1).collect()
    every = sum(kept.values(), [])
    assert len(whole) == 1 and whole[0]["mean_low"] <= exact(every, Fraction(1, 10)) <= whole[0]["mean_high"]
    assert t.trimmed_mean(df.limit(0), ["k"], "v", 0.1).count() == 0
    with pytest.raises(ValueError):
        t.trimmed_mean(df, ["k"], "v", 0.5)


def test_words_take_batches(spark):
    data = [("  a b  a ", 2), ("", 3), (None, 4), ("one", 5), (" ", 1)]
    df = spark.createDataFrame(data, "text STRING, n BIGINT").coalesce(1)
    assert rows(p.Words(df.asTable())) == [("a", 1, 2), ("a", 3, 2), ("b", 2, 2), ("one", 1, 5)]
    assert p.Words(df.limit(0).asTable()).count() == 0


@pytest.mark.parametrize("by", [["user_id"], []])
def test_smoothing_in_pieces_equals_one_pass(events, by):
    """Null keys and values, a column of whole numbers with nulls, pieces without any value."""
    df = events.withColumn("big", F.when(F.col("event_id") % 2 == 0, F.col("event_id") + 2**53))
    df = df.withColumn("value", F.when(~F.col("event_id").between(200, 420), F.col("value")))
    df = df.withColumn("value", F.when(F.col("event_id") > 4, F.col("value")))
    groups = {}
    for r in df.orderBy("event_id").collect():
        groups.setdefault(tuple(r[c] for c in by), []).append(r)
    want = {}
    for members in groups.values():
        s = None
        for r in members:
            if r["value"] is not None:
                s = float(r["value"]) if s is None else 0.3 * r["value"] + 0.7 * s
            want[r["event_id"]] = (r["big"], s)
    for group_rows in (10**6, 30):
        found = p.smoothed(df, by, ["event_id"], "value", 0.3, group_rows=group_rows)
        assert found.columns == [*df.columns, "smoothed"]
        got = {r["event_id"]: (r["big"], r["smoothed"]) for r in found.collect()}
        assert got.keys() == want.keys()
        for i, (big, s) in want.items():
            assert got[i][0] == big
            assert got[i][1] == (None if s is None else pytest.approx(s, rel=1e-9))


def test_cogroup_gives_every_piece_its_row(spark):
    many = spark.createDataFrame(
        [(None if i % 5 == 0 else 1 if i % 2 else i % 40, float(i)) for i in range(2000)], "k INT, v DOUBLE"
    )
    one = spark.createDataFrame([(k, float(k + 1)) for k in range(60)] + [(None, 7.0)], "k INT, base DOUBLE")
    plain = many.join(one, "k", "left").select("k", "v", (F.col("v") / F.col("base")).alias("ratio"))
    for group_rows in (50, 100_000):
        found = p.attach_cogrouped(many, one, "k", "v", "base", group_rows)
        assert rows(found) == rows(plain)
