from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators.changes import diff_tables, merge_snapshot, scd2_apply
from millrace.operators.hierarchy import hierarchy_closure
from tests.conftest import rows

T0 = datetime(2024, 1, 1)
HISTORY = "k INT, v STRING, valid_from TIMESTAMP, valid_to TIMESTAMP, is_current BOOLEAN"
CHANGES = "k INT, v STRING, ts TIMESTAMP"


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def test_diff_tables(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 3), (4, None, 4)], "k INT, v STRING, w INT")
    new = spark.createDataFrame([(1, "a", 1), (2, "c", 9), (None, "n", 3), (5, "e", 5)], "k INT, v STRING, w INT")
    found = diff_tables(old, new, ["k"])
    assert rows(found.withColumn("changed_columns", F.concat_ws(",", "changed_columns"))) == [
        (2, "changed", "v,w"),
        (4, "removed", ""),
        (5, "added", ""),
    ]
    assert diff_tables(old, old, ["k"]).isEmpty()
    with pytest.raises(Exception, match="occurs twice"):
        diff_tables(old, new.unionByName(new.limit(2)), ["k"]).collect()


def snapshot(spark, data):
    return spark.createDataFrame(data, "k INT, v STRING")


def test_merge_snapshot(spark):
    target = snapshot(spark, [(1, "a"), (2, "b"), (3, None), (None, "x")])
    source = snapshot(spark, [(2, "B"), (3, None), (4, "d"), (None, "y"), (None, "z")])
    assert rows(merge_snapshot(target, source, ["k"])) == [
        (None, "x", "kept"),
        (None, "y", "inserted"),
        (None, "z", "inserted"),
        (1, "a", "kept"),
        (2, "B", "updated"),
        (3, None, "unchanged"),
        (4, "d", "inserted"),
    ]
    actions = merge_snapshot(target, source, ["k"], "delete", "delete").where("k IS NOT NULL")
    assert rows(actions, "k", "action") == [
        (1, "deleted"),
        (2, "deleted"),
        (3, "deleted"),
        (4, "inserted"),
    ]
    with pytest.raises(Exception, match="occurs twice"):
        merge_snapshot(target, snapshot(spark, [(2, "p"), (2, "q")]), ["k"]).collect()


def test_merging_twice_changes_nothing(spark):
    target = snapshot(spark, [(1, "a"), (2, "b")])
    source = snapshot(spark, [(2, "B"), (3, "c")])
    once = merge_snapshot(target, source, ["k"]).drop("action")
    twice = merge_snapshot(once, source, ["k"])
    assert rows(twice.drop("action")) == rows(once)
    assert rows(twice.select("action").distinct()) == [("kept",), ("unchanged",)]


def test_scd2_late_change_splits_a_range(spark):
    history = spark.createDataFrame(
        [(1, "a", day(0), day(10), False), (1, "b", day(10), None, True), (2, "z", day(0), None, True)],
        HISTORY,
    )
    changes = spark.createDataFrame(
        [(1, "c", day(5)), (1, "b", day(12)), (3, "new", day(3))], CHANGES
    )
    found = scd2_apply(history, changes, ["k"], ["v"], "ts")
    expected = [
        (1, "a", day(0), day(5), False),
        (1, "c", day(5), day(10), False),
        (1, "b", day(10), None, True),
        (2, "z", day(0), None, True),
        (3, "new", day(3), None, True),
    ]
    assert sorted(rows(found), key=lambda r: (r[0], r[2])) == expected
    again = scd2_apply(found, changes, ["k"], ["v"], "ts")
    assert rows(again) == rows(found)


def test_scd2_keeps_ends_and_gaps(spark):
    history = spark.createDataFrame(
        [(1, "a", day(0), day(100), False), (2, "a", day(0), day(30), False), (2, "b", day(90), None, True)],
        HISTORY,
    )
    changes = spark.createDataFrame([(1, "b", day(50)), (2, "c", day(400))], CHANGES)
    expected = [
        (1, "a", day(0), day(50), False),
        (1, "b", day(50), day(100), False),
        (2, "a", day(0), day(30), False),
        (2, "b", day(90), day(400), False),
        (2, "c", day(400), None, True),
    ]
    for group_rows in (None, 1):
        found = scd2_apply(history, changes, ["k"], ["v"], "ts", group_rows)
        assert sorted(rows(found), key=lambda r: (r[0], r[2])) == expected


def test_merge_raises_whatever_is_read(spark):
    target = snapshot(spark, [(1, "a"), (2, "b")])
    merged = merge_snapshot(target, snapshot(spark, [(2, "p"), (2, "q")]), ["k"])
    for read in (merged.count, merged.select("k").collect):
        with pytest.raises(Exception, match="occurs twice"):
            read()


def test_scd2_takes_a_null_begin_and_equal_ends(spark):
    """A null begin comes first; two ranges that end at one time leave one end."""
    history = spark.createDataFrame(
        [(1, "a", None, day(5), False), (1, "b", day(2), day(5), False), (None, "n", day(0), None, True)],
        HISTORY,
    )
    changes = spark.createDataFrame([(1, "c", day(3)), (None, "m", day(1)), (None, "m", day(1))], CHANGES)
    expected = [
        (None, "m", day(1), None, True),
        (None, "n", day(0), day(1), False),
        (1, "a", None, day(2), False),
        (1, "b", day(2), day(3), False),
        (1, "c", day(3), day(5), False),
    ]
    for group_rows in (None, 1):
        found = rows(scd2_apply(history, changes, ["k"], ["v"], "ts", group_rows))
        assert sorted(found, key=lambda r: (r[0] is not None, r[1])) == expected


def test_scd2_reads_the_history_twice(spark, tmp_path):
    path = str(tmp_path / "history")
    spark.createDataFrame([(i % 7, "a", day(i), None, True) for i in range(70)], HISTORY).write.parquet(path)
    changes = spark.createDataFrame([(1, "b", day(200))], CHANGES)
    found = scd2_apply(spark.read.parquet(path), changes, ["k"], ["v"], "ts", None)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2


def test_scd2_clash_raises(spark):
    history = spark.createDataFrame([(1, "a", day(0), None, True)], HISTORY)
    changes = spark.createDataFrame([(1, "b", day(0))], CHANGES)
    with pytest.raises(Exception, match="two versions"):
        scd2_apply(history, changes, ["k"], ["v"], "ts").collect()


def test_scd2_ranges_never_overlap_and_split_agrees(spark):
    rng = random.Random(1)
    data = {(1 if i % 3 else rng.randint(2, 6), d): rng.choice("ab") for i, d in enumerate(range(300))}
    changes = spark.createDataFrame([(k, v, day(d)) for (k, d), v in data.items()], CHANGES)
    history = spark.createDataFrame([], HISTORY)
    plain = rows(scd2_apply(history, changes, ["k"], ["v"], "ts", None))
    assert plain == rows(scd2_apply(history, changes, ["k"], ["v"], "ts", 20))
    by_key = {}
    for k, v, start, end, current in plain:
        by_key.setdefault(k, []).append((start, end, v, current))
    for ranges in by_key.values():
        ranges.sort(key=lambda r: r[0])
        for (_, end, v, current), (start, _, w, _) in zip(ranges, ranges[1:], strict=False):
            assert end == start and v != w and not current
        assert ranges[-1][1] is None and ranges[-1][3]


def test_hierarchy_reports_a_cycle_once(spark):
    edges = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("b", "d"), (None, "x")],
        "parent STRING, child STRING",
    )
    found = hierarchy_closure(edges).withColumn("path", F.array_join("path", ""))
    assert rows(found.where("ancestor = 'a'")) == [
        ("a", "a", 3, "abca", True),
        ("a", "b", 1, "ab", False),
        ("a", "c", 2, "abc", False),
        ("a", "d", 2, "abd", False),
    ]


def test_hierarchy_depth_and_salting(spark):
    edges = spark.range(1, 200).select(
        F.when(F.col("id") < 150, 0).otherwise(F.col("id") - 100).alias("parent"),
        F.col("id").alias("child"),
    )
    plain = hierarchy_closure(edges)
    assert rows(plain) == rows(hierarchy_closure(edges, group_rows=20))
    assert plain.agg(F.max("depth")).first()[0] == 2
    assert hierarchy_closure(edges, max_depth=1).count() == 199


def test_hierarchy_paths_double(spark, monkeypatch):
    from millrace.operators import hierarchy

    rounds = []
    kept = hierarchy.checkpointed
    monkeypatch.setattr(hierarchy, "checkpointed", lambda df: rounds.append(1) or kept(df))
    chain = spark.range(120).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))
    found = hierarchy_closure(chain)
    assert found.count() == 120 * 121 // 2 and len(rounds) == 8
    assert found.where("depth = 120").first()["path"] == list(range(121))
    assert found.where("size(path) <> depth + 1 or path[0] <> ancestor").isEmpty()


def test_hierarchy_equals_walking_the_graph(spark):
    rng = random.Random(5)
    for size, count in ((5, 9), (7, 10), (9, 11)):
        edges = {(rng.randrange(size), rng.randrange(size)) for _ in range(count)}
        want, open_paths = [], [list(e) for e in edges]
        while open_paths:
            path = open_paths.pop()
            cycle = path[-1] in path[:-1]
            want.append((path[0], path[-1], len(path) - 1, "-".join(map(str, path)), cycle))
            if not cycle:
                open_paths += [[*path, b] for a, b in edges if a == path[-1]]
        df = spark.createDataFrame(sorted(edges), "parent INT, child INT")
        for limit in (None, 3):
            found = hierarchy_closure(df, limit).withColumn("path", F.array_join("path", "-"))
            assert rows(found) == sorted(w for w in want if limit is None or w[2] <= limit)
