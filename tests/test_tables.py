"""Sources, sinks, checks and cleaning."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.cleaning import cast_quarantine, clean_keys
from millrace.operators.quality import check_constraints, profile
from millrace.session import scratch_path, shared_dir
from millrace.sources.files import load_since, read_csv_quarantine, write_partitioned
from millrace.sources.tables import SchemaDrift, check_schema, load_table
from tests.conftest import rows


def test_schema_drift_names_every_difference(spark, sf_dir):
    assert load_table(spark, sf_dir, "nation").count() == 25
    with pytest.raises(SchemaDrift) as error:
        load_table(spark, sf_dir, "nation", "n_nationkey BIGINT, n_name STRING, n_other INT")
    text = str(error.value)
    assert "missing n_other" in text and "unexpected n_regionkey" in text
    assert "n_nationkey is int, not bigint" in text
    check_schema(T.StructType([]), T.StructType([]), "empty")


def test_every_file_is_checked(spark):
    base = scratch_path(spark, "drift")
    spark.range(3).coalesce(1).write.parquet(f"{base}/t.parquet")
    extra = spark.range(3).withColumn("late", F.lit(1))
    extra.coalesce(1).write.mode("append").parquet(f"{base}/t.parquet")
    with pytest.raises(SchemaDrift, match="unexpected late"):
        load_table(spark, base, "t", "id BIGINT")
    assert load_table(spark, base, "t", "id BIGINT, late INT").count() == 6
    spark.range(3).select(F.col("id").cast("string")).write.mode("append").parquet(f"{base}/t.parquet")
    with pytest.raises(SchemaDrift):
        load_table(spark, base, "t", "id BIGINT, late INT")


def test_csv_quarantine_is_independent_of_the_columns_read(spark):
    path = scratch_path(spark, "csv")
    lines = ["1,2.5,x", "2,oops,y", "3,4.5", "4,1.0,z,extra", "5,,", ""]
    spark.createDataFrame([(x,) for x in lines], "value STRING").coalesce(1).write.text(path)
    good, bad = read_csv_quarantine(spark, path, "id INT, price DOUBLE, name STRING")
    assert rows(good) == [(1, 2.5, "x"), (5, None, None)]
    assert rows(good, "id") == [(1,), (5,)]
    assert good.count() == 2 and bad.count() == 3
    assert rows(bad) == [("2,oops,y",), ("3,4.5",), ("4,1.0,z,extra",)]


def test_csv_options_pass_through(spark):
    path = scratch_path(spark, "csv-header")
    spark.createDataFrame([("id;name\n1;a",)], "value STRING").coalesce(1).write.text(path)
    good, bad = read_csv_quarantine(spark, path, "id INT, name STRING", header=True, sep=";")
    assert rows(good) == [(1, "a")] and bad.count() == 0


def test_write_partitioned_keeps_other_partitions(spark):
    path = scratch_path(spark, "parts")
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "p INT, v STRING").transform(
        lambda df: write_partitioned(df, path, ["p"]) or df
    )
    write_partitioned(spark.createDataFrame([(1, "z")], "p INT, v STRING"), path, ["p"])
    assert rows(spark.read.parquet(path), "p", "v") == [(1, "z"), (2, "c")]


def test_load_since(spark):
    df = spark.range(10)
    delta, mark = load_since(df, "id", None)
    assert delta.count() == 10 and mark == 9
    delta, mark = load_since(df, "id", 6)
    assert rows(delta) == [(7,), (8,), (9,)] and mark == 9
    delta, mark = load_since(df, "id", 9)
    assert delta.count() == 0 and mark == 9


def test_check_constraints(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 50), (2, None, 7), (None, "b", 7)], "k INT, r STRING, n INT")
    parent = spark.createDataFrame([("a",), (None,)], "r STRING")
    found = check_constraints(
        df, unique=[["k"]], not_null=["k", "r"], refs=[("r", parent, "r")], ranges={"n": (6, 10)}
    )
    assert rows(found, "rule", "key", "rows") == [
        ("not_null(k)", '{"k":null}', 1),
        ("not_null(r)", '{"r":null}', 1),
        ("range(n)", '{"n":50}', 1),
        ("range(n)", '{"n":5}', 1),
        ("ref(r)", '{"r":"b"}', 1),
        ("unique(k)", '{"k":1}', 2),
    ]
    alike = [("a|b", "c"), ("a|b", "c"), ("a", "b|c"), ("a", "b|c"), (None, "x"), (None, "x"), ("NULL", "x"), ("NULL", "x")]
    found = check_constraints(spark.createDataFrame(alike, "p STRING, q STRING"), unique=[["p", "q"]])
    assert found.select("key").distinct().count() == 4
    with pytest.raises(ValueError):
        check_constraints(df)


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", [1]), (None, "b", [2]), (10, "b", None)], "n INT, s STRING, a ARRAY<INT>")
    expected = [
        ("a", 3, 1, 2, None, None),
        ("n", 3, 1, 2, "1", "10"),
        ("s", 3, 0, 2, "a", "b"),
    ]
    assert rows(profile(df)) == expected
    assert rows(profile(df, approx=True)) == expected
    assert rows(profile(df.limit(0)), "column", "rows", "nulls") == [
        ("a", 0, 0),
        ("n", 0, 0),
        ("s", 0, 0),
    ]


def test_cast_quarantine(spark):
    df = spark.createDataFrame([("1", "2024-01-02"), ("x", "nope"), (None, None)], "a STRING, d STRING")
    good, bad = cast_quarantine(df, {"a": "int", "d": "date"})
    assert dict(good.dtypes) == {"a": "int", "d": "date"}
    assert rows(good.withColumn("d", F.col("d").cast("string"))) == [(None, None), (1, "2024-01-02")]
    assert [tuple(r) for r in bad.collect()] == [("x", "nope", ["a", "d"])]
    own = df.withColumn("failed", F.lit("mine"))
    with pytest.raises(ValueError, match="name another"):
        cast_quarantine(own, {"a": "int"})
    good, bad = cast_quarantine(own, {"a": "int"}, "why")
    assert good.columns == ["a", "d", "failed"] and rows(bad, "failed", "a") == [("mine", "x")]


def test_clean_keys(spark):
    df = spark.createDataFrame([("  Foo--BAR\t9 ",), ("Ünïcode é!",), ("!!",), (None,)], "k STRING")
    assert rows(clean_keys(df, ["k"])) == [(None,), ("",), ("foo bar 9",), ("ünïcode é",)]


class Context:
    """Stands in for a context, with the folder a caller set on it."""

    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, context, setting=None):
        self.sparkContext = context
        self.conf = {"spark.checkpoint.dir": setting}


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(Session(Context("yarn"), "hdfs:/shared")) == "hdfs:/shared"
    assert shared_dir(Session(Context("yarn", "hdfs:/set"))) == "hdfs:/set"
    with pytest.raises(RuntimeError):
        shared_dir(Session(Context("yarn")))
    local = Session(Context("local[2]"))
    assert shared_dir(local) == shared_dir(local) != ""
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(shared_dir(spark).rstrip("/") + "/x-")
