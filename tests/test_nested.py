from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions import pandas_functions as p
from millrace.operators.nested import json_columns, nest, unnest, xml_columns
from millrace.sources.tables import load_table
from tests.conftest import rows


def test_json_columns(spark):
    docs = ['{"k": 1, "s": "x"}', '{"k": "no"}', "{", "", None, '{"s": "y"}']
    df = spark.createDataFrame(list(enumerate(docs)), "i INT, doc STRING")
    found = json_columns(df, "doc", "k INT, s STRING")
    assert rows(found, "i", "k", "s", "is_bad") == [
        (0, 1, "x", False),
        (1, None, None, True),
        (2, None, None, True),
        (3, None, None, True),
        (4, None, None, False),
        (5, None, "y", False),
    ]


def test_xml_columns(spark):
    docs = ["<r><k>1</k></r>", "<r><k>x</k></r>", "<r><k>1</k>", None]
    df = spark.createDataFrame(list(enumerate(docs)), "i INT, doc STRING")
    found = xml_columns(df, "doc", "k INT")
    assert rows(found, "i", "k", "is_bad") == [
        (0, 1, False),
        (1, None, True),
        (2, None, True),
        (3, None, False),
    ]


def test_nest_then_unnest_gives_the_rows_back(spark, sf_dir):
    lines = load_table(spark, sf_dir, "lineitem")
    columns = ["l_linenumber", "l_partkey", "l_quantity"]
    order = [c for c in lines.columns if c != "l_suppkey"]
    plain = nest(lines, ["l_suppkey"], columns, order)
    assert plain.count() == lines.select("l_suppkey").distinct().count()
    assert rows(unnest(plain)) == rows(lines, "l_suppkey", *columns)
    with pytest.raises(Exception, match="more than 50 rows"):
        nest(lines, ["l_suppkey"], columns, order, max_items=50).collect()
    down = nest(lines, ["l_suppkey"], columns, [f"{c} desc" for c in order])
    backwards = down.withColumn("items", F.reverse("items"))
    assert rows(backwards.select("l_suppkey", F.to_json("items"))) == rows(
        plain.select("l_suppkey", F.to_json("items"))
    )


def test_unnest_keeps_other_columns_and_empty_parents(spark):
    df = spark.createDataFrame(
        [(1, "p", [(1, "x")]), (2, "q", []), (3, "r", None)],
        "k INT, part STRING, items ARRAY<STRUCT<a: INT, b: STRING>>",
    )
    assert rows(unnest(df)) == [(1, "p", 1, "x")]
    assert rows(unnest(df, outer=True), "k", "part", "a") == [(1, "p", 1), (2, "q", None), (3, "r", None)]


def test_root_mean_square_in_pieces(events):
    whole = p.root_mean_square(events, ["event_type"], "value")
    pieces = p.root_mean_square(events, ["event_type"], "value", group_rows=20)
    rounded = F.round("rms", 9)
    assert rows(whole.select("event_type", rounded)) == rows(pieces.select("event_type", rounded))


def test_grouped_and_cogrouped_in_pieces(spark, events):
    typed = events.withColumn("value", F.coalesce("value", F.lit(0)).cast("double"))
    plain = p.summarise_groups(typed, ["user_id"], "value")
    assert rows(plain) == rows(p.summarise_groups(typed, ["user_id"], "value", group_rows=20))
    builtin = typed.groupBy("user_id").agg(F.count("*"), F.min("value"), F.max("value"))
    assert rows(plain) == rows(builtin)

    keyed = typed.where("user_id IS NOT NULL").select("event_id", "user_id", "value")
    base = spark.createDataFrame([(i, float(i + 1)) for i in range(8)], "user_id BIGINT, base DOUBLE")
    expected = keyed.join(base, "user_id", "left").select(
        "event_id", "user_id", "value", F.col("value") / F.col("base")
    )
    for group_rows in (20, 10_000):
        found = p.attach_cogrouped(keyed, base, "user_id", "value", "base", group_rows)
        assert rows(found) == rows(expected)


def test_batch_totals(events):
    typed = events.withColumn("value", F.col("value").cast("double"))
    builtin = typed.groupBy("user_id").agg(F.count("*"), F.max("value"))
    assert rows(p.batch_totals(typed, "user_id", "value")) == rows(builtin)
