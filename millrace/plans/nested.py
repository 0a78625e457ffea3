"""JSON, XML, nesting and collection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.nested import json_columns, nest, unnest, xml_columns
from millrace.plans.registry import as_double, query
from millrace.sources.tables import load_table


@query(
    "i1_json_columns",
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN NULL
                          ELSE CAST(json_extract(props, '$.k') AS DOUBLE) END AS k,
           event_type = 'error' AS is_bad
    FROM events
    """,
)
def json_text(spark, d):
    """The documents of one event type are cut off before the closing brace."""
    cut = F.expr("substr(props, 1, length(props) - 1)")
    doc = F.when(F.col("event_type") == "error", cut).otherwise(F.col("props"))
    events = load_table(spark, d, "events").select("event_id", doc.alias("doc"))
    return as_double(json_columns(events, "doc", "k INT").drop("doc"), "k")


@query(
    "i1_json_paths",
    """
    SELECT event_type, json_extract_string(props, '$.k') AS k,
           CAST(SUM(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS total, COUNT(*) AS n
    FROM events GROUP BY 1, 2
    """,
)
def json_paths(spark, d):
    events = load_table(spark, d, "events")
    parsed = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return events.groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(
        F.sum(parsed).alias("total"), F.count(F.lit(1)).alias("n")
    )


_LINE = ["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
_LINE_ORDER = [*_LINE, "l_suppkey", "l_shipdate", "l_discount", "l_tax"]


@query(
    "i2_nest_unnest",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem",
)
def nest_unnest(spark, d):
    lines = load_table(spark, d, "lineitem")
    return unnest(nest(lines, ["l_orderkey"], _LINE, _LINE_ORDER))


@query(
    "i2_nest",
    """
    SELECT l_orderkey, COUNT(*) AS items, MIN(l_linenumber) AS first_line,
           MAX(l_linenumber) AS last_line
    FROM lineitem GROUP BY l_orderkey
    """,
)
def nested(spark, d):
    orders = nest(load_table(spark, d, "lineitem"), ["l_orderkey"], _LINE, _LINE_ORDER)
    return orders.select(
        "l_orderkey",
        F.size("items").cast("long").alias("items"),
        F.element_at("items", 1)["l_linenumber"].alias("first_line"),
        F.element_at("items", -1)["l_linenumber"].alias("last_line"),
    )


@query(
    "i3_arrays_and_maps",
    """
    WITH a AS (SELECT l_orderkey, CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity,
                      COUNT(*) FILTER (WHERE l_quantity > 25) AS large,
                      COUNT(DISTINCT l_suppkey) AS suppliers,
                      MAX(l_quantity) FILTER (WHERE l_returnflag = 'R') AS returned_high
               FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, quantity, large, suppliers, coalesce(returned_high, -1) AS returned_high FROM a
    """,
)
def collections(spark, d):
    """Transform, filter, fold, set and map functions over nested lines."""
    columns = ["l_quantity", "l_suppkey", "l_returnflag"]
    order = ["l_linenumber", *_LINE_ORDER]
    parts = nest(load_table(spark, d, "lineitem"), ["l_orderkey"], columns, list(dict.fromkeys(order)))
    amounts = F.transform("items", lambda i: i["l_quantity"].cast("decimal(12,2)"))
    zero = F.lit(0).cast("decimal(22,2)")
    folded = F.aggregate(amounts, zero, lambda a, x: (a + x).cast("decimal(22,2)"))
    flags = F.array_distinct(F.transform("items", lambda i: i["l_returnflag"]))

    def high(flag):
        of_flag = F.filter("items", lambda i: i["l_returnflag"] == flag)
        return F.array_max(F.transform(of_flag, lambda i: i["l_quantity"]))

    highs = F.map_from_arrays(flags, F.transform(flags, high))
    return parts.select(
        "l_orderkey",
        folded.cast("double").alias("quantity"),
        F.size(F.filter("items", lambda i: i["l_quantity"] > 25)).cast("long").alias("large"),
        F.size(F.array_distinct(F.transform("items", lambda i: i["l_suppkey"])))
        .cast("long")
        .alias("suppliers"),
        F.coalesce(F.try_element_at(highs, F.lit("R")), F.lit(-1.0)).alias("returned_high"),
    )


@query(
    "i4_xml_columns",
    """
    SELECT o_orderkey, CAST(CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS DOUBLE) AS customer,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS priority,
           o_orderstatus = 'P' AS is_bad
    FROM orders
    """,
)
def xml_text(spark, d):
    """The documents of one order status lack their end tag."""
    orders = load_table(spark, d, "orders")
    end = F.when(F.col("o_orderstatus") == "P", "").otherwise("</order>")
    doc = F.concat(
        F.lit("<order><customer>"),
        F.col("o_custkey").cast("string"),
        F.lit("</customer><priority>"),
        F.col("o_orderpriority"),
        F.lit("</priority>"),
        end,
    )
    rows = orders.select("o_orderkey", doc.alias("doc"))
    parsed = xml_columns(rows, "doc", "customer BIGINT, priority STRING").drop("doc")
    return as_double(parsed, "customer")
