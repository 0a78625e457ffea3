"""User-defined functions: SQL, pandas, table and grouped."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.pandas_functions import (
    Words,
    attach_cogrouped,
    batch_totals,
    root_mean_square,
    scaled,
    smoothed,
    summarise_groups,
)
from millrace.functions.sql_functions import register_orders_of, register_sql_functions
from millrace.functions.trimmed import trimmed_mean
from millrace.operators.windows import rank_rows
from millrace.plans.registry import query
from millrace.sources.tables import load_table


@query(
    "u1_sql_scalar_function",
    """
    SELECT event_type, CASE WHEN value IS NULL THEN 'none' WHEN value < 10 THEN 'low'
                            WHEN value < 50 THEN 'middle' ELSE 'high' END AS band, COUNT(*) AS n
    FROM events GROUP BY 1, 2
    """,
)
def sql_scalar(spark, d):
    register_sql_functions(spark)
    events = load_table(spark, d, "events")
    band = F.expr("value_band(value)").alias("band")
    return events.select("event_type", band).groupBy("event_type", "band").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "u2_sql_table_function",
    """
    SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey
    WHERE o_totalprice >= 450000 AND c_mktsegment = 'BUILDING'
    """,
)
def sql_table(spark, d):
    # The function's body names a view, which must not be one of the session's own.
    load_table(spark, d, "orders").createOrReplaceTempView("millrace_u2_orders")
    register_orders_of(spark, "millrace_u2_orders")
    return spark.sql(
        """
        SELECT c_custkey, o_orderkey, o_totalprice
        FROM {customer}, LATERAL orders_of(c_custkey, 450000)
        WHERE c_mktsegment = 'BUILDING'
        """,
        customer=load_table(spark, d, "customer"),
    )


@query(
    "u3_pandas_scalar",
    "SELECT event_id, least(greatest(value, 0.0), 100.0) / 100.0 AS scaled FROM events",
)
def pandas_scalar(spark, d):
    return load_table(spark, d, "events").select("event_id", scaled("value").alias("scaled"))


@query(
    "u4_pandas_aggregate",
    "SELECT event_type, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY event_type",
)
def pandas_aggregate(spark, d):
    """The threshold is low, so every group is aggregated in pieces."""
    found = root_mean_square(load_table(spark, d, "events"), ["event_type"], "value", group_rows=500)
    return found.withColumn("rms", F.round("rms", 6))


@query(
    "u4_trimmed_mean",
    """
    SELECT event_type, COUNT(*) AS "rows", TRUE AS inside, TRUE AS narrow FROM events GROUP BY event_type
    """,
)
def trimmed(spark, d):
    """Whether the exact mean without a tenth at either end lies between the digest's bounds,
    and these within a hundredth of all values' range."""
    events = load_table(spark, d, "events").select("event_type", "event_id", "value")
    found = trimmed_mean(events, ["event_type"], "value", 0.1)
    ranked = rank_rows(events, ["event_type"], ["value", "event_id"])
    cut = F.floor(F.col("group_rows") / 10)
    kept = F.when(F.col("row_number").between(cut + 1, F.col("group_rows") - cut), F.col("value"))
    exact = ranked.groupBy("event_type").agg(
        F.avg(kept).alias("_exact"), (F.max("value") - F.min("value")).alias("_range")
    )
    return found.join(exact, "event_type").select(
        "event_type",
        "rows",
        F.col("_exact").between(F.col("mean_low"), F.col("mean_high")).alias("inside"),
        (F.col("mean_high") - F.col("mean_low") <= F.col("_range") / 100).alias("narrow"),
    )


@query(
    "u5_table_function",
    """
    SELECT word, place, COUNT(*) AS n FROM
      (SELECT unnest(string_split(p_name, ' ')) AS word,
              unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS place FROM part)
    GROUP BY word, place
    """,
)
def table_function(spark, d):
    """Copies of a name are counted first, so Python sees each name once, in Arrow batches."""
    names = load_table(spark, d, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    return Words(names.asTable()).groupBy("word", "place").agg(F.sum("n").alias("n"))


@query(
    "u6_grouped_map",
    """
    SELECT user_id, COUNT(*) AS "rows", MIN(value) AS low, MAX(value) AS high
    FROM events GROUP BY user_id
    """,
)
def grouped_map(spark, d):
    return summarise_groups(load_table(spark, d, "events"), ["user_id"], "value", group_rows=60)


@query(
    "u6_cogroup",
    """
    SELECT event_id, user_id, value, value / (c_nationkey + 1) AS ratio
    FROM events JOIN customer ON user_id = c_custkey
    """,
)
def cogrouped(spark, d):
    events = load_table(spark, d, "events").select("event_id", "user_id", "value")
    base = (F.col("c_nationkey") + 1).cast("double").alias("base")
    customer = load_table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), base)
    return attach_cogrouped(events, customer, "user_id", "value", "base", group_rows=50)


@query(
    "u6_map_in_pandas",
    'SELECT event_type, COUNT(*) AS "rows", MAX(value) AS high FROM events GROUP BY event_type',
)
def map_batches(spark, d):
    return batch_totals(load_table(spark, d, "events"), "event_type", "value")


_SMOOTHED_SQL = """
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i
               FROM events),
         p AS (SELECT *, SUM(CASE WHEN i = 0 THEN value ELSE 0.2 * value / power(0.8, i) END)
                 OVER (PARTITION BY user_id ORDER BY i) AS s FROM n)
    SELECT event_id, round(s * power(0.8, i), 3) AS smoothed FROM p
"""


def _smoothed(spark, d, **options):
    events = load_table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    found = smoothed(events, ["user_id"], ["ts", "event_id"], "value", 0.2, **options)
    return found.select("event_id", F.round("smoothed", 3).alias("smoothed"))


@query("u6_smoothing", _SMOOTHED_SQL)
def smoothing(spark, d):
    return _smoothed(spark, d)


@query("u6_smoothing_split", _SMOOTHED_SQL)
def smoothing_split(spark, d):
    """Every user's events are smoothed in pieces, which hand their state on."""
    return _smoothed(spark, d, group_rows=20)
