"""Grouping, reshaping and distribution queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators.aggregates import (
    aggregate_levels,
    approx_profile,
    exact_percentiles,
    histogram,
    merge_sketches,
    mode_of,
    pareto_classes,
    pivot_table,
    sketch_estimates,
    sketch_table,
    unpivot_table,
)
from millrace.plans.registry import as_double, query
from millrace.session import scratch_path
from millrace.sources.files import write_partitioned
from millrace.sources.tables import load_table

_PRICE = "CAST(o_totalprice AS DECIMAL(12,2))"


def _price():
    return F.col("o_totalprice").cast("decimal(12,2)")


@query(
    "d1_group_having",
    f"""
    SELECT o_custkey, COUNT(*) AS n, COUNT(DISTINCT o_orderpriority) AS priorities,
           CAST(SUM({_PRICE}) AS DOUBLE) AS total,
           COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS pending
    FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 10
    """,
)
def group_having(spark, d):
    return (
        load_table(spark, d, "orders")
        .groupBy("o_custkey")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("o_orderpriority").alias("priorities"),
            F.sum(_price()).cast("double").alias("total"),
            F.count_if(F.col("o_orderstatus") == "P").alias("pending"),
        )
        .where("n >= 10")
    )


_GROUP_ALL_SQL = """
    SELECT event_type, length(props) AS width, COUNT(*) AS n,
           COUNT(DISTINCT user_id) AS users, MAX(value) AS high
    FROM events GROUP BY ALL
"""


@query("d1_group_by_all", _GROUP_ALL_SQL.replace("length(props)", "CAST(length(props) AS INT)"))
def group_by_all(spark, d):
    sql = _GROUP_ALL_SQL.replace("FROM events", "FROM {events}")
    return spark.sql(sql, events=load_table(spark, d, "events"))


_LEVEL_AGGS = f"COUNT(*) AS n, CAST(SUM({_PRICE}) AS DOUBLE) AS total"


def _levels(spark, d, mode):
    orders = load_table(spark, d, "orders").withColumn("o_year", F.year("o_orderdate").cast("long"))
    orders = orders.withColumn("status", F.nullif("o_orderstatus", F.lit("P")))
    orders = orders.withColumn("price", _price())
    aggs = {"n": ("count", "o_orderkey"), "total": ("sum", "price")}
    found = aggregate_levels(orders, ["o_year", "status"], aggs, mode)
    return as_double(found, "o_year", "total")


def _levels_sql(sets):
    return f"""
    WITH o AS (SELECT *, year(o_orderdate) AS y, nullif(o_orderstatus, 'P') AS status
               FROM orders)
    SELECT CAST(y AS DOUBLE) AS o_year, status, CASE
             WHEN grouping(y) = 0 AND grouping(status) = 0 THEN 'o_year+status'
             WHEN grouping(y) = 0 THEN 'o_year' WHEN grouping(status) = 0 THEN 'status'
             ELSE 'total' END AS level, {_LEVEL_AGGS}
    FROM o GROUP BY {sets}
    """


@query("d2_rollup_levels", _levels_sql("ROLLUP (y, status)"))
def rollup_levels(spark, d):
    return _levels(spark, d, "rollup")


@query("d2_cube_levels", _levels_sql("CUBE (y, status)"))
def cube_levels(spark, d):
    return _levels(spark, d, "cube")


@query("d2_named_levels", _levels_sql("GROUPING SETS ((y), (status), ())"))
def named_levels(spark, d):
    return _levels(spark, d, [["o_year"], ["status"], []])


@query(
    "d3_pivot_table",
    f"""
    SELECT o_orderpriority,
           CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN {_PRICE} END) AS DOUBLE) AS "F",
           CAST(SUM(CASE WHEN o_orderstatus = 'O' THEN {_PRICE} END) AS DOUBLE) AS "O",
           CAST(NULL AS DOUBLE) AS "X"
    FROM orders GROUP BY o_orderpriority
    """,
)
def pivoted(spark, d):
    orders = load_table(spark, d, "orders")
    return pivot_table(
        orders, ["o_orderpriority"], "o_orderstatus", ["F", "O", "X"], F.sum(_price()).cast("double")
    )


@query(
    "d4_unpivot_table",
    """
    SELECT p_partkey, 'p_brand' AS name, p_brand AS value FROM part
    UNION ALL
    SELECT p_partkey, 'p_type', nullif(p_type, 'SMALL') FROM part WHERE p_type <> 'SMALL'
    """,
)
def unpivoted(spark, d):
    part = load_table(spark, d, "part").withColumn("p_type", F.nullif("p_type", F.lit("SMALL")))
    return unpivot_table(part, ["p_partkey"], ["p_brand", "p_type"], keep_nulls=False)


@query(
    "d5_ordered_string_aggregate",
    """
    SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities
    FROM orders GROUP BY o_custkey
    """,
)
def string_aggregate(spark, d):
    """Distinct values from a small domain, so no group's text can grow."""
    return spark.sql(
        """
        SELECT o_custkey, listagg(DISTINCT o_orderpriority, ',')
                 WITHIN GROUP (ORDER BY o_orderpriority) AS priorities
        FROM {orders} GROUP BY o_custkey
        """,
        orders=load_table(spark, d, "orders"),
    )


_PERCENTILE_SQL = """
    SELECT event_type,
           round(quantile_cont(value, 0.5), 6) AS p50_cont, quantile_disc(value, 0.5) AS p50_disc,
           round(quantile_cont(value, 0.9), 6) AS p90_cont, quantile_disc(value, 0.9) AS p90_disc,
           quantile_disc(value, 0.07) AS p07_disc, quantile_disc(value, 0.55) AS p55_disc
    FROM events GROUP BY event_type
"""


def _percentiles(spark, d, **options):
    events = load_table(spark, d, "events")
    wanted = {"p50": 0.5, "p90": 0.9, "p07": 0.07, "p55": 0.55}
    found = exact_percentiles(events, ["event_type"], "value", wanted, **options)
    return found.drop("p07_cont", "p55_cont").withColumns({c: F.round(c, 6) for c in ("p50_cont", "p90_cont")})


@query("d6_exact_percentiles", _PERCENTILE_SQL)
def percentiles(spark, d):
    return _percentiles(spark, d)


@query("d6_exact_percentiles_split", _PERCENTILE_SQL)
def percentiles_split(spark, d):
    return _percentiles(spark, d, group_rows=200)


@query(
    "d7_mode_of",
    """
    SELECT event_type, user_id, n FROM
      (SELECT event_type, user_id, COUNT(*) AS n, row_number() OVER (PARTITION BY event_type
              ORDER BY COUNT(*) DESC, user_id) AS rn FROM events GROUP BY event_type, user_id)
    WHERE rn = 1
    """,
)
def modes(spark, d):
    return mode_of(load_table(spark, d, "events"), ["event_type"], "user_id")


@query(
    "d8_approx_profile",
    """
    SELECT event_type, TRUE AS distinct_near, TRUE AS q25_near, TRUE AS q50_near, TRUE AS q75_near,
           TRUE AS heavy_found
    FROM events GROUP BY event_type
    """,
)
def approximate(spark, d):
    """Whether each sketch is within its bound of the exact result: four times the
    stated error, and each value over a fiftieth of a group's rows among the heaviest."""
    hot = F.when(F.col("event_id") % 4 == 0, F.lit(-1.0)).otherwise(F.col("value"))
    events = load_table(spark, d, "events").withColumn("value", hot)
    sketch = approx_profile(events, ["event_type"], "value", heavy=10)
    ranks = [
        F.struct(
            F.avg((F.col("value") < F.col(q)).cast("double")).alias("below"),
            F.avg((F.col("value") <= F.col(q)).cast("double")).alias("upto"),
        ).alias(f"_{q}")
        for q in ("q25", "q50", "q75")
    ]
    joined = events.select("event_type", "value").join(sketch, "event_type")
    exact = joined.groupBy("event_type").agg(
        F.count_distinct("value").alias("_distinct"),
        F.first("approx_distinct").alias("approx_distinct"),
        F.first("heavy").alias("heavy"),
        *ranks,
    )
    often = (
        events.groupBy("event_type", "value")
        .agg(F.count("*").alias("n"))
        .withColumn("_all", F.sum("n").over(Window.partitionBy("event_type")))
        .where(F.col("n") * 50 > F.col("_all"))
        .groupBy("event_type")
        .agg(F.collect_set("value").alias("_often"))
    )
    items = F.transform("heavy", lambda h: h["item"])
    missing = F.size(F.array_except(F.coalesce("_often", F.array().cast("array<double>")), items))

    def near(q: str, p: float):
        return (F.col(f"_{q}.below") - 0.06 <= p) & (F.col(f"_{q}.upto") + 0.06 >= p)

    return exact.join(often, "event_type", "left").select(
        "event_type",
        (F.abs(F.col("approx_distinct") - F.col("_distinct")) <= F.col("_distinct") * 0.1 + 1).alias(
            "distinct_near"
        ),
        *(near(q, p).alias(f"{q}_near") for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))),
        (missing == 0).alias("heavy_found"),
    )


@query(
    "d8_stored_sketches",
    """
    SELECT event_type, COUNT(*) AS "rows", COUNT(DISTINCT CAST(ts AS DATE)) AS days,
           TRUE AS distinct_near, TRUE AS q25_near, TRUE AS q50_near, TRUE AS q75_near
    FROM events GROUP BY event_type
    """,
)
def stored_sketches(spark, d):
    """Sketches per type and day are stored, one half of the days after the other, and merged
    when read: whether the merged ones are within four times their stated error."""
    events = load_table(spark, d, "events").withColumn("day", F.to_date("ts"))
    path = scratch_path(spark, "sketches")
    odd = F.day("day") % 2 == 1
    for arrived in (odd, ~odd):
        new = sketch_table(events.where(arrived), ["event_type", "day"], "value")
        write_partitioned(new, path, ["day"])
    kept = spark.read.parquet(path)
    days = kept.groupBy("event_type").agg(F.count_distinct("day").alias("days"))
    probs = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    found = sketch_estimates(merge_sketches(kept, ["event_type"]), ["event_type"], probs)
    found = found.join(days, "event_type")
    ranks = [
        F.avg((F.col("value") <= F.col(q)).cast("double")).alias(f"_{q}") for q in probs
    ]
    exact = events.select("event_type", "value").join(found, "event_type").groupBy("event_type").agg(
        F.count_distinct("value").alias("_distinct"), *ranks
    )
    return found.join(exact, "event_type").select(
        "event_type",
        "rows",
        "days",
        (F.abs(F.col("approx_distinct") - F.col("_distinct")) <= F.col("_distinct") * 0.064 + 1).alias(
            "distinct_near"
        ),
        *((F.abs(F.col(f"_{q}") - p) <= 0.06).alias(f"{q}_near") for q, p in probs.items()),
    )


@query(
    "d9_statistics",
    """
    SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 6) AS var,
           round(corr(value, user_id), 6) AS correlation
    FROM events GROUP BY event_type
    """,
)
def statistics(spark, d):
    return (
        load_table(spark, d, "events")
        .groupBy("event_type")
        .agg(
            F.round(F.stddev_samp("value"), 6).alias("sd"),
            F.round(F.var_pop("value"), 6).alias("var"),
            F.round(F.corr("value", "user_id"), 6).alias("correlation"),
        )
    )


@query(
    "d10_histogram",
    """
    WITH b AS (SELECT CASE WHEN p IS NULL THEN -1 WHEN p < 50000 THEN 0 WHEN p >= 650000 THEN 25
                      ELSE CAST(floor((p - 50000) / 25000) AS BIGINT) + 1 END AS bin
               FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS p FROM orders))
    SELECT s.bin, CASE WHEN s.bin BETWEEN 1 AND 24 THEN 50000.0::DOUBLE + (s.bin - 1) * 25000 END AS bin_lo,
           CASE WHEN s.bin BETWEEN 1 AND 24 THEN 50000.0::DOUBLE + s.bin * 25000 END AS bin_hi,
           COUNT(b.bin) AS "rows"
    FROM (SELECT unnest(range(-1, 26)) AS bin) s LEFT JOIN b ON s.bin = b.bin GROUP BY s.bin
    """,
)
def histogrammed(spark, d):
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    orders = load_table(spark, d, "orders").select(price.alias("p"))
    return histogram(orders, "p", 50000.0, 650000.0, 24)


_PARETO_SQL = """
    WITH t AS (SELECT l_partkey, SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS total
               FROM lineitem GROUP BY l_partkey),
         r AS (SELECT *, SUM(total) OVER (ORDER BY total DESC, l_partkey
                    ROWS UNBOUNDED PRECEDING) AS upto,
                 row_number() OVER (ORDER BY total DESC, l_partkey) AS position,
                 (SELECT SUM(total) FROM t) AS whole FROM t)
    SELECT l_partkey, CAST(total AS DOUBLE) AS total, position,
           round(CAST(upto AS DOUBLE) / CAST(whole AS DOUBLE), 9) AS running_share,
           CASE WHEN CAST(upto - total AS DOUBLE) / CAST(whole AS DOUBLE) < 0.2 THEN 'A'
                WHEN CAST(upto - total AS DOUBLE) / CAST(whole AS DOUBLE) < 0.5 THEN 'B'
                ELSE 'C' END AS class
    FROM r
"""


def _pareto(spark, d, **options):
    lines = load_table(spark, d, "lineitem")
    lines = lines.select("l_partkey", F.col("l_extendedprice").cast("decimal(12,2)").alias("price"))
    classed = pareto_classes(lines, "l_partkey", "price", {"A": 0.2, "B": 0.5}, **options)
    return classed.withColumns(
        {"total": F.col("total").cast("double"), "running_share": F.round("running_share", 9)}
    )


@query("d11_pareto_classes", _PARETO_SQL)
def pareto(spark, d):
    return _pareto(spark, d)


@query("d11_pareto_classes_split", _PARETO_SQL)
def pareto_split(spark, d):
    return _pareto(spark, d, group_rows=300)
