"""Window, time-series, sorting and top-n queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.series import calendar, gap_fill, islands, period_change, sessionize
from millrace.operators.windows import (
    frame_range,
    frame_rows,
    latest_per_key,
    rank_rows,
    running,
    top_with_ties,
)
from millrace.plans.registry import query
from millrace.sources.tables import load_table


def _events(spark, d):
    return load_table(spark, d, "events")


_RANK_SQL = """
    SELECT event_id,
           row_number() OVER (PARTITION BY event_type ORDER BY v DESC, event_id) AS row_number,
           rank() OVER (PARTITION BY event_type ORDER BY v DESC) AS rank,
           dense_rank() OVER (PARTITION BY event_type ORDER BY v DESC) AS dense_rank,
           ntile(7) OVER (PARTITION BY event_type ORDER BY v DESC, event_id) AS ntile,
           round(percent_rank() OVER (PARTITION BY event_type ORDER BY v DESC), 9) AS percent_rank,
           round(cume_dist() OVER (PARTITION BY event_type ORDER BY v DESC), 9) AS cume_dist
    FROM (SELECT *, floor(value) AS v FROM events)
"""


def _ranked(spark, d, **options):
    """Whole-number values make ties for the rank columns."""
    rows = _events(spark, d).select("event_id", "event_type", F.floor("value").alias("v"))
    tied = rank_rows(rows, ["event_type"], ["v desc"], **options).drop("row_number")
    exact = rank_rows(
        rows.select("event_id", "event_type", "v"),
        ["event_type"],
        ["v desc", "event_id"],
        tiles=7,
        **options,
    ).select("event_id", "row_number", "ntile")
    return exact.join(tied, "event_id").select(
        "event_id",
        "row_number",
        "rank",
        "dense_rank",
        "ntile",
        F.round("percent_rank", 9).alias("percent_rank"),
        F.round("cume_dist", 9).alias("cume_dist"),
    )


@query("e1_ranking", _RANK_SQL)
def ranking(spark, d):
    return _ranked(spark, d)


@query("e1_ranking_split", _RANK_SQL)
def ranking_split(spark, d):
    return _ranked(spark, d, group_rows=500)


_OFFSET_SQL = """
    SELECT event_id, lag(value, 2) OVER w AS two_back, lead(value, 1, -1.0) OVER w AS next_value,
           first_value(value) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS oldest,
           last_value(big IGNORE NULLS) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS last_big,
           nth_value(value, 2) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS second
    FROM (SELECT *, CASE WHEN value > 20 THEN value END AS big FROM events)
    WINDOW w AS (PARTITION BY {by} ORDER BY ts, event_id)
"""


def _offsets(spark, d, by, **options):
    rows = _events(spark, d).withColumn("big", F.when(F.col("value") > 20, F.col("value")))
    exprs = {
        "two_back": lambda w: F.lag("value", 2).over(w),
        "next_value": lambda w: F.lead("value", 1, -1.0).over(w),
        "oldest": lambda w: F.first("value").over(w.rowsBetween(-3, 0)),
        "last_big": lambda w: F.last("big", ignorenulls=True).over(w.rowsBetween(-3, 0)),
        "second": lambda w: F.nth_value("value", 2).over(w.rowsBetween(-3, 0)),
    }
    found = frame_rows(rows, [by], ["ts", "event_id"], exprs, before=3, after=1, **options)
    return found.select("event_id", *exprs)


@query("e2_offsets", _OFFSET_SQL.format(by="user_id"))
def offsets(spark, d):
    return _offsets(spark, d, "user_id")


@query("e2_offsets_split", _OFFSET_SQL.format(by="event_type"))
def offsets_split(spark, d):
    return _offsets(spark, d, "event_type", group_rows=500)


@query(
    "e3_row_frames",
    """
    SELECT event_id, CAST(SUM(CAST(value AS DECIMAL(12,2))) OVER (PARTITION BY user_id
             ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS DOUBLE) AS moving,
           MAX(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
             ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS high
    FROM events
    """,
)
def row_frames(spark, d):
    exprs = {
        "moving": lambda w: F.sum(F.col("value").cast("decimal(12,2)"))
        .over(w.rowsBetween(-2, 1))
        .cast("double"),
        "high": lambda w: F.max("value").over(w.rowsBetween(-2, 1)),
    }
    rows = frame_rows(_events(spark, d), ["user_id"], ["ts", "event_id"], exprs, 2, 1)
    return rows.select("event_id", *exprs)


_RUNNING_SQL = """
    SELECT event_id,
           CAST(SUM(CAST(value AS DECIMAL(12,2))) OVER w AS DOUBLE) AS total,
           COUNT(value) OVER w AS n, MIN(value) OVER w AS low, MAX(value) OVER w AS high
    FROM events WINDOW w AS (PARTITION BY {by} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
"""


def _running(spark, d, by, **options):
    rows = _events(spark, d).withColumn("amount", F.col("value").cast("decimal(12,2)"))
    aggs = {
        "total": ("sum", "amount"),
        "n": ("count", "value"),
        "low": ("min", "value"),
        "high": ("max", "value"),
    }
    found = running(rows, by, ["ts", "event_id"], aggs, **options)
    return found.select("event_id", F.col("total").cast("double").alias("total"), "n", "low", "high")


@query("e3_running_totals", _RUNNING_SQL.format(by="user_id"))
def running_totals(spark, d):
    return _running(spark, d, ["user_id"])


@query("e3_running_totals_split", _RUNNING_SQL.format(by="1"))
def running_totals_split(spark, d):
    """One running total over the whole table, computed in pieces."""
    return _running(spark, d, [], group_rows=500)


_RANGE_SQL = """
    SELECT event_id, MAX(value) OVER w AS high, MIN(value) OVER w AS low, COUNT(*) OVER w AS n,
           CAST(SUM(user_id) OVER w AS BIGINT) AS users
    FROM events WINDOW w AS (PARTITION BY {by} ORDER BY ts
      RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND INTERVAL 1 HOUR FOLLOWING)
"""


def _ranged(spark, d, by, **options):
    aggs = {
        "high": ("max", "value"),
        "low": ("min", "value"),
        "n": ("count", "event_id"),
        "users": ("sum", "user_id"),
    }
    rows = frame_range(_events(spark, d), [by], "ts", aggs, 12 * 3600, 3600, **options)
    return rows.select("event_id", *aggs)


@query("e4_range_frames", _RANGE_SQL.format(by="user_id"))
def range_frames(spark, d):
    return _ranged(spark, d, "user_id")


@query("e4_range_frames_split", _RANGE_SQL.format(by="event_type"))
def range_frames_split(spark, d):
    """Few keys with many rows each, whose blocks of time are cut into pieces."""
    return _ranged(spark, d, "event_type", group_rows=100)


@query(
    "e5_latest_per_key",
    """
    SELECT o_custkey, o_orderkey, o_totalprice FROM
      (SELECT *, row_number() OVER (PARTITION BY o_custkey
              ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1
    """,
)
def latest(spark, d):
    orders = load_table(spark, d, "orders")
    newest = latest_per_key(orders, ["o_custkey"], ["o_orderdate desc", "o_orderkey desc"])
    return newest.select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "e6_islands",
    """
    WITH dd AS (SELECT user_id, CAST(ts AS DATE) AS d, COUNT(*) AS n FROM events GROUP BY 1, 2),
         g AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INT) AS a
               FROM dd)
    SELECT user_id, CAST(MIN(d) AS VARCHAR) AS start_day, CAST(MAX(d) AS VARCHAR) AS end_day,
           COUNT(*) AS days, CAST(SUM(n) AS BIGINT) AS "rows"
    FROM g GROUP BY user_id, a
    """,
)
def island_runs(spark, d):
    found = islands(_events(spark, d), ["user_id"], "ts")
    return found.withColumns({c: F.col(c).cast("string") for c in ("start_day", "end_day")})


@query(
    "e7_sessionize",
    """
    WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
                      <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
         s AS (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM f)
    SELECT user_id, MIN(ts) AS start_ts, MAX(ts) AS end_ts, COUNT(*) AS "rows"
    FROM s GROUP BY user_id, session
    """,
)
def sessions(spark, d):
    return sessionize(_events(spark, d), ["user_id"], "ts", 6 * 3600)


@query(
    "e8_tumbling_windows",
    """
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, COUNT(*) AS n,
           MAX(value) AS high
    FROM events GROUP BY 1, 2
    """,
)
def tumbling(spark, d):
    hour = F.window("ts", "1 hour")
    grouped = _events(spark, d).groupBy(hour, "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("high")).select(
        F.col("window.start").alias("window_start"), "event_type", "n", "high"
    )


_DAILY_SQL = """
    WITH g AS (SELECT user_id, date_trunc('day', ts) AS day, MAX(value) AS high FROM events
               GROUP BY 1, 2),
         s AS (SELECT user_id, unnest(generate_series(MIN(day)::TIMESTAMP, MAX(day)::TIMESTAMP,
                      INTERVAL 1 DAY)) AS day FROM g GROUP BY user_id)
"""


def _daily(spark, d, fill):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    daily = _events(spark, d).groupBy("user_id", day).agg(F.max("value").alias("high"))
    return gap_fill(daily, ["user_id"], "day", "1 day", ["high"], fill)


@query(
    "e9_gap_fill_last",
    _DAILY_SQL
    + """
    SELECT user_id, s.day, last_value(high IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY s.day)
             AS high
    FROM s LEFT JOIN g USING (user_id, day)
    """,
)
def gaps_last(spark, d):
    return _daily(spark, d, "last")


@query(
    "e9_gap_fill_zero",
    _DAILY_SQL
    + "SELECT user_id, s.day, coalesce(high, 0) AS high FROM s LEFT JOIN g USING (user_id, day)",
)
def gaps_zero(spark, d):
    return _daily(spark, d, "zero")


@query(
    "e10_period_change",
    """
    WITH g AS (SELECT o_custkey, date_trunc('month', o_orderdate)::TIMESTAMP AS month,
                      SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS total FROM orders GROUP BY 1, 2),
         s AS (SELECT o_custkey, unnest(generate_series(MIN(month), MAX(month), INTERVAL 1 MONTH))
                 AS month FROM g GROUP BY o_custkey),
         p AS (SELECT o_custkey, s.month, total,
                      lag(total) OVER (PARTITION BY o_custkey ORDER BY s.month) AS previous
               FROM s LEFT JOIN g USING (o_custkey, month))
    SELECT o_custkey, month, CAST(total AS DOUBLE) AS total, CAST(previous AS DOUBLE) AS previous,
           CAST(total - previous AS DOUBLE) AS change,
           round(CAST(total - previous AS DOUBLE) / CAST(previous AS DOUBLE), 6) AS change_ratio
    FROM p
    """,
)
def changes(spark, d):
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")
    total = F.sum(F.col("o_totalprice").cast("decimal(12,2)")).alias("total")
    monthly = load_table(spark, d, "orders").groupBy("o_custkey", month).agg(total)
    moved = period_change(monthly, ["o_custkey"], "month", "total")
    return moved.withColumns(
        {
            **{c: F.col(c).cast("double") for c in ("total", "previous", "change")},
            "change_ratio": F.round("change_ratio", 6),
        }
    )


@query(
    "e11_calendar",
    """
    WITH b AS (SELECT MIN(CAST(o_orderdate AS DATE)) AS lo, MAX(CAST(o_orderdate AS DATE)) AS hi
               FROM orders),
         c AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b),
         o AS (SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS n FROM orders GROUP BY 1)
    SELECT CAST(c.day AS VARCHAR) AS day, year(c.day) AS year, quarter(c.day) AS quarter,
           month(c.day) AS month, weekofyear(c.day) AS iso_week, isodow(c.day) AS weekday,
           CAST(last_day(c.day) AS VARCHAR) AS month_end, last_day(c.day) = c.day AS is_month_end,
           isodow(c.day) >= 6 AS is_weekend, coalesce(n, 0) AS n_orders
    FROM c LEFT JOIN o ON c.day = o.day
    """,
)
def dates(spark, d):
    """Orders per day over the whole calendar, days without orders included."""
    orders = load_table(spark, d, "orders")
    day = F.col("o_orderdate").cast("date")
    lo, hi = orders.agg(F.min(day), F.max(day)).first()
    per_day = orders.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n_orders"))
    joined = calendar(spark, lo, hi).join(per_day, "day", "left")
    numbers = ("year", "quarter", "month", "iso_week", "weekday")
    return joined.withColumns(
        {
            **{c: F.col(c).cast("string") for c in ("day", "month_end")},
            **{c: F.col(c).cast("long") for c in numbers},
            "n_orders": F.coalesce("n_orders", F.lit(0)),
        }
    )


@query(
    "f1_sort_limit_offset",
    """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey
    LIMIT 25 OFFSET 50
    """,
)
def page(spark, d):
    orders = load_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(25)


@query(
    "f2_top_with_ties",
    """
    SELECT p_partkey, p_size, p_brand FROM
      (SELECT *, rank() OVER (ORDER BY p_size DESC, p_brand) AS r FROM part) WHERE r <= 30
    """,
)
def ties(spark, d):
    part = load_table(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    return top_with_ties(part, ["p_size desc", "p_brand"], 30)
