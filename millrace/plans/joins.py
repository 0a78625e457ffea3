"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.joins import (
    asof_join,
    fuzzy_join,
    interval_join,
    not_in,
    overlap_join,
    salted_join,
    top_n_per_row,
)
from millrace.plans.registry import as_double, query
from millrace.sources.tables import load_table


@query(
    "c1_inner_join",
    """
    SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'
    """,
)
def inner(spark, d):
    urgent = load_table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return (
        urgent.join(load_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(load_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "c_name", "n_name")
    )


def _lines(spark, d):
    """One row per order with lines: the many side is grouped before it is joined."""
    lines = load_table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


_LINES_SQL = """
    WITH l AS (SELECT l_orderkey, COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
         o AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P')
    SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_orderstatus,
           CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(n AS DOUBLE) AS n
    FROM o {how} JOIN l ON o_orderkey = l_orderkey
"""


def _orders_lines(spark, d, how):
    orders = load_table(spark, d, "orders").where("o_orderstatus <> 'P'")
    match = F.col("o_orderkey") == F.col("l_orderkey")
    joined = orders.select("o_orderkey", "o_orderstatus").join(_lines(spark, d), match, how)
    return as_double(joined, "o_orderkey", "l_orderkey", "n")


@query("c1_left_join", _LINES_SQL.format(how="LEFT"))
def left(spark, d):
    return _orders_lines(spark, d, "left")


@query("c1_right_join", _LINES_SQL.format(how="RIGHT"))
def right(spark, d):
    return _orders_lines(spark, d, "right")


@query("c1_full_join", _LINES_SQL.format(how="FULL"))
def full(spark, d):
    return _orders_lines(spark, d, "full")


@query(
    "c2_semi_join",
    """
    SELECT c_custkey, c_name FROM customer WHERE EXISTS
      (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000)
    """,
)
def semi(spark, d):
    large = load_table(spark, d, "orders").where("o_totalprice > 490000")
    customer = load_table(spark, d, "customer")
    keys = large.select("o_custkey").distinct()
    match = F.col("o_custkey") == F.col("c_custkey")
    return customer.join(keys, match, "left_semi").select("c_custkey", "c_name")


@query(
    "c2_anti_join",
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def anti(spark, d):
    lines = load_table(spark, d, "lineitem").select("l_orderkey").distinct()
    orders = load_table(spark, d, "orders").select("o_orderkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


_EXISTS_SQL = """
    SELECT p_partkey FROM part
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount >= 0.1)
      AND p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_size = 50)
"""


@query("c2_exists_in", _EXISTS_SQL)
def exists_in(spark, d):
    # One row per key on the inner side, so a key with very many lines is no heavier.
    lines = load_table(spark, d, "lineitem").select("l_partkey", "l_discount").distinct()
    sql = _EXISTS_SQL.replace("FROM part", "FROM {part}").replace("FROM lineitem", "FROM {lines}")
    return spark.sql(sql, part=load_table(spark, d, "part"), lines=lines)


def _customer_keys(spark, d):
    customer = load_table(spark, d, "customer")
    segment = F.col("c_mktsegment")
    return customer.select(
        F.when(segment != "BUILDING", F.col("c_custkey")).alias("k"), F.col("c_name")
    )


def _order_keys(spark, d):
    orders = load_table(spark, d, "orders").where("o_totalprice > 400000")
    key = F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))
    return orders.select(key.alias("k"))


_NOT_IN_SQL = """
    WITH c AS (SELECT CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey END AS k, c_name
               FROM customer),
         o AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS k FROM orders
               WHERE o_totalprice > 400000)
    SELECT CAST(k AS DOUBLE) AS k, c_name FROM c WHERE {test}
"""


@query(
    "c3_not_in_sql_nulls",
    f"SELECT COUNT(*) AS n FROM ({_NOT_IN_SQL.format(test='k NOT IN (SELECT k FROM o)')})",
)
def not_in_sql(spark, d):
    """One null on the other side leaves no row, so the rows are counted."""
    kept = not_in(_customer_keys(spark, d), _order_keys(spark, d), "k")
    return kept.agg(F.count(F.lit(1)).alias("n"))


@query(
    "c3_not_in_sql",
    _NOT_IN_SQL.format(test="k NOT IN (SELECT k FROM o WHERE k IS NOT NULL)"),
)
def not_in_no_nulls(spark, d):
    keys = _order_keys(spark, d).where("k IS NOT NULL")
    return as_double(not_in(_customer_keys(spark, d), keys, "k"), "k")


@query(
    "c3_not_in_ignore",
    _NOT_IN_SQL.format(test="NOT EXISTS (SELECT 1 FROM o WHERE o.k = c.k)"),
)
def not_in_ignore(spark, d):
    kept = not_in(_customer_keys(spark, d), _order_keys(spark, d), "k", nulls="ignore")
    return as_double(kept, "k")


def _side(spark, d, kind, prefix):
    events = load_table(spark, d, "events").where(F.col("event_type") == kind)
    return events.select(
        "user_id",
        F.col("event_id").alias(f"{prefix}_id"),
        F.col("ts").alias(f"{prefix}_ts"),
        F.col("value").alias(f"{prefix}_value"),
    )


def _asof(spark, d, by=("user_id",), **options):
    clicks = _side(spark, d, "click", "c")
    clicks = clicks if by else clicks.drop("user_id")
    found = asof_join(_side(spark, d, "purchase", "p"), clicks, by, "p_ts", "c_ts", **options)
    return as_double(found, "c_id")


_ASOF_SQL = """
    WITH p AS (SELECT user_id, event_id AS p_id, ts AS p_ts, value AS p_value FROM events
               WHERE event_type = 'purchase'),
         c AS (SELECT user_id, event_id AS c_id, ts AS c_ts, value AS c_value FROM events
               WHERE event_type = 'click')
    SELECT p.user_id, p_id, p_ts, p_value,
           CASE WHEN {near} THEN c_ts END AS c_ts,
           CAST(CASE WHEN {near} THEN c_id END AS DOUBLE) AS c_id,
           CASE WHEN {near} THEN c_value END AS c_value
    FROM p ASOF LEFT JOIN c ON {by} p_ts {op} c_ts
"""


@query(
    "c4_asof_join", _ASOF_SQL.format(by="p.user_id = c.user_id AND", op=">=", near="TRUE")
)
def asof(spark, d):
    return _asof(spark, d)


@query(
    "c4_asof_join_tolerance",
    _ASOF_SQL.format(
        by="p.user_id = c.user_id AND", op=">=", near="p_ts - c_ts <= INTERVAL 6 HOUR"
    ),
)
def asof_tolerance(spark, d):
    return _asof(spark, d, tolerance=6 * 3600)


@query(
    "c4_asof_join_forward",
    _ASOF_SQL.format(
        by="p.user_id = c.user_id AND", op="<=", near="c_ts - p_ts <= INTERVAL 6 HOUR"
    ),
)
def asof_forward(spark, d):
    return _asof(spark, d, tolerance=6 * 3600, direction="forward")


@query("c4_asof_join_split", _ASOF_SQL.format(by="", op=">=", near="TRUE"))
def asof_split(spark, d):
    """No key at all: the whole table is one group, cut into pieces by time."""
    return _asof(spark, d, by=(), group_rows=500)


@query(
    "c5_interval_join",
    """
    SELECT v.user_id, v.event_id AS v_id, c.event_id AS c_id
    FROM events v JOIN events c ON v.user_id = c.user_id
     AND c.ts >= v.ts - INTERVAL 1 HOUR AND c.ts <= v.ts + INTERVAL 6 HOUR
    WHERE v.event_type = 'view' AND c.event_type = 'click'
    """,
)
def interval(spark, d):
    pairs = interval_join(
        _side(spark, d, "view", "v"),
        _side(spark, d, "click", "c"),
        ["user_id"],
        "v_ts",
        "c_ts",
        -3600,
        6 * 3600,
    )
    return pairs.select("user_id", "v_id", "c_id")


_DAYS = "CAST(pow(4, CAST(substr(o_orderpriority, 1, 1) AS INT)) AS INT)"


def _ranges(spark, d, status, prefix):
    orders = load_table(spark, d, "orders").where(F.col("o_orderstatus") == status)
    return orders.select(
        "o_custkey",
        F.col("o_orderkey").alias(f"{prefix}_key"),
        F.col("o_orderdate").alias(f"{prefix}_from"),
        F.expr(f"o_orderdate + make_dt_interval({_DAYS})").alias(f"{prefix}_to"),
    )


@query(
    "c6_overlap_join",
    f"""
    WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate AS s,
                      o_orderdate + to_days({_DAYS}) AS e FROM orders)
    SELECT a.o_custkey, a.o_orderkey AS a_key, b.o_orderkey AS b_key
    FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.s < b.e AND b.s < a.e
    WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'O'
    """,
)
def overlap(spark, d):
    """Ranges of 4 to 1,024 days; a range meets two bins whatever its length."""
    pairs = overlap_join(
        _ranges(spark, d, "F", "a"),
        _ranges(spark, d, "O", "b"),
        ("a_from", "a_to"),
        ("b_from", "b_to"),
        bin=8 * 86_400,
        by=["o_custkey"],
    )
    return pairs.select("o_custkey", "a_key", "b_key")


_TOP_SQL = """
    SELECT c_custkey, c_mktsegment, CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_totalprice FROM
      (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c {how} JOIN
      (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey
              ORDER BY o_totalprice DESC, o_orderkey) AS rn
       FROM orders WHERE o_orderstatus = 'P') o
      ON c_custkey = o_custkey AND rn <= 2
"""


def _top(spark, d, outer):
    customer = load_table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    orders = load_table(spark, d, "orders").where("o_orderstatus = 'P'")
    orders = orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    joined = top_n_per_row(
        customer, orders, ["c_custkey"], ["o_totalprice desc", "o_orderkey"], 2, outer
    )
    columns = ["c_custkey", "c_mktsegment", "o_orderkey", "o_totalprice"]
    return as_double(joined.select(*columns), "o_orderkey")


@query("c7_top_n_per_row", _TOP_SQL.format(how=""))
def top_n(spark, d):
    return _top(spark, d, False)


@query("c7_top_n_per_row_outer", _TOP_SQL.format(how="LEFT"))
def top_n_outer(spark, d):
    return _top(spark, d, True)


@query(
    "c8_salted_join",
    """
    SELECT l_returnflag, p_brand, COUNT(*) AS n,
           CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag, p_brand
    """,
)
def salted(spark, d):
    """The threshold is low, so most parts count as hot and are salted."""
    part = load_table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    lines = load_table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_quantity")
    joined = salted_join(lines, part, ["l_partkey"], salts=4, group_rows=25)
    quantity = F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double")
    return joined.groupBy("l_returnflag", "p_brand").agg(
        F.count(F.lit(1)).alias("n"), quantity.alias("quantity")
    )


@query(
    "c9_fuzzy_join",
    """
    WITH l AS (SELECT p_brand, p_name AS left_text, COUNT(*) AS left_rows FROM part
               WHERE p_size <= 25 GROUP BY ALL),
         r AS (SELECT p_brand, p_name AS right_text, COUNT(*) AS right_rows FROM part
               WHERE p_size > 25 GROUP BY ALL)
    SELECT l.p_brand, left_text, right_text, levenshtein(left_text, right_text) AS distance,
           left_rows, right_rows
    FROM l JOIN r ON l.p_brand = r.p_brand WHERE levenshtein(left_text, right_text) <= 2
    """,
)
def fuzzy(spark, d):
    part = load_table(spark, d, "part")
    pairs = fuzzy_join(
        part.where("p_size <= 25"), part.where("p_size > 25"), "p_brand", "p_name", "p_name", 2
    )
    return pairs.withColumn("distance", F.col("distance").cast("long"))


@query(
    "c10_correlated_subquery",
    """
    SELECT o_orderkey, o_custkey FROM orders o
    WHERE o_totalprice >= CAST(1.9 AS DOUBLE) * (SELECT round(CAST(SUM(CAST(i.o_totalprice AS DECIMAL(12,2)))
        AS DOUBLE) / COUNT(*), 4) FROM orders i WHERE i.o_custkey = o.o_custkey)
    """,
)
def correlated(spark, d):
    return spark.sql(
        """
        SELECT o_orderkey, o_custkey FROM {orders} o
        WHERE o_totalprice >= CAST(1.9 AS DOUBLE) * (SELECT round(CAST(SUM(CAST(i.o_totalprice AS DECIMAL(12,2)))
            AS DOUBLE) / COUNT(*), 4) FROM {orders} i WHERE i.o_custkey = o.o_custkey)
        """,
        orders=load_table(spark, d, "orders"),
    )
