"""Loads, sinks, load checks, projection and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.cleaning import cast_quarantine, clean_keys
from millrace.operators.quality import check_constraints, profile
from millrace.operators.windows import fill_forward
from millrace.plans.registry import as_double, query
from millrace.session import scratch_path
from millrace.sources.files import load_since, read_csv_quarantine, write_partitioned
from millrace.sources.tables import load_table


@query(
    "flagship_nation_revenue",
    """
    SELECT n_name,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))
                AS DOUBLE) AS revenue,
           COUNT(DISTINCT o_orderkey) AS n_orders
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY n_name
    """,
)
def flagship(spark, d):
    lineitem = load_table(spark, d, "lineitem")
    orders = load_table(spark, d, "orders")
    customer = load_table(spark, d, "customer")
    nation = load_table(spark, d, "nation")
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    # Line items shrink to one row per order, and orders to one row per customer,
    # before the next join. A hot order or customer costs one row there, and
    # COUNT(DISTINCT) is a COUNT.
    per_order = lineitem.groupBy("l_orderkey").agg(F.sum(price * (1 - discount)).alias("revenue"))
    per_customer = (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(F.sum("revenue").alias("revenue"), F.count("o_orderkey").alias("n_orders"))
    )
    return (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(F.sum("revenue").alias("revenue"), F.sum("n_orders").alias("n_orders"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("n_name", F.col("revenue").cast("double").alias("revenue"), "n_orders")
    )


@query(
    "a1_load_table",
    """
    SELECT l_returnflag, l_linestatus, COUNT(*) AS n,
           CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity,
           MIN(l_shipdate) AS first_ship, MAX(l_shipdate) AS last_ship
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
)
def load(spark, d):
    return (
        load_table(spark, d, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double").alias("quantity"),
            F.min("l_shipdate").alias("first_ship"),
            F.max("l_shipdate").alias("last_ship"),
        )
    )


@query(
    "a2_read_csv_quarantine",
    """
    SELECT CASE WHEN o_orderstatus = 'P' THEN 'bad' ELSE 'good' END AS kind,
           o_orderpriority, COUNT(*) AS n,
           CAST(SUM(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS DECIMAL(12,2)) END)
                AS DOUBLE) AS total
    FROM orders GROUP BY 1, 2
    """,
)
def csv_quarantine(spark, d):
    """Orders written as CSV, with a price that is not a number for one status."""
    orders = load_table(spark, d, "orders")
    price = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(
        F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    )
    path = scratch_path(spark, "orders-csv")
    orders.select("o_orderkey", price, "o_orderpriority").write.csv(path)
    schema = "o_orderkey BIGINT, o_totalprice DECIMAL(12,2), o_orderpriority STRING"
    good, bad = read_csv_quarantine(spark, path, schema)
    kept = good.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").cast("double").alias("total")
    )
    refused = (
        bad.groupBy(F.element_at(F.split("line", ","), -1).alias("o_orderpriority"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("total", F.lit(None).cast("double"))
    )
    return kept.withColumn("kind", F.lit("good")).unionByName(
        refused.withColumn("kind", F.lit("bad"))
    )


@query(
    "a3_write_partitioned",
    """
    SELECT year(o_orderdate) AS o_year,
           CASE WHEN year(o_orderdate) IN (1996, 1997) THEN 'replaced' ELSE o_orderpriority END
             AS o_orderpriority,
           COUNT(*) AS n
    FROM orders GROUP BY 1, 2
    """,
)
def partitions(spark, d):
    orders = load_table(spark, d, "orders").withColumn("o_year", F.year("o_orderdate").cast("long"))
    path = scratch_path(spark, "orders-by-year")
    write_partitioned(orders, path, ["o_year"])
    redone = orders.where(F.col("o_year").isin(1996, 1997))
    write_partitioned(redone.withColumn("o_orderpriority", F.lit("replaced")), path, ["o_year"])
    stored = spark.read.schema(orders.schema).parquet(path)
    return stored.groupBy("o_year", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a4_load_since",
    """
    SELECT o_orderstatus, COUNT(*) AS n, MIN(o_orderkey) AS first_key,
           (SELECT MAX(o_orderkey) FROM orders) AS new_mark
    FROM orders WHERE o_orderkey > (SELECT CAST(FLOOR(AVG(o_orderkey)) AS BIGINT) FROM orders)
    GROUP BY o_orderstatus
    """,
)
def incremental(spark, d):
    orders = load_table(spark, d, "orders")
    mark = orders.agg(F.floor(F.avg("o_orderkey"))).first()[0]
    delta, new_mark = load_since(orders, "o_orderkey", mark)
    return delta.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("o_orderkey").alias("first_key"),
        F.lit(new_mark).cast("long").alias("new_mark"),
    )


def _round_trip(spark, d, fmt):
    orders = load_table(spark, d, "orders")
    path = scratch_path(spark, f"orders-{fmt}")
    orders.write.format(fmt).save(path)
    return spark.read.schema(orders.schema).format(fmt).load(path)


@query("a5_json_round_trip", "SELECT * FROM orders")
def json_round_trip(spark, d):
    return _round_trip(spark, d, "json")


@query("a5_orc_round_trip", "SELECT * FROM orders")
def orc_round_trip(spark, d):
    return _round_trip(spark, d, "orc")


@query(
    "a6_check_constraints",
    """
    SELECT 'unique(l_orderkey,l_linenumber)' AS rule,
           CAST(to_json({'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber}) AS VARCHAR) AS key,
           COUNT(*) AS "rows"
    FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1
    UNION ALL
    SELECT 'not_null(l_returnflag)', '{"l_returnflag":null}', COUNT(*) FROM lineitem
    WHERE nullif(l_returnflag, 'R') IS NULL HAVING COUNT(*) > 0
    UNION ALL
    SELECT 'ref(l_partkey)', '{"l_partkey":' || l_partkey || '}', COUNT(*) FROM lineitem
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type <> 'SMALL') GROUP BY l_partkey
    UNION ALL
    SELECT 'range(l_linenumber)', '{"l_linenumber":' || l_linenumber || '}', COUNT(*) FROM lineitem
    WHERE l_linenumber > 5 GROUP BY l_linenumber
    UNION ALL
    SELECT 'ref(o_orderkey)', '{"o_orderkey":' || o_orderkey || '}', COUNT(*) FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY o_orderkey
    """,
)
def constraints(spark, d):
    lineitem = load_table(spark, d, "lineitem")
    part = load_table(spark, d, "part").where("p_type <> 'SMALL'")
    holes = lineitem.withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("R")))
    lines = check_constraints(
        holes,
        unique=[["l_orderkey", "l_linenumber"]],
        not_null=["l_returnflag"],
        refs=[("l_partkey", part, "p_partkey")],
        ranges={"l_linenumber": (None, 5)},
    )
    orders = check_constraints(
        load_table(spark, d, "orders"), refs=[("o_orderkey", lineitem, "l_orderkey")]
    )
    return lines.unionByName(orders)


def _profile_sql(table, columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT(*) AS "rows", COUNT(*) - COUNT({c}) AS nulls,
        COUNT(DISTINCT {c}) AS distinct_values, CAST(MIN({c}) AS VARCHAR) AS min,
        CAST(MAX({c}) AS VARCHAR) AS max FROM {table}"""
        for c in columns
    )


@query(
    "a7_profile",
    _profile_sql(
        "orders",
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    ),
)
def profiled(spark, d):
    return profile(load_table(spark, d, "orders"))


@query(
    "a8_repeatable_sample",
    "SELECT * FROM orders WHERE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) < '1999999a'",
)
def sampled(spark, d):
    """A tenth of the keys, told by their hash: the same rows whatever the file layout."""
    hashed = F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 8)
    return load_table(spark, d, "orders").where(hashed < "1999999a")


@query(
    "b1_project_filter",
    """
    SELECT o_orderkey,
           CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice < 300000 THEN 'medium'
                ELSE 'large' END AS band,
           CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 2 AS DOUBLE) AS doubled,
           year(o_orderdate) AS o_year
    FROM orders
    WHERE o_totalprice BETWEEN 50000 AND 400000 AND o_orderpriority LIKE '%-%I%'
      AND o_orderstatus IN ('O', 'F') AND o_orderdate IS NOT NULL
    """,
)
def projection(spark, d):
    price = F.col("o_totalprice")
    return (
        load_table(spark, d, "orders")
        .where(
            price.between(50000, 400000)
            & F.col("o_orderpriority").like("%-%I%")
            & F.col("o_orderstatus").isin("O", "F")
            & F.col("o_orderdate").isNotNull()
        )
        .select(
            "o_orderkey",
            F.when(price < 100000, "small").when(price < 300000, "medium").otherwise("large").alias(
                "band"
            ),
            (price.cast("decimal(12,2)") * 2).cast("double").alias("doubled"),
            F.year("o_orderdate").cast("long").alias("o_year"),
        )
    )


@query(
    "b2_cast_quarantine",
    """
    SELECT p_partkey, CAST(CASE WHEN p_type = 'SMALL' THEN NULL ELSE p_size END AS DOUBLE) AS size,
           CASE WHEN p_type = 'SMALL' THEN p_size || 'cm' END AS raw_size,
           CASE WHEN p_type = 'SMALL' THEN 'size' ELSE '' END AS failed
    FROM part
    """,
)
def casts(spark, d):
    part = load_table(spark, d, "part")
    suffix = F.when(F.col("p_type") == "SMALL", "cm").otherwise("")
    text = part.select(
        "p_partkey",
        F.concat(F.col("p_size").cast("string"), suffix).alias("size"),
        F.col("p_retailprice").cast("string").alias("price"),
    )
    good, bad = cast_quarantine(text, {"size": "int", "price": "decimal(12,2)"})
    kept = good.select(
        "p_partkey", "size", F.lit(None).cast("string").alias("raw_size"), F.lit("").alias("failed")
    )
    refused = bad.select(
        "p_partkey",
        F.lit(None).cast("int").alias("size"),
        F.col("size").alias("raw_size"),
        F.array_join("failed", ",").alias("failed"),
    )
    return as_double(kept.unionByName(refused), "size")


@query(
    "b3_null_safe_compare",
    """
    WITH a AS (SELECT nullif(event_type, 'error') AS kind, COUNT(*) AS n FROM events GROUP BY 1),
         b AS (SELECT nullif(event_type, 'error') AS kind, MAX(value) AS high FROM events GROUP BY 1)
    SELECT a.kind, n, high FROM a JOIN b ON a.kind IS NOT DISTINCT FROM b.kind
    """,
)
def null_safe(spark, d):
    kind = F.nullif("event_type", F.lit("error")).alias("kind")
    events = load_table(spark, d, "events")
    a = events.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    b = events.groupBy(kind.alias("kind_b")).agg(F.max("value").alias("high"))
    return a.join(b, F.col("kind").eqNullSafe(F.col("kind_b"))).drop("kind_b")


_FILL_SQL = """
    SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
             OVER (PARTITION BY {by} ORDER BY ts, event_id) AS value
    FROM events
"""


def _filled(spark, d, by, **options):
    events = load_table(spark, d, "events")
    kept = F.when(F.col("event_type") == "purchase", F.col("value"))
    rows = events.select("event_id", "ts", "user_id", F.length("props").alias("width"), kept.alias("value"))
    return fill_forward(rows, [by], ["ts", "event_id"], ["value"], **options).select("event_id", "value")


@query("b4_fill_forward", _FILL_SQL.format(by="user_id"))
def filled(spark, d):
    return _filled(spark, d, "user_id")


@query("b4_fill_forward_split", _FILL_SQL.format(by="length(props)"))
def filled_split(spark, d):
    """Two groups, one holding nine tenths of the rows; both are cut."""
    return _filled(spark, d, "width", group_rows=500)


@query(
    "b5_clean_keys",
    """
    SELECT trim(regexp_replace(lower('  ' || p_name || ' -- ' || p_brand || '/' || p_type || '! '),
                '[^\\p{L}\\p{N}]+', ' ', 'g')) AS k, COUNT(*) AS n
    FROM part GROUP BY 1
    """,
)
def cleaned(spark, d):
    part = load_table(spark, d, "part")
    text = F.concat(
        F.lit("  "), "p_name", F.lit(" -- "), "p_brand", F.lit("/"), "p_type", F.lit("! ")
    )
    keyed = clean_keys(part.select(text.alias("k")), ["k"])
    return keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"))

