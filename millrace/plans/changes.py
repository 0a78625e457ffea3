"""Set operations, snapshot changes and hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.changes import diff_tables, merge_snapshot, scd2_apply
from millrace.operators.hierarchy import hierarchy_closure
from millrace.plans.registry import query
from millrace.session import checkpointed
from millrace.sources.tables import load_table


@query(
    "f3_union_distinct",
    """
    SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal < 0
    UNION SELECT s_nationkey FROM supplier
    """,
)
def union_distinct(spark, d):
    customer = load_table(spark, d, "customer").where("c_acctbal < 0")
    supplier = load_table(spark, d, "supplier")
    left = customer.select(F.col("c_nationkey").alias("nationkey"))
    return left.union(supplier.select("s_nationkey")).distinct()


@query(
    "f3_union_by_name",
    """
    SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL BY NAME SELECT s_acctbal AS balance, s_name AS name FROM supplier
    """,
)
def union_by_name(spark, d):
    customer = load_table(spark, d, "customer").select(
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    supplier = load_table(spark, d, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name")
    )
    return customer.unionByName(supplier, allowMissingColumns=True)


def _sets(spark, d):
    lines = load_table(spark, d, "lineitem")
    parts = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    other = lines.where("l_discount > 0.05").select(F.col("l_orderkey").alias("k"))
    return parts, other


_SETS_SQL = """
    SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'
    {op} SELECT l_orderkey FROM lineitem WHERE l_discount > 0.05
"""


@query("f4_intersect", _SETS_SQL.format(op="INTERSECT"))
def intersect(spark, d):
    a, b = _sets(spark, d)
    return a.distinct().intersect(b.distinct())


@query("f4_except", _SETS_SQL.format(op="EXCEPT"))
def subtract(spark, d):
    a, b = _sets(spark, d)
    return a.distinct().subtract(b.distinct())


@query("f4_intersect_all", _SETS_SQL.format(op="INTERSECT ALL"))
def intersect_all(spark, d):
    a, b = _sets(spark, d)
    return a.intersectAll(b)


@query("f4_except_all", _SETS_SQL.format(op="EXCEPT ALL"))
def except_all(spark, d):
    a, b = _sets(spark, d)
    return a.exceptAll(b)


_OLD_NEW_SQL = """
    WITH old AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders
                 WHERE o_orderdate < TIMESTAMP '2000-01-01'),
         new AS (SELECT o_orderkey,
                        CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice + 1
                             ELSE o_totalprice END AS o_totalprice,
                        CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END
                          AS o_orderstatus,
                        o_orderpriority
                 FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')
"""


def _old_new(spark, d):
    orders = load_table(spark, d, "orders")
    columns = ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]
    old = orders.where("o_orderdate < TIMESTAMP_NTZ '2000-01-01'").select(*columns)
    low, pending = F.col("o_orderpriority") == "5-LOW", F.col("o_orderstatus") == "P"
    new = orders.where("o_orderdate >= TIMESTAMP_NTZ '1997-01-01'").withColumns(
        {
            "o_totalprice": F.when(low, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
            "o_orderstatus": F.when(pending, "F").otherwise(F.col("o_orderstatus")),
        }
    )
    return old, new.select(*columns)


@query(
    "f5_diff_tables",
    _OLD_NEW_SQL
    + """
    , j AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey,
              CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed'
                   WHEN o.o_totalprice <> n.o_totalprice OR o.o_orderstatus <> n.o_orderstatus
                   THEN 'changed' END AS change,
              CASE WHEN o.o_totalprice <> n.o_totalprice AND o.o_orderstatus <> n.o_orderstatus
                   THEN 'o_totalprice,o_orderstatus'
                   WHEN o.o_totalprice <> n.o_totalprice THEN 'o_totalprice'
                   WHEN o.o_orderstatus <> n.o_orderstatus THEN 'o_orderstatus' ELSE '' END
                AS changed_columns
            FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey)
    SELECT * FROM j WHERE change IS NOT NULL
    """,
)
def diff(spark, d):
    old, new = _old_new(spark, d)
    changed = diff_tables(old, new, ["o_orderkey"])
    return changed.withColumn("changed_columns", F.array_join("changed_columns", ","))


@query(
    "f6_merge_snapshot",
    _OLD_NEW_SQL
    + """
    SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey,
           CASE WHEN n.o_orderkey IS NULL THEN o.o_totalprice ELSE n.o_totalprice END
             AS o_totalprice,
           CASE WHEN n.o_orderkey IS NULL THEN o.o_orderstatus ELSE n.o_orderstatus END
             AS o_orderstatus,
           coalesce(n.o_orderpriority, o.o_orderpriority) AS o_orderpriority,
           CASE WHEN o.o_orderkey IS NULL THEN 'inserted' WHEN n.o_orderkey IS NULL THEN 'kept'
                WHEN o.o_totalprice <> n.o_totalprice OR o.o_orderstatus <> n.o_orderstatus
                THEN 'updated' ELSE 'unchanged' END AS action
    FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey
    """,
)
def merge(spark, d):
    old, new = _old_new(spark, d)
    return merge_snapshot(old, new, ["o_orderkey"])


@query(
    "f7_scd2_apply",
    """
    WITH v AS (
        SELECT c_custkey, c_mktsegment AS segment, TIMESTAMP '2020-01-01' AS valid_from
        FROM customer
        UNION SELECT c_custkey, 'MOVED', TIMESTAMP '2021-06-01' FROM customer
               WHERE c_nationkey < 15 AND c_acctbal > 0
        UNION SELECT c_custkey, 'LATE', TIMESTAMP '2020-06-01' FROM customer
               WHERE c_mktsegment = 'BUILDING'),
      k AS (SELECT * FROM (SELECT *, lag(segment) OVER (PARTITION BY c_custkey ORDER BY valid_from)
                             AS before FROM v) WHERE before IS DISTINCT FROM segment)
    SELECT c_custkey, segment, valid_from,
           lead(valid_from) OVER (PARTITION BY c_custkey ORDER BY valid_from) AS valid_to,
           lead(valid_from) OVER (PARTITION BY c_custkey ORDER BY valid_from) IS NULL AS is_current
    FROM k
    """,
)
def versions(spark, d):
    """Two rounds: dated changes first, some of which repeat, then late ones that split."""
    customer = load_table(spark, d, "customer")

    def at(day):
        return F.lit(day).cast("timestamp_ntz")

    history = customer.select(
        "c_custkey",
        F.col("c_mktsegment").alias("segment"),
        at("2020-01-01").alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        F.lit(True).alias("is_current"),
    )
    moved = F.when(F.col("c_acctbal") > 0, "MOVED").otherwise(F.col("c_mktsegment"))
    first = customer.where("c_nationkey < 15").select(
        "c_custkey", moved.alias("segment"), at("2021-06-01").alias("ts")
    )
    late = customer.where("c_mktsegment = 'BUILDING'").select(
        "c_custkey", F.lit("LATE").alias("segment"), at("2020-06-01").alias("ts")
    )
    # A history is a stored table between two loads.
    once = checkpointed(scd2_apply(history, first, ["c_custkey"], ["segment"], "ts"))
    return scd2_apply(once, late, ["c_custkey"], ["segment"], "ts")


@query(
    "f7_scd2_closed",
    """
    WITH c AS (SELECT c_custkey AS k, c_nationkey % 5 AS g, c_mktsegment AS s FROM customer)
    SELECT k, s AS segment, TIMESTAMP '2020-01-01' AS valid_from,
           CASE WHEN g IN (1, 4) THEN TIMESTAMP '2020-03-01' ELSE TIMESTAMP '2020-06-01' END AS valid_to,
           FALSE AS is_current FROM c
    UNION ALL SELECT k, 'BACK', TIMESTAMP '2021-01-01', NULL, TRUE FROM c
    UNION ALL SELECT k, 'LATE', TIMESTAMP '2020-03-01', TIMESTAMP '2020-06-01', FALSE FROM c
               WHERE g IN (1, 4)
    UNION ALL SELECT k, 'GAP', TIMESTAMP '2020-08-01',
                     CASE WHEN g = 4 THEN TIMESTAMP '2020-10-01' ELSE TIMESTAMP '2021-01-01' END, FALSE
               FROM c WHERE g IN (2, 4)
    UNION ALL SELECT k, s, TIMESTAMP '2020-10-01', TIMESTAMP '2021-01-01', FALSE FROM c WHERE g IN (3, 4)
    """,
)
def closed_versions(spark, d):
    """Every key was closed and came back. Changes fall into the first range, into the gap,
    and bring the old segment back there; keys of the first group have none."""
    customer = load_table(spark, d, "customer").select(
        F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 5).alias("g"), "c_mktsegment"
    )

    def at(day):
        return F.lit(day).cast("timestamp_ntz")

    def version(segment, start, end):
        return customer.select(
            "k", segment.alias("segment"), at(start).alias("valid_from"), at(end).alias("valid_to"),
            F.lit(end is None).alias("is_current"),
        )

    history = version(F.col("c_mktsegment"), "2020-01-01", "2020-06-01").unionByName(
        version(F.lit("BACK"), "2021-01-01", None)
    )

    def change(groups, segment, day):
        return customer.where(F.col("g").isin(groups)).select(
            "k", segment.alias("segment"), at(day).alias("ts")
        )

    changes = (
        change([1, 4], F.lit("LATE"), "2020-03-01")
        .unionByName(change([2, 4], F.lit("GAP"), "2020-08-01"))
        .unionByName(change([3, 4], F.col("c_mktsegment"), "2020-10-01"))
    )
    return scd2_apply(history, changes, ["k"], ["segment"], "ts")


_EDGES_SQL = """
    SELECT 'world' AS parent, 'R' || r_regionkey AS child FROM region
    UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation
    UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
    UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders
"""


@query(
    "f8_hierarchy_closure",
    f"""
    WITH RECURSIVE e AS ({_EDGES_SQL}),
      w AS (SELECT parent AS ancestor, child AS descendant, 1 AS depth,
                   parent || '/' || child AS path FROM e
            UNION ALL SELECT w.ancestor, e.child, w.depth + 1, w.path || '/' || e.child
            FROM w JOIN e ON w.descendant = e.parent)
    SELECT ancestor, descendant, depth, path, FALSE AS is_cycle FROM w
    """,
)
def closure(spark, d):
    """World, region, nation, customer and order as one tree."""

    def edges(table, parent, p, child, c):
        return load_table(spark, d, table).select(
            F.concat(F.lit(p), F.col(parent).cast("string") if parent else F.lit("")).alias("parent"),
            F.concat(F.lit(c), F.col(child).cast("string")).alias("child"),
        )

    tree = (
        edges("region", None, "world", "r_regionkey", "R")
        .unionByName(edges("nation", "n_regionkey", "R", "n_nationkey", "N"))
        .unionByName(edges("customer", "c_nationkey", "N", "c_custkey", "C"))
        .unionByName(edges("orders", "o_custkey", "C", "o_orderkey", "O"))
    )
    return hierarchy_closure(tree).withColumn("path", F.array_join("path", "/"))
