"""Named SQL expressions and parameterised views."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register_sql_functions(spark: SparkSession) -> None:
    """Create the session's temporary SQL functions; all are inlined by Spark."""
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION value_band(v DOUBLE) RETURNS STRING
        RETURN CASE WHEN v IS NULL THEN 'none' WHEN v < 10 THEN 'low'
                    WHEN v < 50 THEN 'middle' ELSE 'high' END
        """
    )
    spark.sql(
        """
        CREATE OR REPLACE TEMPORARY FUNCTION net_price(price DECIMAL(12,2), discount DECIMAL(4,2))
        RETURNS DECIMAL(18,4)
        RETURN price * (1 - discount)
        """
    )


def register_orders_of(spark: SparkSession, orders_view: str) -> None:
    """Table function ``orders_of(customer, floor)`` over a view of orders."""
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION orders_of(customer BIGINT, floor_price DOUBLE)
        RETURNS TABLE (o_orderkey BIGINT, o_totalprice DOUBLE)
        RETURN SELECT o.o_orderkey, o.o_totalprice FROM {orders_view} o
               WHERE o.o_custkey = customer AND o.o_totalprice >= floor_price
        """
    )
