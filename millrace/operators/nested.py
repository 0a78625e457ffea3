"""JSON and XML text columns, and nesting of child rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.skew import order_by

CORRUPT = "_corrupt"


def _parsed_columns(df: DataFrame, col: str, schema: str, parse) -> DataFrame:
    declared = T.StructType.fromDDL(schema)
    full = T.StructType([*declared, T.StructField(CORRUPT, T.StringType(), True)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = df.withColumn("_doc", parse(F.col(col), full, options))
    unread = F.col("_doc").isNull() | F.col("_doc")[CORRUPT].isNotNull()
    bad = F.col(col).isNotNull() & unread
    return rows.select(
        *df.columns, *(F.col("_doc")[n].alias(n) for n in declared.names), bad.alias("is_bad")
    )


def json_columns(df: DataFrame, col: str, schema: str) -> DataFrame:
    """Add the typed fields of a JSON text column and an ``is_bad`` flag.

    A document that is not JSON, or holds a field of another type, is bad; a
    null document is not.
    """
    return _parsed_columns(df, col, schema, lambda c, s, o: F.from_json(c, s, o))


def xml_columns(
    df: DataFrame, col: str, schema: str, options: Mapping[str, Any] | None = None
) -> DataFrame:
    """Add the typed fields of an XML text column and an ``is_bad`` flag."""
    extra = dict(options or {})
    return _parsed_columns(df, col, schema, lambda c, s, o: F.from_xml(c, s, {**o, **extra}))


def nest(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    order: Sequence[str],
    max_items: int = 1_000_000,
) -> DataFrame:
    """Child rows to an ordered array of structs, one row per key: ``keys, items``.

    An array lives in one task's memory, so a key with more than ``max_items``
    rows raises instead of being cut. ``order`` should be total within a key.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by(order)))
    message = F.lit(f"nest: a key has more than {max_items} rows; raise max_items or aggregate")
    checked = F.when(F.col("_rn") > max_items, F.raise_error(message).cast("int")).otherwise(F.col("_rn"))
    rows = df.withColumn("_rn", place).select(
        *keys, F.struct(checked.alias("_rn"), *cols).alias("_item")
    )
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_item")).alias("_items"))

    def child(item: Column) -> Column:
        return F.struct(*(item[c].alias(c) for c in cols))

    return grouped.select(*keys, F.transform("_items", child).alias("items"))


def unnest(df: DataFrame, col: str = "items", outer: bool = False) -> DataFrame:
    """An array-of-structs column back to one row per element.

    Rows whose array is empty or null give no row or, with ``outer``, one with
    null fields. All other columns stay.
    """
    others = [c for c in df.columns if c != col]
    explode = F.explode_outer if outer else F.explode
    return df.select(*others, explode(col).alias("_item")).select(*others, "_item.*")
