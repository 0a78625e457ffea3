"""Constraint checks and column profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _key_text(columns: Sequence[str]) -> Column:
    """The key as JSON, which tells null from text and one column from the next."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def check_constraints(
    df: DataFrame,
    unique: Sequence[Sequence[str]] = (),
    not_null: Sequence[str] = (),
    refs: Sequence[tuple[str, DataFrame, str]] = (),
    ranges: Mapping[str, tuple] | None = None,
) -> DataFrame:
    """Violations as ``rule, key, rows``.

    ``unique`` lists column sets, ``refs`` lists ``(column, parent, parent
    column)`` where null passes, ``ranges`` maps a column to an inclusive
    ``(low, high)`` with None for an open end. Null keys count as equal. ``key`` is a JSON
    object. ``rows`` counts offending rows; for a duplicated key it is the number of
    rows with that key. All ``not_null`` and ``range`` rules share one pass.

    Every rule counts per key before anything is joined, so a key held by many
    rows is one row in the join.
    """
    parts = []
    for columns in unique:
        counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
        parts.append((f"unique({','.join(columns)})", _key_text(columns), counted))
    for c, parent, key in refs:
        counted = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("rows"))
        known = parent.select(F.col(key).alias("_key")).distinct()
        orphans = counted.join(known, counted[c] == known["_key"], "left_anti")
        parts.append((f"ref({c})", _key_text([c]), orphans))
    tests = [(f"not_null({c})", c, F.col(c).isNull()) for c in not_null]
    for c, (low, high) in (ranges or {}).items():
        below = F.lit(False) if low is None else F.col(c) < low
        above = F.lit(False) if high is None else F.col(c) > high
        tests.append((f"range({c})", c, below | above))
    if tests:
        broken = [
            F.when(test, F.struct(F.lit(rule).alias("rule"), _key_text([c]).alias("key")))
            for rule, c, test in tests
        ]
        each = df.select(F.explode(F.array_compact(F.array(*broken))).alias("v"))
        counted = each.groupBy("v.rule", "v.key").agg(F.count(F.lit(1)).alias("rows"))
        parts.append((F.col("rule"), F.col("key"), counted))
    if not parts:
        raise ValueError("no rule given")
    found = [
        rows.select(
            (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule"), key.alias("key"), "rows"
        )
        for rule, key, rows in parts
    ]
    return reduce(DataFrame.unionByName, found)


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: ``column, rows, nulls, distinct_values, min, max``.

    Counts and bounds come from one pass that shuffles one row per task. Exact
    distinct counts take a second pass, which shuffles each column's distinct
    values; ``approx=True`` uses HyperLogLog in the first pass instead. Nested
    columns have no min and max.
    """
    facts, distinct = [], []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        plain = not isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType))
        low = F.min(c).cast("string") if plain else F.lit(None).cast("string")
        high = F.max(c).cast("string") if plain else F.lit(None).cast("string")
        facts += [
            F.count(c).alias(f"{field.name}.n"),
            low.alias(f"{field.name}.lo"),
            high.alias(f"{field.name}.hi"),
        ]
        counted = F.approx_count_distinct(c) if approx else F.count_distinct(c)
        distinct.append(counted.alias(f"{field.name}.d"))
    if approx:
        facts += distinct
    one = df.agg(F.count(F.lit(1)).alias("rows"), *facts)
    if not approx:
        counts = df.agg(*distinct).select(F.struct("*").alias("_distinct"))
        one = one.withColumn("_distinct", counts.scalar()).select("*", "_distinct.*")

    def fact(name: str, kind: str) -> Column:
        return F.col(f"`{name}.{kind}`")

    entries = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.col("rows"),
            (F.col("rows") - fact(f.name, "n")).alias("nulls"),
            fact(f.name, "d").alias("distinct_values"),
            fact(f.name, "lo").alias("min"),
            fact(f.name, "hi").alias("max"),
        )
        for f in df.schema
    ]
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
