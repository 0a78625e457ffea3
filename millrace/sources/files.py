"""CSV reading with a quarantine, partition replacement, incremental loads."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def read_csv_quarantine(
    spark: SparkSession, path: str, schema: T.StructType | str, **options: Any
) -> tuple[DataFrame, DataFrame]:
    """Read CSV as ``(good, bad)``; ``bad`` holds the raw lines that do not parse.

    A line is malformed by any of its fields, whichever columns the caller
    selects later. The reader only parses columns the query uses, so both
    filters use every column, in a test that is always true.
    """
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*declared, T.StructField(CORRUPT, T.StringType(), True)])
    rows = (
        spark.read.schema(full)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", "false")
        .options(**options)
        .csv(path)
    )
    parsed = F.pmod(F.xxhash64(*declared.names), F.lit(2)) >= 0
    good = rows.where(F.col(CORRUPT).isNull() & parsed).drop(CORRUPT)
    bad = rows.where(F.col(CORRUPT).isNotNull() & parsed).select(F.col(CORRUPT).alias("line"))
    return good, bad


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Replace the partitions of ``path`` that occur in ``df``; keep all others.

    The rebalance hint sends each partition's rows together and lets the runtime
    split a large partition over several tasks and files.
    """
    (
        df.hint("rebalance", *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def load_since(df: DataFrame, col: str, mark: Any) -> tuple[DataFrame, Any]:
    """Rows with ``col`` above ``mark`` and the new mark.

    Rows equal to the mark are taken as loaded, so ``col`` must be a strictly
    increasing key. ``mark=None`` loads everything. The delta is closed at the
    new mark: rows that arrive later belong to the next load.
    """
    newer = df if mark is None else df.where(F.col(col) > F.lit(mark))
    top = newer.agg(F.max(col)).first()[0]
    if top is None:
        return newer.limit(0), mark
    return newer.where(F.col(col) <= F.lit(top)), top
