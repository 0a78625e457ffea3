"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: White space as the contracts define it: the blank and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    Cuts the lineage: what is read more than once is computed once, and a lost
    executor costs only the task that ran on it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    """The text, with null taken as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Number of words, as a long; 0 for null."""
    marks = F.regexp_replace(whole_text(column), WORD, "\x01")
    return F.length(F.regexp_replace(marks, "[\\x20\\x09-\\x0D]+", "")).cast("long")


#: Bits of the filter by which ``marked_rows`` leaves rows out.
FILTER_BITS = 1 << 23


def marked_rows(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without most of those whose ``keys`` are not in ``wanted``.

    A bitmap of fixed size, at most ``FILTER_BITS / 64`` numbers, is broadcast, so that
    rows which cannot match need not be shuffled for the join that follows. No row
    that is in ``wanted`` is left out.
    """
    place = f"pmod(xxhash64({', '.join(keys)}), {FILTER_BITS})"
    word = F.expr(f"cast({place} div 64 as long)").alias("_word")
    bit = F.expr(f"shiftleft(1L, cast({place} % 64 as int))")
    bits = wanted.groupBy(word).agg(F.bit_or(bit).alias("_bits"))
    return (
        rows.withColumn("_word", word)
        .join(F.broadcast(bits), "_word")
        .where(F.col("_bits").bitwiseAND(bit) != 0)
        .drop("_word", "_bits")
    )
