"""Typed casts with a quarantine, and canonical text keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cast_quarantine(
    df: DataFrame, casts: Mapping[str, str], failed: str = "failed"
) -> tuple[DataFrame, DataFrame]:
    """Cast columns, as ``(good, bad)``.

    ``bad`` keeps the rows as they came, with the names of the columns that do
    not cast in the column ``failed``, which ``df`` may not have. A null is not a failure.
    """
    if failed in df.columns:
        raise ValueError(f"cast_quarantine: the table has a column {failed!r}, name another")
    names = F.array_compact(
        F.array(
            *(
                F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(c))
                for c, t in casts.items()
            )
        )
    )
    flagged = df.withColumn(failed, names)
    good = flagged.where(F.size(failed) == 0).drop(failed)
    good = good.withColumns({c: F.col(c).try_cast(t) for c, t in casts.items()})
    return good, flagged.where(F.size(failed) > 0)


def clean_key(col: Column | str) -> Column:
    """Lower case, symbols to blanks, blank runs to one blank, trimmed.

    Letters and digits of every script stay.
    """
    text = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def clean_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace text columns by their canonical form."""
    return df.withColumns({c: clean_key(c) for c in cols})
