"""Vectorised Python functions: scalar, aggregate, table, grouped map, cogroup.

Python sees Arrow batches or bounded groups. Groups are cut with
:func:`millrace.skew.divide` first and the partial results are combined by
Spark, so a hot key is never held whole by one worker.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import checkpointed
from millrace.skew import PIECE, Parts, divide, plan_split, same_keys, small

PANDAS_ROWS = 500_000


def _by_group(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle on ``keys`` without merging small partitions.

    The runtime merges partitions by bytes; Python time follows the number of
    groups, so the merge would leave one worker with all the calls.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)


@F.pandas_udf(T.DoubleType())
def scaled(value: pd.Series) -> pd.Series:
    """Values to the 0..1 range that 0..100 covers; others are clipped."""
    return value.clip(0.0, 100.0) / 100.0


@F.pandas_udf(T.DoubleType())
def sum_of_squares(value: pd.Series) -> float:
    return float((value * value).sum())


def root_mean_square(
    df: DataFrame, by: Sequence[str], col: str, group_rows: int = PANDAS_ROWS
) -> DataFrame:
    """Per-group root mean square from a pandas aggregate over group pieces."""
    pieces = divide(df.select(*by, col).where(F.col(col).isNotNull()), by, group_rows)
    partial = _by_group(pieces, *by, PIECE).groupBy(*by, PIECE).agg(sum_of_squares(col).alias("_squares"))
    counts = pieces.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    sums = partial.groupBy(*by).agg(F.sum("_squares").alias("_squares"))
    return sums.join(counts, list(by)).select(
        *by, F.sqrt(F.col("_squares") / F.col("_n")).alias("rms")
    )


@F.arrow_udtf(returnType="word STRING, place BIGINT, n BIGINT")
class Words:
    """One row per blank-separated word of a text, with its place from 1 and the text's ``n``.

    Takes a table of a text and a number, a batch at a time: words and places come from
    Arrow's own functions over the whole batch. A null text has no words.
    """

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        words = pc.utf8_split_whitespace(pc.fill_null(pc.utf8_trim_whitespace(batch.column(0)), ""))
        text = pc.list_parent_indices(words).to_numpy()
        first = np.searchsorted(text, text)
        place = np.arange(1, len(text) + 1) - first
        found = pa.table([words.flatten(), pa.array(place), batch.column(1).take(pa.array(text))], ["word", "place", "n"])
        yield found.filter(pc.not_equal(found.column("word"), ""))


def summarise_groups(
    df: DataFrame, by: Sequence[str], col: str, group_rows: int = PANDAS_ROWS
) -> DataFrame:
    """``rows, low, high`` per group: pandas per piece, combined by Spark."""
    by = list(by)
    schema = T.StructType(
        [df.schema[c] for c in by]
        + [
            T.StructField("n", T.LongType()),
            T.StructField("low", T.DoubleType()),
            T.StructField("high", T.DoubleType()),
        ]
    )

    def summary(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values = rows[col]
        return pd.DataFrame([[*key[:-1], len(rows), values.min(), values.max()]], columns=schema.names)

    pieces = divide(df.select(*by, col), by, group_rows)
    partial = _by_group(pieces, *by, PIECE).groupBy(*by, PIECE).applyInPandas(summary, schema)
    return partial.groupBy(*by).agg(
        F.sum("n").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def attach_cogrouped(
    many: DataFrame,
    one: DataFrame,
    on: str,
    value: str,
    base: str,
    group_rows: int = PANDAS_ROWS,
) -> DataFrame:
    """Add ``ratio`` = ``many.value`` / ``one.base`` by cogrouping on ``on``.

    ``one`` has a row per key. It is copied to the pieces of a cut key, so each
    pandas call sees one piece and one row. A null key has no ratio.
    """
    parts = Parts(many, [on], group_rows)
    pieces = parts.divide(many)
    wanted = one.select(on, base).join(many.select(on).distinct(), on, "left_semi")
    copies = parts.copy(wanted, "_copy")
    schema = T.StructType([*many.schema, T.StructField("ratio", T.DoubleType())])

    def attach(rows: pd.DataFrame, row: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):  # a piece that no row was spread to
            return pd.DataFrame(columns=schema.names)
        rows = rows.drop(columns=PIECE)
        divisor = row[base].iloc[0] if len(row) else None
        rows["ratio"] = rows[value] / divisor if divisor else None
        return rows[schema.names]

    rows = _by_group(pieces, on, PIECE).groupBy(on, PIECE)
    return rows.cogroup(_by_group(copies, on, "_copy").groupBy(on, "_copy")).applyInPandas(
        attach, schema
    )


def batch_totals(df: DataFrame, by: str, col: str) -> DataFrame:
    """``rows, high`` per key, pre-aggregated per Arrow batch in pandas."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            grouped = rows.groupby(by, dropna=False)[col].agg(["size", "max"]).reset_index()
            yield grouped.set_axis([by, "n", "high"], axis=1)

    schema = T.StructType(
        [
            df.schema[by],
            T.StructField("n", T.LongType()),
            T.StructField("high", T.DoubleType()),
        ]
    )
    parts = df.select(by, col).mapInPandas(partial, schema)
    return parts.groupBy(by).agg(F.sum("n").alias("rows"), F.max("high").alias("high"))


def smoothed(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    col: str,
    alpha: float,
    name: str = "smoothed",
    group_rows: int = PANDAS_ROWS,
) -> DataFrame:
    """Add the exponential smoothing of ``col`` per group along ``order``, which is total.

    ``s = alpha * value + (1 - alpha) * s``, beginning with the group's first value. A null
    value leaves ``s`` as it is; before the first value ``s`` is null.

    A group over ``group_rows`` rows is smoothed in ordered pieces, each by a task of its
    own as if it began the group. What it would have been with the state before it differs
    by ``weight * (state - first value)``, so one row per piece suffices to hand the state
    on, and the input is read once: the smoothed pieces are stored before that.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    by = list(by)
    split = plan_split(df, by, order, group_rows)
    extra = ["_own", "_weight", "_first"]
    rows = split.tag(df).withColumn("_at", F.row_number().over(split.window()))
    schema = T.StructType([*rows.schema, *(T.StructField(c, T.DoubleType()) for c in extra)])

    def smooth(piece: pa.Table) -> pa.Table:
        # The other columns stay in Arrow: pandas would turn whole numbers with nulls into floats.
        piece = piece.sort_by("_at")
        values = piece.column(col).cast(pa.float64()).to_pandas()
        known = values.dropna()
        own = values.ewm(alpha=alpha, adjust=False, ignore_na=True).mean()
        weight = (1.0 - alpha) ** values.notna().cumsum()
        first = np.full(len(values), known.iloc[0] if len(known) else 0.0)
        for name, column in zip(extra, (own, weight, first), strict=True):
            piece = piece.append_column(name, pa.array(column, pa.float64(), from_pandas=True))
        return piece.select(schema.names)

    found = rows.groupBy(*split.keys).applyInArrow(smooth, schema)
    if split.cuts is None:
        return found.select(*df.columns, F.col("_own").alias(name))
    found = checkpointed(found)
    ends = found.where(F.col(PIECE).isNotNull()).groupBy(*by, PIECE).agg(
        F.max_by(F.struct(*extra), "_at").alias("_end")
    )
    ends = ends.select(*by, PIECE, "_end.*")
    state_schema = T.StructType([*ends.schema[: len(by) + 1], T.StructField("_state", T.DoubleType())])

    def hand_on(pieces: pa.Table) -> pa.Table:
        pieces = pieces.sort_by(PIECE)
        state, before = None, []
        for own, weight, first in zip(*(pieces.column(c).to_pylist() for c in extra), strict=True):
            before.append(state)
            if own is not None:  # else the piece holds no value
                state = own if state is None else own + weight * (state - first)
        pieces = pieces.append_column("_state", pa.array(before, pa.float64()))
        return pieces.select(state_schema.names)

    states = ends.groupBy(*by).applyInArrow(hand_on, state_schema)
    states = states.select(*(F.col(c).alias("_s_" + c) for c in [*by, PIECE]), "_state")
    joined = found.join(small(states, split.pieces), same_keys(found, states, [*by, PIECE], "_s_"), "left")
    shift = F.coalesce(F.col("_weight") * (F.col("_state") - F.col("_first")), F.lit(0.0))
    value = F.coalesce(F.col("_own") + shift, F.col("_state"))
    return joined.select(*df.columns, value.alias(name))
