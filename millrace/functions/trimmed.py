"""A trimmed mean from a mergeable digest, with bounds that hold for certain.

A digest is a list of cells ``low, high, n, total``: ``n`` values between ``low`` and
``high`` that sum to ``total``. Cells are joined by rank, finely at both ends and coarsely
in the middle (the arcsine scale of the t-digest, Dunning and Ertl, 2019), so a digest has at most
``cells`` of them, and two digests are merged by joining the cells of both.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = 200
#: Digests of a group that one task of the first merge gathers come from every this-many-th task.
FAN = 256
#: Cells that a task keeps before it gives out what it has and starts anew.
HELD = 1_000_000

_CELL = ("_low", "_high", "_count", "_total")
_CELL_TYPES = (T.DoubleType(), T.DoubleType(), T.LongType(), T.DoubleType())


def joined_cells(low, high, n, total, cells: int = CELLS):
    """The cells, in the order of their means, with those of like rank made one."""
    order = np.argsort(total / n, kind="stable")
    low, high, n, total = low[order], high[order], n[order], total[order]
    middle = (np.cumsum(n) - n / 2) / n.sum()
    bucket = np.floor(cells * (np.arcsin(2 * middle - 1) / np.pi + 0.5))
    starts = np.flatnonzero(np.r_[True, np.diff(bucket) > 0])
    return (
        np.minimum.reduceat(low, starts),
        np.maximum.reduceat(high, starts),
        np.add.reduceat(n, starts),
        np.add.reduceat(total, starts),
    )


def smallest_sum(low, high, n, total, k: int) -> tuple[float, float]:
    """Bounds of the sum of the ``k`` smallest values.

    No choice of ``k`` values sums to less, so whole cells in the order of their means, and
    the smallest of the next, whose mean is at most its cell's, bound it from above. From
    below, the ``m`` smallest of a cell sum to at least ``m * low`` and to at least
    ``total - (n - m) * high``. The greater of the two is convex in ``m``; the least sum of
    such functions takes their slopes in rising order.
    """

    def filled(slopes, lengths):
        order = np.argsort(slopes, kind="stable")
        slopes, lengths = slopes[order], lengths[order]
        upto = np.cumsum(lengths)
        return float((np.clip(k - (upto - lengths), 0, lengths) * slopes).sum())

    wide = high > low
    turn = np.where(wide, (n * high - total) / np.where(wide, high - low, 1.0), n).clip(0, n)
    return filled(np.r_[low, high], np.r_[turn, n - turn]), filled(total / n, n.astype(float))


def trimmed_bounds(low, high, n, total, trim: Fraction) -> tuple[int, float, float, float]:
    """``rows, mean, mean_low, mean_high`` without the ``trim`` smallest and largest."""
    rows = int(n.sum())
    cut = rows * trim.numerator // trim.denominator
    below_low, below_high = smallest_sum(low, high, n, total, cut)
    upto_low, upto_high = smallest_sum(low, high, n, total, rows - cut)
    kept = rows - 2 * cut
    slack = 1e-12 * float(np.abs(total).sum())  # of adding in another order
    return (
        rows,
        (upto_high - below_high) / kept,
        (upto_low - below_high - slack) / kept,
        (upto_high - below_low + slack) / kept,
    )


def _groups(table: pa.Table, by: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """The key values of each group in a table, and its row numbers."""
    if not by:
        yield (), np.arange(table.num_rows)
        return
    numbered = table.select(list(by)).append_column("_i", pa.array(np.arange(table.num_rows)))
    listed = numbered.group_by(list(by)).aggregate([("_i", "list")])
    keys = zip(*(listed.column(c).to_pylist() for c in by), strict=True)
    for key, rows in zip(keys, listed.column("_i_list").combine_chunks(), strict=True):
        yield key, np.asarray(rows.values)


def trimmed_mean(
    df: DataFrame, by: Sequence[str], col: str, trim: float, cells: int = CELLS
) -> DataFrame:
    """``*by, rows, mean, mean_low, mean_high`` per group: the mean without the share ``trim``
    of its rows at either end, and bounds between which the exact one lies.

    Nulls, NaN and infinite values take no part; a group of none gives no row. Each task
    keeps a digest per group it meets, so a hot group brings at most ``cells`` rows of each
    task to the shuffle (more only from a task of more than ``HELD / cells`` groups). They are
    merged in two steps, of every ``FAN``-th task and of all.
    """
    by = list(by)
    share = Fraction(str(trim))
    if not 0 <= share < Fraction(1, 2):
        raise ValueError("trim must be at least 0 and below a half")
    key_fields = [df.schema[c] for c in by]
    cell_fields = [T.StructField(c, t) for c, t in zip(_CELL, _CELL_TYPES, strict=True)]
    cell_schema = T.StructType([*key_fields, T.StructField("_fan", T.IntegerType()), *cell_fields])
    result_schema = T.StructType(
        [*key_fields, T.StructField("rows", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("mean", "mean_low", "mean_high")]
    )
    arrow_keys: dict[str, pa.DataType] = {}

    def batch(held: dict, fans: dict) -> pa.RecordBatch:
        keys = list(held)
        sizes = [len(held[k][0]) for k in keys]
        columns = [
            pa.array([k[i] for k, m in zip(keys, sizes, strict=True) for _ in range(m)], arrow_keys[c])
            for i, c in enumerate(by)
        ]
        columns.append(pa.array(np.repeat([fans[k] for k in keys], sizes), pa.int32()))
        columns += [pa.array(np.concatenate([held[k][i] for k in keys])) for i in range(4)]
        return pa.RecordBatch.from_arrays(columns, [*by, "_fan", *_CELL])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fans, size = {}, {}, 0
        for rows in batches:
            table = pa.Table.from_batches([rows])
            arrow_keys.update({c: table.schema.field(c).type for c in by})
            values = table.column("_value").to_numpy()
            fan = table.column("_fan")[0].as_py()
            for key, at in _groups(table, by):
                v = values[at]
                new = (v, v, np.ones(len(v), np.int64), v)
                old = held.get(key)
                if old is not None:
                    new = tuple(np.concatenate(pair) for pair in zip(old, new, strict=True))
                    size -= len(old[0])
                held[key], fans[key] = joined_cells(*new, cells), fan
                size += len(held[key][0])
            if size > HELD:
                yield batch(held, fans)
                held, fans, size = {}, {}, 0
        if held:
            yield batch(held, fans)

    def arrays(table: pa.Table) -> list[np.ndarray]:
        return [table.column(c).to_numpy() for c in _CELL]

    def merged(table: pa.Table) -> pa.Table:
        found = joined_cells(*arrays(table), cells)
        keys = [table.column(c).combine_chunks().take(pa.array([0] * len(found[0]))) for c in [*by, "_fan"]]
        return pa.table([*keys, *map(pa.array, found)], [*by, "_fan", *_CELL])

    def bounds(table: pa.Table) -> pa.Table:
        found = trimmed_bounds(*joined_cells(*arrays(table), cells), share)
        keys = [table.column(c).slice(0, 1) for c in by]
        return pa.table([*keys, *([v] for v in found)], result_schema.names)

    fan = F.pmod(F.spark_partition_id(), F.lit(FAN)).cast("int").alias("_fan")
    value = F.col(col).cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    slim = df.where(finite).select(*by, fan, value.alias("_value"))
    digests = slim.mapInArrow(digest, cell_schema)
    halfway = digests.groupBy(*by, "_fan").applyInArrow(merged, cell_schema)
    return halfway.groupBy(*by).applyInArrow(bounds, result_schema)
