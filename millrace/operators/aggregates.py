"""Grouping, reshaping and distribution operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.windows import running
from millrace.session import checkpointed
from millrace.skew import GROUP_ROWS


# How a partial aggregate is aggregated again.
_AGAIN = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_FIRST = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def aggregate_levels(
    df: DataFrame,
    dims: Sequence[str],
    aggs: Mapping[str, Column | tuple[str, str]],
    mode: str | Sequence[Sequence[str]] = "rollup",
) -> DataFrame:
    """Aggregate at several levels with a ``level`` label.

    ``mode`` is ``"rollup"``, ``"cube"`` or a list of dimension lists. ``level``
    names the grouped dimensions (``"total"`` for none), which tells a null
    value in the data from a subtotal.

    ``aggs`` maps an output to ``(sum|count|min|max, column)`` or to any
    aggregate column. If all are pairs, rows are first aggregated once by all
    dimensions, and only the result is copied to the levels; with columns every
    row is copied.
    """
    dims = list(dims)
    if mode == "rollup":
        sets = [dims[:i] for i in range(len(dims), -1, -1)]
    elif mode == "cube":
        sets = [list(c) for i in range(len(dims), -1, -1) for c in combinations(dims, i)]
    else:
        sets = [list(s) for s in mode]
    if all(isinstance(value, tuple) for value in aggs.values()):
        df = df.groupBy(*dims).agg(*(_FIRST[fn](c).alias("_" + n) for n, (fn, c) in aggs.items()))
        aggs = {n: _AGAIN[fn]("_" + n) for n, (fn, _) in aggs.items()}
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in dims))
    present = [F.when(F.grouping(c) == 0, F.lit(c)) for c in dims]
    label = F.concat_ws("+", *present)
    outputs = [value.alias(name) for name, value in aggs.items()]
    return grouped.agg(label.alias("level"), *outputs).withColumn(
        "level", F.when(F.col("level") == "", "total").otherwise(F.col("level"))
    )


def pivot_table(
    df: DataFrame, index: Sequence[str], column: str, values: Sequence, agg: Column
) -> DataFrame:
    """Rows to columns, one per entry of ``values``; absent cells are null."""
    return df.groupBy(*index).pivot(column, list(values)).agg(agg)


def unpivot_table(
    df: DataFrame, ids: Sequence[str], cols: Sequence[str], keep_nulls: bool = True
) -> DataFrame:
    """Columns to ``name``/``value`` rows; the columns need a common type."""
    long = df.unpivot(list(ids), list(cols), "name", "value")
    return long if keep_nulls else long.where(F.col("value").isNotNull())


def _reused(df: DataFrame, group_rows: int | None) -> DataFrame:
    """Store an aggregate that split planning and the result both read."""
    return df if group_rows is None else checkpointed(df)


def mode_of(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Most frequent non-null value per group with its count; ties go to the smallest."""
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col(col).alias("v"))).alias("_b")
    return counts.groupBy(*by).agg(best).select(
        *by, F.col("_b.v").alias(col), (-F.col("_b.neg")).alias("n")
    )


def _exact(p: float) -> Column:
    """``p`` as it is written: 0.07 times 100 rows is the 7th, not the 8th."""
    written = Decimal(str(p))
    return F.lit(written).cast(f"decimal(18,{max(0, -written.as_tuple().exponent)})")


def exact_percentiles(
    df: DataFrame,
    by: Sequence[str],
    col: str,
    probs: Mapping[str, float],
    group_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """Continuous and discrete percentiles, ``{name}_cont`` and ``{name}_disc``.

    Values are counted first and ranked with a running sum, so a group's values
    are never held in one task's memory.
    """
    by = list(by)
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n"))
    counts = _reused(counts, group_rows)
    ranked = running(
        counts, by, [col], {"_upto": ("sum", "_n"), "_total": ("total", "_n")}, group_rows
    )

    def at(rank: Column) -> Column:
        first = F.col("_upto") - F.col("_n")
        return F.max(F.when((first <= rank) & (rank < F.col("_upto")), F.col(col)))

    outputs, result = [F.max("_total").alias("_total")], []
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("_total") - 1)
        outputs += [
            at(F.floor(place)).alias(f"_{name}_lo"),
            at(F.ceil(place)).alias(f"_{name}_hi"),
            at(F.greatest(F.ceil(_exact(p) * F.col("_total").cast("decimal(20,0)")) - 1, F.lit(0))).alias(
                f"{name}_disc"
            ),
        ]
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        result += [
            (low + (high - low) * (place - F.floor(place))).alias(f"{name}_cont"),
            F.col(f"{name}_disc"),
        ]
    return ranked.groupBy(*by).agg(*outputs).select(*by, *result)


def approx_profile(df: DataFrame, by: Sequence[str], col: str, heavy: int = 5) -> DataFrame:
    """Approximate distinct count, quartiles and heaviest values per group.

    All three are mergeable sketches: HyperLogLog (2.5 % relative error here),
    KLL quantiles (k = 200, about 1.3 % rank error) and a frequent-items sketch.
    """
    sketch = F.kll_sketch_agg_double(F.col(col).cast("double"))
    quantiles = [
        F.kll_sketch_get_quantile_double("_kll", F.lit(p)).alias(name)
        for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))
    ]
    return (
        df.groupBy(*by)
        .agg(
            F.approx_count_distinct(col, 0.025).alias("approx_distinct"),
            sketch.alias("_kll"),
            F.expr(f"approx_top_k(`{col}`, {int(heavy)})").alias("heavy"),
        )
        .select(*by, "approx_distinct", *quantiles, "heavy")
    )


def sketch_table(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """``*by, rows, nulls, distinct_sketch, value_sketch``: sketches to be stored and merged later.

    ``distinct_sketch`` is a HyperLogLog of the values' hashes (2^12 registers, 1.6 % relative
    error), ``value_sketch`` a KLL of the numbers (k = 200, about 1.3 % rank error). A group
    without a value has empty sketches. A row takes a few kilobytes, whatever it stands for.
    """
    known = F.when(F.col(col).isNotNull(), F.xxhash64(col))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count(F.lit(1)) - F.count(col)).alias("nulls"),
        F.hll_sketch_agg(known, 12).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(col).cast("double")).alias("value_sketch"),
    )


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of :func:`sketch_table` merged to the coarser groups of ``by``."""
    return sketches.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("value_sketch").alias("value_sketch"),
    )


def sketch_estimates(
    sketches: DataFrame, by: Sequence[str], probs: Mapping[str, float]
) -> DataFrame:
    """``*by, rows, nulls, approx_distinct`` and a quantile per entry of ``probs``.

    Quantiles are null where a group has no value.
    """
    some = F.col("rows") > F.col("nulls")
    return sketches.select(
        *by,
        "rows",
        "nulls",
        F.hll_sketch_estimate("distinct_sketch").alias("approx_distinct"),
        *(
            F.when(some, F.kll_sketch_get_quantile_double("value_sketch", F.lit(p))).alias(name)
            for name, p in probs.items()
        ),
    )


def histogram(df: DataFrame, col: str, lo: float, hi: float, n: int) -> DataFrame:
    """Counts in ``n`` equal bins of ``[lo, hi)``, with empty bins kept.

    Bin 0 counts values below ``lo``, bin ``n + 1`` those at or above ``hi``,
    NaN among them, since it sorts above all numbers, and bin -1 the nulls.
    """
    nan = F.when(F.isnan(F.col(col).cast("double")), F.lit(n + 1))
    inside = F.width_bucket(F.col(col), F.lit(lo), F.lit(hi), F.lit(n))
    bins = F.coalesce(nan, inside, F.lit(-1))
    counts = df.groupBy(bins.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    step = (hi - lo) / n
    spine = df.sparkSession.range(-1, n + 2).withColumnRenamed("id", "bin")
    # Both sides have at most n + 3 rows.
    joined = spine.join(F.broadcast(counts), "bin", "left")
    inside = F.col("bin").between(1, n)
    return joined.select(
        "bin",
        F.when(inside, F.lit(lo) + (F.col("bin") - 1) * step).alias("bin_lo"),
        F.when(inside, F.lit(lo) + F.col("bin") * step).alias("bin_hi"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def pareto_classes(
    df: DataFrame,
    key: str,
    value: str,
    cuts: Mapping[str, float],
    rest: str = "C",
    group_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """Rank keys by summed ``value`` and class them by running share.

    A key gets the first class whose cut lies above the share of the keys before
    it. Ties rank by key. The running sum is taken over one row per key, cut
    into pieces when there are many keys.
    """
    totals = df.groupBy(key).agg(F.sum(value).alias("total"))
    totals = _reused(totals, group_rows).withColumn("_one", F.lit(1))
    ranked = running(
        totals,
        [],
        ["total desc", key],
        {"upto": ("sum", "total"), "position": ("count", "_one"), "_all": ("total", "total")},
        group_rows,
    )
    before = F.try_divide((F.col("upto") - F.col("total")).cast("double"), F.col("_all").cast("double"))
    label = F.lit(rest)
    for name, cut in sorted(cuts.items(), key=lambda item: -item[1]):
        label = F.when(before < cut, F.lit(name)).otherwise(label)
    share = F.try_divide(F.col("upto").cast("double"), F.col("_all").cast("double"))
    return ranked.select(
        key, "total", "position", share.alias("running_share"), label.alias("class")
    )
