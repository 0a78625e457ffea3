"""Time-series operators: islands, sessions, gap filling, calendars."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.joins import micros
from millrace.operators.windows import fill_forward, neighbour, running
from millrace.skew import GROUP_ROWS, plan_split

#: Missing periods made at a time.
PERIODS = 10_000


def islands(df: DataFrame, key: Sequence[str], day: str) -> DataFrame:
    """Runs of consecutive dates per key: ``start_day, end_day, days, rows``.

    Rows are counted per key and date first. A window then sees one row per
    date, so its size is bounded by the calendar however many rows a key has.
    """
    days = (
        df.where(F.col(day).isNotNull())
        .groupBy(*key, F.col(day).cast("date").alias("_d"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_d"))
    anchored = days.withColumn("_anchor", F.date_sub("_d", rank))
    return (
        anchored.groupBy(*key, "_anchor")
        .agg(
            F.min("_d").alias("start_day"),
            F.max("_d").alias("end_day"),
            F.count(F.lit(1)).alias("days"),
            F.sum("_n").alias("rows"),
        )
        .drop("_anchor")
    )


def sessionize(
    df: DataFrame, key: Sequence[str], ts: str, gap: float, group_rows: int | None = GROUP_ROWS
) -> DataFrame:
    """Sessions per key: ``start_ts, end_ts, rows``; a pause over ``gap`` seconds ends one.

    Rows are first merged into cells one gap wide. All rows of a cell belong to
    one session, so the windows that join cells see at most one row per gap of
    elapsed time, not one per event. A key with more than ``group_rows`` cells is split.
    """
    width = round(gap * 1_000_000)
    key = list(key)
    rows = df.where(F.col(ts).isNotNull())
    cells = rows.groupBy(*key, F.floor(micros(ts) / width).alias("_cell")).agg(
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    split = plan_split(cells, key, ["_cell"], group_rows)
    seen = neighbour(cells, key, ["_cell"], micros("_last"), "_before", split=split)
    pause = micros("_first") - F.col("_before")
    started = seen.withColumn("_new", F.when(pause <= width, 0).otherwise(1))
    numbered = running(started, key, ["_cell"], {"_session": ("sum", "_new")}, split=split)
    return (
        numbered.groupBy(*key, "_session")
        .agg(
            F.min("_first").alias("start_ts"),
            F.max("_last").alias("end_ts"),
            F.sum("_n").alias("rows"),
        )
        .drop("_session")
    )


_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def _grid(step: str, first: Column) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """``(point, index)``: the k-th period from ``first``, and about which k a time has."""
    count, _, unit = step.strip().partition(" ")
    unit = unit.strip().lower().removesuffix("s")
    if not count.isdigit() or int(count) < 1 or unit not in {**_SECONDS, **_MONTHS}:
        raise ValueError(f"step {step!r}: use a positive number and a unit, such as '1 day'")
    if unit in _MONTHS:
        months = int(count) * _MONTHS[unit]

        def point(k: Column) -> Column:
            return first + F.make_ym_interval(F.lit(0), (k * months).cast("int"))

        return point, lambda t: F.floor(F.months_between(t, first) / months)

    seconds = int(count) * _SECONDS[unit]

    def point(k: Column) -> Column:
        return first + F.make_dt_interval(secs=(k * seconds).cast("decimal(18,6)"))

    return point, lambda t: F.floor((micros(t) - micros(first)) / (seconds * 1_000_000))


def gap_fill(
    df: DataFrame,
    key: Sequence[str],
    ts: str,
    step: str,
    cols: Sequence[str],
    fill: str = "null",
    group_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """Add the periods missing between each key's first and last one.

    ``step`` is a length such as ``"1 day"`` or ``"3 months"``, counted from the
    key's first time. ``df`` holds one row per key and period; ``cols`` of added
    periods are null, zero or the last value (``fill="null"|"zero"|"last"``),
    and ``"last"`` also fills nulls of given rows. Rows off the step grid are kept.

    Each row adds the periods up to the next row, in blocks of ``PERIODS``, so no
    array holds a long gap. A key with more than ``group_rows`` rows is split. Rows
    without a time are kept as they are.
    """
    if fill not in ("null", "zero", "last"):
        raise ValueError("fill must be 'null', 'zero' or 'last'")
    return _filled(df, list(key), ts, step, cols, fill, group_rows)


def _filled(
    df: DataFrame,
    key: list[str],
    ts: str,
    step: str,
    cols: Sequence[str],
    fill: str,
    group_rows: int | None,
    previous: str | None = None,
) -> DataFrame:
    """:func:`gap_fill`, with the value of ``previous`` one period back on request.

    What comes before a row of the filled table is known without filling it: an added
    period follows another added one, whose value is null, or the given row itself,
    and a given row follows the given one before it unless a period lies between.
    """
    split = plan_split(df, key, [ts], group_rows)
    rows = neighbour(df, key, [ts], F.col(ts), "_next", True, split=split)
    # The first time of a key: a running minimum is the first all along.
    rows = running(rows, key, [ts], {"_first": ("min", ts)}, split=split)
    point, index = _grid(step, F.col("_first"))
    kind = df.schema[ts].dataType
    if previous:
        last = F.when(F.col(ts).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(previous).alias("v")))
        rows = neighbour(rows, key, [ts], last, "_last", split=split)
        # The index is approximate at month ends: look one period further each way.
        near = [index(F.col("_last.t")) + k for k in (-1, 0, 1, 2)]
        between = F.exists(
            F.array(*(point(k).cast(kind) for k in near)),
            lambda t: (t > F.col("_last.t")) & (t < F.col(ts)),
        )
        rows = rows.withColumn("_previous", F.when(F.col("_last").isNotNull() & ~between, F.col("_last.v")))
    if fill == "last":
        rows = fill_forward(rows, key, [ts], cols, split=split)
    low, high = (index(F.col(ts)) - 1).cast("long"), (index(F.col("_next")) + 1).cast("long")
    first = F.lit(0).cast("long")
    ends = F.col("_next").isNull() | F.col(ts).isNull()
    blocks = F.sequence(first, F.floor((high - low) / PERIODS))
    rows = rows.withColumns({"_low": low, "_high": high}).withColumn(
        "_block", F.explode(F.when(ends, F.array(first)).otherwise(blocks))
    )
    start = F.col("_low") + F.col("_block") * PERIODS
    # The last row of a key has nothing to fill: least() would skip its null.
    stop = F.when(~ends, F.least(F.col("_high"), start + PERIODS - 1))
    points = F.transform(F.sequence(start, stop), lambda k: point(k).cast(kind))
    missing = F.filter(points, lambda t: (t > F.col(ts)) & (t < F.col("_next")))
    none = F.array().cast(T.ArrayType(kind))
    given = F.when(F.col("_block") == 0, F.array(ts)).otherwise(none)
    periods = F.concat(given, F.coalesce(missing, none))
    kept = [*df.columns, *(["_previous"] if previous else [])]
    filled = rows.select(*kept, "_block", F.posexplode(periods).alias("_place", "_period"))
    is_given = (F.col("_place") == 0) & (F.col("_block") == 0)
    outputs = []
    for c in df.columns:
        if c == ts:
            outputs.append(F.col("_period").alias(c))
        elif c in key or (c in cols and fill == "last"):
            outputs.append(F.col(c))
        else:
            added = F.lit(0) if c in cols and fill == "zero" else F.lit(None)
            outputs.append(F.when(is_given, F.col(c)).otherwise(added).alias(c))
    if previous:
        follows = (F.col("_place") == 1) & (F.col("_block") == 0)
        outputs.append(
            F.when(is_given, F.col("_previous")).when(follows, F.col(previous)).alias("previous")
        )
    return filled.select(*outputs)


def period_change(
    df: DataFrame,
    key: Sequence[str],
    period: str,
    value: str,
    step: str = "1 month",
    group_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """Add ``previous, change, change_ratio`` against the previous calendar period.

    ``df`` holds one row per key and period. Missing periods appear with a null
    value, so a row is never compared with a period further back. Rows without a
    period come before no other.
    """
    rows = _filled(df, list(key), period, step, [value], "null", group_rows, previous=value)
    change = F.col(value) - F.col("previous")
    return rows.withColumn("change", change).withColumn(
        "change_ratio", F.try_divide(F.col("change").cast("double"), F.col("previous").cast("double"))
    )


def calendar(spark: SparkSession, lo: date, hi: date) -> DataFrame:
    """One row per date from ``lo`` to ``hi`` with its calendar attributes.

    Weeks are ISO weeks; ``weekday`` runs from 1 (Monday) to 7.
    """
    days = spark.range((hi - lo).days + 1)
    day = F.date_add(F.lit(lo), F.col("id").cast("int"))
    return days.select(day.alias("day")).select(
        "day",
        F.year("day").alias("year"),
        F.quarter("day").alias("quarter"),
        F.month("day").alias("month"),
        F.weekofyear("day").alias("iso_week"),
        (F.weekday("day") + 1).alias("weekday"),
        F.last_day("day").alias("month_end"),
        (F.last_day("day") == F.col("day")).alias("is_month_end"),
        (F.weekday("day") >= 5).alias("is_weekend"),
    )
