"""Window operators that stay even when one group is very large.

Each function plans a split first (see :mod:`millrace.skew`). Without a large
group the plan is one ordinary Spark window. Planning samples the groups of the
input; a caller that knows the groups, or can plan on something cheaper
than the input, passes ``split`` or ``group_rows=None`` instead.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.skew import (
    GROUP_ROWS,
    PIECE,
    Split,
    at_or_after,
    divide,
    order_by,
    parse_order,
    plan_split,
    same_keys,
)


def _struct(names: Sequence[str]) -> Column:
    return F.struct(*names)


def number_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: str = "row_number",
    group_rows: int | None = GROUP_ROWS,
    split: Split | None = None,
) -> DataFrame:
    """Add the row's number in its group, from 1; ``order`` should be total."""
    split = split or plan_split(df, by, order, group_rows)
    rows = split.carry(
        df,
        {"rows": F.count(F.lit(1))},
        {"_rows": lambda others, whole: F.sum("_p_rows").over(others)},
    )
    number = F.coalesce("_rows", F.lit(0)) + F.row_number().over(split.window())
    return rows.withColumn(name, number.cast("long")).drop("_rows", PIECE)


RANK_COLUMNS = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "group_rows", "ntile")


def rank_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    tiles: int | None = None,
    group_rows: int | None = GROUP_ROWS,
    split: Split | None = None,
) -> DataFrame:
    """Add row_number, rank, dense_rank, percent_rank, cume_dist, group_rows.

    With ``tiles`` an ``ntile`` column is added as well. Where a group is large, ranks come
    from counted values, so that rows with equal sort values are divided too.
    """
    if set(df.columns) & set(RANK_COLUMNS):
        raise ValueError(f"rename columns among {RANK_COLUMNS}")
    names = [n for n, _ in parse_order(order)]
    if split is None:
        split = plan_split(df, by, order, group_rows)
        if split.cuts is not None:
            return _shares(_counted_ranks(df, list(by), order, names, group_rows), tiles)
    rows = split.carry(
        df,
        {"rows": F.count(F.lit(1)), "values": F.count_distinct(_struct(names))},
        {
            "_rows": lambda others, whole: F.sum("_p_rows").over(others),
            "_values": lambda others, whole: F.sum("_p_values").over(others),
            "_total": lambda others, whole: F.sum("_p_rows").over(whole),
        },
    )
    w = split.window()
    before = F.coalesce("_rows", F.lit(0))
    total = F.coalesce("_total", F.count(F.lit(1)).over(Window.partitionBy(*split.keys)))
    # The default frame runs to the last peer of the current row.
    through_peers = before + F.count(F.lit(1)).over(w)
    rows = rows.withColumns(
        {
            "row_number": (before + F.row_number().over(w)).cast("long"),
            "rank": (before + F.rank().over(w)).cast("long"),
            "dense_rank": (F.coalesce("_values", F.lit(0)) + F.dense_rank().over(w)).cast("long"),
            "cume_dist": through_peers / total,
            "group_rows": total,
        }
    )
    return _shares(rows.drop("_rows", "_values", "_total", PIECE), tiles)


def _counted_ranks(
    df: DataFrame, by: list[str], order: Sequence[str], names: list[str], group_rows: int
) -> DataFrame:
    """Ranks from one row per group and value and from sums over those before it.

    Rows of one value are cut into pieces of about ``group_rows`` and numbered in each; so no
    task sees all rows of a value or of a group.
    """
    keys = [*by, *dict.fromkeys(n for n in names if n not in by)]
    rows = divide(df, keys, group_rows)
    pieces = rows.groupBy(*keys, PIECE).agg(F.count(F.lit(1)).alias("_n"))
    values = pieces.groupBy(*keys).agg(F.sum("_n").alias("_n"))
    sums = {"_through": ("sum", "_n"), "_dense": ("count", "_n"), "_total": ("total", "_n")}
    values = running(values, by, order, sums, group_rows).withColumnRenamed("_n", "_same")
    values = values.select(*(F.col(k).alias("_v_" + k) for k in keys), "_same", "_through", "_dense", "_total")
    earlier = Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_skip", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    places = pieces.join(values, same_keys(pieces, values, keys, "_v_")).select(
        *(F.col(k).alias("_p_" + k) for k in [*keys, PIECE]),
        "_same", "_through", "_dense", "_total", "_skip",
    )
    joined = rows.join(places, same_keys(rows, places, [*keys, PIECE], "_p_"))
    place = F.row_number().over(Window.partitionBy(*keys, PIECE).orderBy(*order_by(order)))
    before = F.col("_through") - F.col("_same")
    return joined.withColumns(
        {
            "row_number": (before + F.col("_skip") + place).cast("long"),
            "rank": (before + 1).cast("long"),
            "dense_rank": F.col("_dense").cast("long"),
            "cume_dist": F.col("_through") / F.col("_total"),
            "group_rows": F.col("_total").cast("long"),
        }
    ).select(*df.columns, "row_number", "rank", "dense_rank", "cume_dist", "group_rows")


def _shares(rows: DataFrame, tiles: int | None) -> DataFrame:
    """``rows`` with percent_rank and ntile, which follow from the other ranks."""
    rows = rows.withColumn(
        "percent_rank",
        F.when(F.col("group_rows") > 1, (F.col("rank") - 1) / (F.col("group_rows") - 1)).otherwise(
            F.lit(0.0)
        ),
    )
    if tiles:
        # The first `extra` tiles hold one row more than the others.
        base = F.floor(F.col("group_rows") / tiles)
        extra = F.col("group_rows") % tiles
        n = F.col("row_number")
        long_rows = extra * (base + 1)
        rows = rows.withColumn(
            "ntile",
            F.when(n <= long_rows, F.ceil(n / (base + 1)))
            .otherwise(extra + F.ceil(F.try_divide(n - long_rows, base)))
            .cast("long"),
        )
    return rows


_COMBINE: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + b,
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
    "total": lambda a, b: F.coalesce(a, b),
}
_PARTIAL = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "total": F.sum}


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    aggs: Mapping[str, tuple[str, str]],
    group_rows: int | None = GROUP_ROWS,
    split: Split | None = None,
) -> DataFrame:
    """Add running aggregates ``{output: (sum|count|min|max|total, column)}``.

    The frame runs from the group's first row to the current row, row by row;
    ``total`` is the sum over the whole group. Sum decimals or whole numbers:
    doubles depend on the order of addition, here as in any Spark sum.
    """
    split = split or plan_split(df, by, order, group_rows)
    fold = {}
    for out, (fn, _) in aggs.items():
        again = F.sum if fn == "count" else _PARTIAL[fn]
        fold["_c_" + out] = lambda others, whole, a=again, o=out, f=fn: a("_p_" + o).over(
            whole if f == "total" else others
        )
    partial = {out: _PARTIAL[fn](F.col(c)) for out, (fn, c) in aggs.items()}
    rows = split.carry(df, partial, fold)
    upto = split.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*split.keys)
    values = {}
    for out, (fn, c) in aggs.items():
        inside = _PARTIAL[fn](F.col(c)).over(whole if fn == "total" else upto)
        values[out] = _COMBINE[fn](F.col("_c_" + out), inside)
    return rows.withColumns(values).drop(PIECE, *fold)


def frame_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    exprs: Mapping[str, Callable],
    before: int = 0,
    after: int = 0,
    group_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """Add window expressions that reach a bounded number of rows.

    ``exprs`` maps an output name to a function of the ordered window, such as
    ``lambda w: F.lag("value").over(w)`` or
    ``lambda w: F.avg("value").over(w.rowsBetween(-2, 0))``. None may look
    further than ``before`` rows back or ``after`` rows ahead. Large groups are
    cut by row number, and each piece borrows those rows from its neighbours.
    """
    split = plan_split(df, by, order, group_rows)
    if split.cuts is None:
        w = Window.partitionBy(*by).orderBy(*order_by(order))
        return df.withColumns({name: make(w) for name, make in exprs.items()})
    size = max(group_rows, 8 * (before + after))
    index = F.col("_rn") - 1
    home = F.floor(index / size)
    pieces = F.sequence(F.floor((index - after) / size), F.floor((index + before) / size))
    rows = number_rows(df, by, order, "_rn", split=split).select(
        *df.columns, home.alias("_home"), F.explode(pieces).alias(PIECE)
    )
    w = Window.partitionBy(*by, PIECE).orderBy(*order_by(order))
    rows = rows.withColumns({name: make(w) for name, make in exprs.items()})
    return rows.where(F.col(PIECE) == F.col("_home")).drop(PIECE, "_home")


def frame_range(
    df: DataFrame,
    by: Sequence[str],
    ts: str,
    aggs: Mapping[str, tuple[str, str]],
    before: float = 0,
    after: float = 0,
    group_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """Add ``{output: (sum|count|min|max|avg, column)}`` over the rows from ``before`` to
    ``after`` seconds around ``ts``.

    Time is cut into blocks as wide as the frame. A frame then covers the end of
    one block and the beginning of the next, which two running aggregates give, one
    from either side: the work grows with the rows, not with rows times frame, and a
    key with very many rows is dealt out by block. A block over ``group_rows`` rows is cut
    into pieces, and either running aggregate carries what lies in the pieces before. Both
    run over the same pieces, to which data and questions are shuffled once.
    Rows of one key and time share a frame and are aggregated first. Rows without a
    time share theirs.
    """
    if before < 0 or after < 0:
        raise ValueError("before and after are distances")
    back, ahead = round(before * 1_000_000), round(after * 1_000_000)
    width = back + ahead
    parts = {}
    for i, (fn, c) in enumerate(aggs.values()):
        kinds = ("sum", "count") if fn == "avg" else (fn,)
        parts.update({f"_{k}_{i}": (k, c) for k in kinds})
    fold = {n: F.sum if k == "count" else _PARTIAL[k] for n, (k, _) in parts.items()}
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.withColumn("_us", us)
    points = rows.groupBy(*by, "_us").agg(*(_PARTIAL[k](F.col(c)).alias(n) for n, (k, c) in parts.items()))
    if width:
        # Each point is data in its own block, and asks at either edge of its frame. Seen from
        # either side, data comes before the questions at its own time that it answers.
        own, low, high = (
            F.struct((F.col("_us") + shift).alias("at"), F.lit(asks).alias("asks"))
            for shift, asks in ((0, 0), (-back, -1), (ahead, 1))
        )
        copies = F.when(F.col("_us").isNull(), F.array(own)).otherwise(F.array(own, low, high))
        keys, order = [*by, "_block"], ["_at", "_asks"]

        def placed(df: DataFrame, e: Column, values: Mapping[str, Column]) -> DataFrame:
            place = {"_block": F.floor(e["at"] / width), "_at": e["at"], "_asks": e["asks"]}
            return df.select(*by, "_us", *(c.alias(n) for n, c in {**place, **values}.items()))

        # Planned on the rows, of which the sample is drawn before anything is shuffled.
        slim = rows.select(*by, "_us", F.explode(copies).alias("_e"))
        split = plan_split(placed(slim, F.col("_e"), {}), keys, order, group_rows)
        is_data = F.col("_asks") == 0
        again = {n: "sum" if k == "count" else k for n, (k, _) in parts.items()}
        events = placed(
            points.withColumn("_e", F.explode(copies)),
            F.col("_e"),
            {"_d" + n: F.when(F.col("_e.asks") == 0, F.col(n)) for n in parts},
        )
        kinds = {n: points.schema[n].dataType for n in parts}
        for n, kind in kinds.items():
            if isinstance(kind, T.DecimalType) and again[n] == "sum":
                kinds[n] = T.DecimalType(min(38, kind.precision + 20), kind.scale)
        if split.cuts is None:
            events = events.withColumns({s + n: F.lit(None).cast(k) for s in ("_b", "_a") for n, k in kinds.items()})
        else:
            # What lies in the other pieces of a block comes from the rows, all in one aggregate.
            data = placed(rows.where(F.col("_us").isNotNull()), own, {"_x" + n: F.col(c) for n, (_, c) in parts.items()})
            partial = {n: _PARTIAL[k](F.col("_x" + n)) for n, (k, _) in parts.items()}
            folds = [
                {side + n: lambda others, whole, n=n: fold[n]("_p_" + n).over(others).cast(kinds[n]) for n in parts}
                for side in ("_b", "_a")
            ]
            events = split.attach(split.tag(events), split.fold(data, partial, *folds))
        start = Window.unboundedPreceding
        seen = {}
        for n, k in again.items():
            up, down = (
                _COMBINE[k](F.col(side + n), _PARTIAL[k]("_d" + n).over(split.window(backwards).rowsBetween(start, 0)))
                for side, backwards in (("_b", False), ("_a", True))
            )
            seen["_v" + n] = F.when(F.col("_asks") == 1, up).when(F.col("_asks") == -1, down).otherwise(F.col("_d" + n))
        answers = events.withColumns(seen).where((~is_data) | F.col("_us").isNull())
        points = answers.groupBy(*by, "_us").agg(*(fold[n]("_v" + n).alias(n) for n in parts))
    outputs = {}
    for i, (out, (fn, _)) in enumerate(aggs.items()):
        if fn == "avg":
            outputs[out] = F.try_divide(F.col(f"_sum_{i}").cast("double"), F.col(f"_count_{i}"))
        elif fn == "count":
            outputs[out] = F.coalesce(F.col(f"_count_{i}"), F.lit(0)).cast("long")
        else:
            outputs[out] = F.col(f"_{fn}_{i}")
    keys = [*by, "_us"]
    found = points.select(
        *(F.col(k).alias("_f_" + k) for k in keys), *(e.alias("_o_" + o) for o, e in outputs.items())
    )
    joined = rows.join(found, same_keys(rows, found, keys, "_f_"), "left")
    joined = joined.withColumns({o: F.col("_o_" + o) for o in outputs})
    return joined.drop("_us", *("_f_" + k for k in keys), *("_o_" + o for o in outputs))


def neighbour(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    following: bool = False,
    group_rows: int | None = GROUP_ROWS,
    split: Split | None = None,
) -> DataFrame:
    """Add ``value`` of the row just before (or after) in ``order``, else null.

    ``order`` must be ascending and total within a group.
    """
    columns = [n for n, desc in parse_order(order) if not desc]
    if len(columns) != len(order):
        raise ValueError("neighbour needs an ascending order")
    split = split or plan_split(df, by, order, group_rows)
    rows = df.withColumn("_own", F.struct(value.alias("v")))
    nearest = F.min_by if following else F.max_by
    rows = split.carry(
        rows,
        {"edge": nearest("_own", _struct(columns))},
        {"_edge": lambda others, whole: F.last("_p_edge", ignorenulls=True).over(others)},
        following,
    )
    inside = (F.lead if following else F.lag)("_own").over(split.window())
    found = F.coalesce(inside, "_edge")
    return rows.withColumn(name, found["v"]).drop("_own", "_edge", PIECE)


def fill_forward(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    group_rows: int | None = GROUP_ROWS,
    split: Split | None = None,
) -> DataFrame:
    """Replace nulls in ``cols`` by the last value seen in ``order``.

    ``order`` is all ascending or all descending, and total within a group.
    """
    directions = {desc for _, desc in parse_order(order)}
    if len(directions) != 1:
        raise ValueError("fill_forward needs one sort direction")
    names = [n for n, _ in parse_order(order)]
    latest = F.min_by if directions.pop() else F.max_by
    split = split or plan_split(df, by, order, group_rows)
    # A given split may have been planned on the leading columns of the order.
    rows = split.carry(
        df,
        {c: latest(c, F.when(F.col(c).isNotNull(), _struct(names))) for c in cols},
        {
            "_c_" + c: lambda others, whole, c=c: F.last("_p_" + c, ignorenulls=True).over(others)
            for c in cols
        },
    )
    w = Window.partitionBy(*split.keys).orderBy(*order_by(order))
    w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(
        {"_f_" + c: F.coalesce(F.last(c, ignorenulls=True).over(w), "_c_" + c) for c in cols}
    )
    rows = rows.withColumns({c: F.col("_f_" + c) for c in cols})
    return rows.drop(PIECE, *("_f_" + c for c in cols), *("_c_" + c for c in cols))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in ``order``, e.g. ``["updated desc", "id"]``.

    The filter on the rank lets Spark keep one row per key and task before the
    shuffle, so a hot key costs one row per task. ``order`` must be total.
    """
    w = Window.partitionBy(*keys).orderBy(*order_by(order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_with_ties(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in ``order`` and every row that ties with the last.

    The n-th row is found with a top-k sort; a filter then keeps the ties, so
    no single task sees them all.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    names = [name for name, _ in parse_order(order)]
    nth = df.select(*names).orderBy(*order_by(order)).limit(n)
    # With fewer than n rows the edge is the last row, and every row is kept.
    edge = nth.orderBy(*order_by(order, backwards=True)).limit(1).select(F.struct(*names).alias("m"))
    rows = df.withColumn("_edge", edge.scalar())
    return rows.where(~_past(order, F.col("_edge"))).drop("_edge")


def _past(order: Sequence[str], mark: Column) -> Column:
    """True where the row sorts strictly after ``mark``."""
    same = F.lit(True)
    for name, _ in parse_order(order):
        same = same & F.col(name).eqNullSafe(mark[name])
    return at_or_after(order, mark) & ~same
