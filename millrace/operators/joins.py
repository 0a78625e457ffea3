"""Join operators: null-aware, as-of, interval, overlap, top-n, salted, fuzzy."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace import skew
from millrace.operators.windows import fill_forward
from millrace.session import checkpointed
from millrace.skew import (
    GROUP_ROWS,
    hot_groups,
    key_table,
    order_by,
    plan_split,
    same_keys,
    spread,
)


def _distinct_names(left: DataFrame, right: DataFrame, shared: Sequence[str]) -> None:
    clash = set(left.columns) & set(right.columns) - set(shared)
    if clash:
        raise ValueError(f"rename columns present on both sides: {sorted(clash)}")


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch, for either timestamp type."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp"))


def not_in(df: DataFrame, other: DataFrame, key: str, nulls: str = "sql") -> DataFrame:
    """Rows of ``df`` whose ``key`` is not a key of ``other``.

    ``nulls="sql"`` follows ``NOT IN``: a null in ``other`` removes every row,
    and a null key passes only when ``other`` is empty. ``nulls="ignore"`` drops
    nulls from ``other`` and keeps rows with a null key. Neither broadcasts
    ``other`` unless Spark finds it small.
    """
    if nulls not in ("sql", "ignore"):
        raise ValueError("nulls must be 'sql' or 'ignore'")
    keys = other.select(key).where(F.col(key).isNotNull()).distinct()
    kept = df.join(keys, key, "left_anti")
    if nulls == "ignore":
        return kept
    facts = other.agg(
        F.struct(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(key).isNull()).alias("nulls"))
    )
    seen = kept.withColumn("_other", facts.scalar())
    empty = F.col("_other.rows") == 0
    passes = empty | ((F.col("_other.nulls") == 0) & F.col(key).isNotNull())
    return seen.where(passes).drop("_other")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    tolerance: float | None = None,
    direction: str = "backward",
    group_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """Join each left row to the nearest right row at or before its time.

    ``direction="forward"`` takes the nearest at or after it. ``tolerance`` is
    the largest distance in seconds. Among right rows at the same time the one
    with the greatest remaining columns (in column order) wins. Left rows
    without a match keep nulls.

    Both sides are stacked and the last right row is carried forward, so there
    is one shuffle and no pair is formed that is not in the result. Rows with a
    null time or key match nothing: left ones go round that shuffle, for which
    ``left`` is read once more, and right ones are left out.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be 'backward' or 'forward'")
    by = list(by)
    _distinct_names(left, right, by)
    payload = [right_ts, *(c for c in right.columns if c not in by and c != right_ts)]

    def time(ts: str | Column) -> Column:
        # Looking forward is looking backward with the time negated.
        return micros(ts) if direction == "backward" else -micros(ts)

    own = [c for c in left.columns if c not in by]
    lost = reduce(or_, (F.col(c).isNull() for c in by), time(left_ts).isNull())
    keyed = reduce(and_, (F.col(c).isNotNull() for c in by), F.col(right_ts).isNotNull())
    # At equal times every right row sorts before every left row.
    left_rows = left.where(~lost).select(
        *by, time(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*own).alias("_left")
    )
    right_rows = right.where(keyed).select(
        *by, time(right_ts).alias("_t"), F.lit(0).alias("_side"), F.struct(*payload).alias("_right")
    )
    both = left_rows.unionByName(right_rows, allowMissingColumns=True)
    split = plan_split(both, by, ["_t", "_side"], group_rows)
    rows = fill_forward(both, by, ["_t", "_side", "_right"], ["_right"], split=split)
    found = F.col("_right")
    if tolerance is not None:
        distance = F.col("_t") - time(found[right_ts])
        found = F.when(distance <= round(tolerance * 1_000_000), found)
    joined = rows.where(F.col("_side") == 1).withColumn("_right", found).select(
        *(F.col(c) if c in by else F.col("_left")[c].alias(c) for c in left.columns),
        *(F.col("_right")[c].alias(c) for c in payload),
    )
    nothing = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in payload]
    return joined.unionByName(left.where(lost).select(*left.columns, *nothing))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_ts: str,
    right_ts: str,
    lo: float,
    hi: float,
) -> DataFrame:
    """Pairs with ``left_ts + lo <= right_ts <= left_ts + hi`` (seconds).

    Time is cut into bins as wide as the window, so a left row meets at most
    two bins and a hot key is spread over its bins instead of being compared
    with itself.
    """
    if hi < lo:
        raise ValueError("hi must not be below lo")
    by = list(by)
    _distinct_names(left, right, by)
    low, high = round(lo * 1_000_000), round(hi * 1_000_000)
    width = max(high - low, 1_000_000)
    start = micros(left_ts)
    spans = left.withColumn("_t", start).withColumn(
        "_bin",
        F.explode(F.sequence(F.floor((start + low) / width), F.floor((start + high) / width))),
    )
    points = right.withColumn("_u", micros(right_ts)).withColumn(
        "_bin", F.floor(F.col("_u") / width)
    )
    inside = F.col("_u").between(F.col("_t") + low, F.col("_t") + high)
    return spans.join(points, [*by, "_bin"]).where(inside).drop("_bin", "_t", "_u")


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    left_range: tuple[str, str],
    right_range: tuple[str, str],
    bin: float,
    by: Sequence[str] = (),
) -> DataFrame:
    """Pairs of half-open ranges ``[start, end)`` that overlap.

    Two ranges overlap when one starts inside the other, so the pairs are those
    whose right range starts inside the left one plus those whose left range
    starts strictly inside the right one. Each is a point-in-range join on time
    bins. A range uses the narrowest bins (``bin`` seconds, times a power of 8)
    at least as long as itself, so it meets two bins however long it is.
    """
    by = list(by)
    _distinct_names(left, right, by)

    def bounds(df, span, name):
        start, end = micros(span[0]), micros(span[1])
        rows = df.withColumns({f"_{name}s": start, f"_{name}e": end})
        return rows.where(F.col(f"_{name}s") < F.col(f"_{name}e"))

    a, b = bounds(left, left_range, "a"), bounds(right, right_range, "b")
    inner = _points_in_ranges(a, "a", b, "b", by, bin, strict=False)
    outer = _points_in_ranges(b, "b", a, "a", by, bin, strict=True)
    columns = [*left.columns, *(c for c in right.columns if c not in by)]
    return inner.select(*columns).unionAll(outer.select(*columns))


# Bins grow by this factor per level; the top level is wider than 10,000 years.
_BIN_GROWTH = 8
_LONGEST = 10_000 * 366 * 86_400


def _points_in_ranges(ranges, r, points, p, by, bin, strict):
    widths = [round(bin * 1_000_000)]
    while widths[-1] < _LONGEST * 1_000_000:
        widths.append(widths[-1] * _BIN_GROWTH)
    start, end = F.col(f"_{r}s"), F.col(f"_{r}e")
    level = F.lit(len(widths) - 1)
    for i in reversed(range(len(widths) - 1)):
        level = F.when(end - start <= widths[i], F.lit(i)).otherwise(level)
    ranges = ranges.withColumn("_level", level)
    # One short job: points are copied only to the levels that ranges use.
    used = sorted(row[0] for row in ranges.select("_level").distinct().collect())
    width = F.element_at(F.array(*(F.lit(w) for w in widths)), F.col("_level") + 1)
    ranges = ranges.withColumn(
        "_bin", F.explode(F.sequence(F.floor(start / width), F.floor((end - 1) / width)))
    )
    at = F.col(f"_{p}s")
    copies = F.array(
        *(F.struct(F.lit(i).alias("l"), F.floor(at / widths[i]).alias("b")) for i in used or [0])
    )
    points = (
        points.withColumn("_c", F.explode(copies))
        .withColumns({"_level": F.col("_c.l"), "_bin": F.col("_c.b")})
        .drop("_c")
    )
    inside = (at > start if strict else at >= start) & (at < end)
    return ranges.join(points, [*by, "_level", "_bin"]).where(inside)


def top_n_per_row(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    n: int,
    outer: bool = False,
) -> DataFrame:
    """Join each left row to its first ``n`` right rows in ``order``.

    The right side is cut to ``n`` rows per key and task before it is shuffled.
    """
    w = Window.partitionBy(*by).orderBy(*order_by(order))
    best = right.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
    return left.join(best, list(by), "left" if outer else "inner")


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    salts: int,
    how: str = "inner",
    group_rows: int = GROUP_ROWS,
    hot: list | None = None,
) -> DataFrame:
    """Equi-join that divides the hot keys of ``big`` into ``salts`` parts.

    Only rows of ``small`` with a hot key are copied, ``salts`` times each. Null
    keys may be hot too, which matters for ``how="left"``. ``hot`` takes the
    result of :func:`millrace.skew.hot_groups` where it is known already.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("how must be inner, left, left_semi or left_anti")
    on = list(on)
    hot = hot_groups(big, on, group_rows) if hot is None else hot
    if not hot:
        return big.join(small, on, how)
    keys = key_table(big, on, hot, "_hot_").withColumn("_is_hot", F.lit(True))

    def flagged(df: DataFrame) -> DataFrame:
        return df.join(skew.small(keys, len(hot)), same_keys(df, keys, on, "_hot_"), "left")

    dropped = ["_is_hot", "_hot_", *("_hot_" + n for n in on)]
    is_hot = F.col("_is_hot").isNotNull()
    salted = big.withColumn("_part", spread(big, salts))
    salted = flagged(salted).withColumn("_salt", F.when(is_hot, F.col("_part")).otherwise(0))
    copies = F.sequence(F.lit(0), F.when(is_hot, salts - 1).otherwise(0))
    copied = flagged(small).withColumn("_salt", F.explode(copies)).drop(*dropped)
    return salted.drop("_part", *dropped).join(copied, [*on, "_salt"], how).drop("_salt")


# Characters of deletion variants one text may cost; longer texts use parts.
_VARIANT_BUDGET = 50_000


def _variant_length(d: int) -> int:
    """The longest text whose variants with up to ``d`` deletions fit the budget."""
    n = 0
    while (n + 1) * sum(math.comb(n + 1, k) for k in range(d + 1)) <= _VARIANT_BUDGET:
        n += 1
    return n


def _deletions(df: DataFrame, text: str, d: int) -> DataFrame:
    """Explode the hashes of all texts got by deleting up to ``d`` characters."""

    def shorter(v: Column) -> Column:
        cut = F.transform(
            F.sequence(F.lit(1), F.length(v)),
            lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, F.length(v))),
        )
        return F.when(F.length(v) > 0, cut).otherwise(F.array().cast("array<string>"))

    rows = df.withColumn("_v0", F.array(text))
    for k in range(d):
        rows = rows.withColumn(
            f"_v{k + 1}", F.array_distinct(F.flatten(F.transform(f"_v{k}", shorter)))
        )
    levels = [f"_v{k}" for k in range(d + 1)]
    hashes = F.transform(F.concat(*levels), lambda v: F.xxhash64(v))
    return rows.withColumn("_key", F.explode(F.array_distinct(hashes))).drop(*levels)


def _part(i: int, length: Column, d: int) -> tuple[Column, Column]:
    """Start (from 1) and length of part ``i`` when a text is cut into ``d + 1``."""
    start = F.floor(length * i / (d + 1))
    return (start + 1).cast("int"), (F.floor(length * (i + 1) / (d + 1)) - start).cast("int")


def _parts(df: DataFrame, text: str, d: int) -> DataFrame:
    """Explode the parts of a text, tagged with its length and their number."""
    size, parts = F.length(text), []
    for i in range(d + 1):
        start, n = _part(i, size, d)
        parts.append(F.xxhash64(size, F.lit(i), F.substring(text, start, n)))
    return df.withColumn("_key", F.explode(F.array(*parts)))


def _part_probes(df: DataFrame, text: str, d: int) -> DataFrame:
    """Explode the substrings that can equal a part of a text within ``d`` edits."""
    own, probes = F.length(text), []
    for longer in range(-d, d + 1):
        for i in range(d + 1):
            start, n = _part(i, own + longer, d)
            # Some part has at most i edits before it and d - i after it.
            for shift in range(max(-i, i - d - longer), min(i, d - i - longer) + 1):
                at = start + shift
                fits = (own + longer >= 0) & (at >= 1) & (at + n - 1 <= own)
                token = F.xxhash64(own + longer, F.lit(i), F.substring(text, at, n))
                probes.append(F.when(fits, token))
    wanted = F.array_distinct(F.array_compact(F.array(*probes)))
    return df.withColumn("_key", F.explode(wanted))


def fuzzy_join(
    left: DataFrame,
    right: DataFrame,
    block: str,
    left_col: str,
    right_col: str,
    max_dist: int,
) -> DataFrame:
    """Pairs of texts within ``max_dist`` edits that share a ``block`` value.

    Returns one row per pair of distinct texts: ``block``, ``left_text``,
    ``right_text``, ``distance`` and how many rows hold each text. Copies are
    counted before anything is joined.

    A block is never compared with itself. Two exact filters give the candidates,
    by the length of the left text, and the distance decides among them:

    * short texts match where both become equal after up to ``max_dist``
      deletions, so a candidate is at most twice too far apart and a popular
      beginning or ending brings no candidates;
    * long texts, whose variants would cost too much, match on one of
      ``max_dist + 1`` parts that stays unchanged, at the places where it can
      have moved to (Li et al., Pass-Join, 2011).
    """
    d = max_dist

    def texts(df, col, name):
        kept = df.where(F.col(block).isNotNull() & F.col(col).isNotNull())
        return kept.groupBy(block, F.col(col).alias(f"{name}_text")).agg(
            F.count(F.lit(1)).alias(f"{name}_rows")
        )

    # Stored once: the distinct texts are read by both filters and by the result.
    lefts = checkpointed(texts(left, left_col, "left"))
    rights = checkpointed(texts(right, right_col, "right"))
    a, b = lefts.select(block, "left_text"), rights.select(block, "right_text")
    limit = _variant_length(d)
    short = _deletions(a.where(F.length("left_text") <= limit), "left_text", d).join(
        _deletions(b.where(F.length("right_text") <= limit + d), "right_text", d), [block, "_key"]
    )
    long = _parts(a.where(F.length("left_text") > limit), "left_text", d).join(
        _part_probes(b.where(F.length("right_text") > limit - d), "right_text", d),
        [block, "_key"],
    )
    pairs = short.unionByName(long).select(block, "left_text", "right_text").distinct()
    near = pairs.withColumn("distance", F.levenshtein("left_text", "right_text", d))
    near = near.where(F.col("distance") >= 0)
    return (
        near.join(lefts, [block, "left_text"])
        .join(rights, [block, "right_text"])
        .select(block, "left_text", "right_text", "distance", "left_rows", "right_rows")
    )
