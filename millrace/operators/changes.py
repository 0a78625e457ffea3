"""Comparing, merging and versioning table snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.windows import neighbour
from millrace.session import checkpointed
from millrace.skew import GROUP_ROWS, plan_split


def _same(a: Column, b: Column, names: Sequence[str]) -> Column:
    return reduce(and_, (a[n].eqNullSafe(b[n]) for n in names), F.lit(True))


def diff_tables(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that differ: ``change`` (added, removed, changed) and ``changed_columns``.

    Both sides are stacked and grouped by key, so null keys compare equal and a
    repeated key raises instead of multiplying rows.
    """
    keys = list(keys)
    attrs = [c for c in old.columns if c not in keys]
    if set(old.columns) != set(new.columns):
        raise ValueError("the tables must have the same columns")
    image = F.struct(*attrs, F.lit(True).alias("_present"))
    both = old.select(*keys, image.alias("_old")).unionByName(
        new.select(*keys, image.alias("_new")), allowMissingColumns=True
    )
    pairs = both.groupBy(*keys).agg(
        F.first("_old", ignorenulls=True).alias("_old"),
        F.first("_new", ignorenulls=True).alias("_new"),
        F.greatest(F.count("_old"), F.count("_new")).alias("_rows"),
    )
    was, now = F.col("_old"), F.col("_new")
    label = (
        F.when(F.col("_rows") > 1, F.raise_error(F.lit("diff_tables: a key occurs twice")))
        .when(was.isNull(), "added")
        .when(now.isNull(), "removed")
        .when(~_same(was, now, attrs), "changed")
    )
    names = F.array_compact(
        F.array(*(F.when(~was[c].eqNullSafe(now[c]), F.lit(c)) for c in attrs))
    )
    empty = F.array().cast("array<string>")
    return (
        pairs.select(
            *keys,
            label.alias("change"),
            F.when(was.isNotNull() & now.isNotNull(), names).otherwise(empty).alias(
                "changed_columns"
            ),
        )
        .where(F.col("change").isNotNull())
    )


def merge_snapshot(
    target: DataFrame,
    source: DataFrame,
    on: Sequence[str],
    when_matched: str = "update",
    when_missing: str = "keep",
) -> DataFrame:
    """The merged table with one ``action`` per row.

    Actions are ``inserted``, ``updated``, ``unchanged``, ``kept`` and
    ``deleted``; drop the deleted rows to get the new snapshot. ``when_matched``
    is ``update``, ``keep`` or ``delete`` and ``when_missing`` (target rows
    without a source row) ``keep`` or ``delete``. Null keys match nothing, and a
    key repeated in ``source`` raises.

    A small ``source`` is broadcast by Spark and ``target`` is then not shuffled.
    """
    if when_matched not in ("update", "keep", "delete") or when_missing not in ("keep", "delete"):
        raise ValueError("unknown when_matched or when_missing")
    on = list(on)
    attrs = [c for c in target.columns if c not in on]
    image = F.struct(*attrs, F.lit(True).alias("_present"))
    grouped = source.groupBy(*on).agg(
        F.first(image).alias("_new"), F.count(F.lit(1)).alias("_rows")
    )
    # Null keys match nothing, so they may repeat: they go round the grouping.
    has_key = reduce(and_, (F.col(c).isNotNull() for c in on))
    twice = F.raise_error(F.lit("merge_snapshot: a source key occurs twice"))
    # In a filter, so that it is met whatever columns are read.
    once = F.when(F.col("_rows") > 1, twice.cast("boolean")).otherwise(F.lit(True))
    checked = grouped.where(has_key).where(once).select(*on, "_new")
    old = F.struct(*(F.col(c) for c in attrs))
    joined = target.join(checked, on, "left").withColumn("_old", old)
    matched = F.col("_new").isNotNull()
    same = _same(F.col("_old"), F.col("_new"), attrs)
    on_match = {
        "update": F.when(same, "unchanged").otherwise("updated"),
        "keep": F.lit("kept"),
        "delete": F.lit("deleted"),
    }[when_matched]
    action = F.when(matched, on_match).otherwise("kept" if when_missing == "keep" else "deleted")
    joined = joined.withColumn("action", action)
    take = F.col("action") == "updated"
    merged = joined.select(
        *(
            F.col(c) if c in on else F.when(take, F.col("_new")[c]).otherwise(F.col(c)).alias(c)
            for c in target.columns
        ),
        "action",
    )
    # Target keys are first cut down to those in the source.
    held = target.select(*on).join(checked.select(*on), on, "left_semi").distinct()
    fresh = checked.join(held, on, "left_anti").select(*on, "_new.*").select(*target.columns)
    keyless = source.where(~has_key).select(*target.columns)
    inserted = fresh.unionByName(keyless).withColumn("action", F.lit("inserted"))
    return merged.unionByName(inserted)


def scd2_apply(
    history: DataFrame,
    changes: DataFrame,
    key: Sequence[str],
    attrs: Sequence[str],
    ts: str,
    group_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """Apply dated ``changes`` to a history of validity ranges.

    ``history`` has ``key, attrs, valid_from, valid_to, is_current``; ``changes``
    has ``key, attrs, ts``. Ranges are half-open and ``valid_to`` is null for the
    current one. A change that repeats the attributes in force adds nothing, a
    late change splits the range it falls into, and two different versions of
    one key at the same time raise. Keys without changes pass through.

    A range that ends where no other begins is an end: the key was closed. Ends
    stay where they are, so a closed key stays closed and a gap stays a gap,
    unless a change is dated at or after the end; it opens the key again, up to
    its next version. A null ``valid_from`` is a time before all others.

    The history is read twice: once for the rows that pass through, which are not
    shuffled for more than finding the changed keys, and once for the others, of which begins
    and ends are stored before they are cut and sorted.
    """
    key, attrs = list(key), list(attrs)
    columns = [*key, *attrs, "valid_from", "valid_to", "is_current"]
    touched = changes.select(*(F.col(c).alias("_k_" + c) for c in key)).distinct()
    match = reduce(and_, (history[c].eqNullSafe(touched["_k_" + c]) for c in key))
    untouched = history.join(touched, match, "left_anti").select(*columns)
    # A range gives its begin and, if closed, its end, which has no image.
    image, kind = F.struct(*attrs), history.select(F.struct(*attrs).alias("i")).schema["i"].dataType
    begin = F.struct(F.col("valid_from").alias("_at"), image.alias("_image"))
    end = F.struct(
        F.col("valid_to").cast(history.schema["valid_from"].dataType).alias("_at"),
        F.lit(None).cast(kind).alias("_image"),
    )
    marks = F.filter(F.array(begin, end), lambda m: m["_image"].isNotNull() | m["_at"].isNotNull())
    points = (
        history.join(touched, match, "left_semi")
        .select(*key, F.explode(marks).alias("_mark"))
        .select(*key, "_mark._at", "_mark._image")
        .unionByName(changes.select(*key, F.col(ts).alias("_at"), image.alias("_image")))
    )
    # One row per time: the version that begins there or, if none does, an end.
    timed = points.groupBy(*key, "_at").agg(
        F.min("_image").alias("_image"), F.max("_image").alias("_other")
    )
    clash = F.raise_error(F.lit("scd2_apply: two versions of one key at the same time"))
    is_end = F.when(
        F.col("_image").eqNullSafe(F.col("_other")), F.col("_image").isNull()
    ).otherwise(clash.cast("boolean"))
    versions = timed.select(
        *key,
        *(F.col("_image")[c].alias(c) for c in attrs),
        F.col("_at").alias("valid_from"),
        is_end.alias("_end"),
    )
    if group_rows is not None:
        versions = checkpointed(versions)  # read for the cuts and for the result
    order = ["valid_from"]
    split = plan_split(versions, key, order, group_rows)
    seen = neighbour(versions, key, order, F.struct(*attrs, "_end"), "_before", split=split)
    before = F.col("_before")
    repeats = before.isNotNull() & reduce(
        and_, (before[c].eqNullSafe(F.col(c)) for c in [*attrs, "_end"]), F.lit(True)
    )
    kept = seen.where(~repeats).drop("_before")
    closed = neighbour(kept, key, order, F.col("valid_from"), "valid_to", True, split=split)
    closed = closed.where(~F.col("_end"))
    rebuilt = closed.withColumn("is_current", F.col("valid_to").isNull()).select(*columns)
    return untouched.unionByName(rebuilt)
