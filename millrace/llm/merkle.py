"""A hash tree over a dataset: leaves, subroots per source, one root, and inclusion proofs.

A level's nodes are numbered; the children of a parent are spread by conditional
aggregates into as many columns as the tree's fanout. Concatenated, the columns give the
parent's hash; without a child's own column they are what it needs from its siblings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

FANOUT = 3


def field(column: str) -> Column:
    """A value as the leaf hashes it: its length in UTF-8 bytes, a colon and itself, or ``-``."""
    value = F.col(column).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(columns: list[str]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` with ``index``, their number from 0 within ``by`` in ``order``; stored.

    Rows are dealt to tasks by ranges of ``by`` and ``order`` and numbered there, so a group
    with very many rows lies in many tasks; one count per task and group moves the numbers
    of later tasks. Only rows equal in all of these columns stay together.
    """
    keys = [by, *order]
    dealt = stored(
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_task", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id()),
        "dealt",
    )
    counts = dealt.groupBy(by, "_task").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")
    moved = counts.select(by, "_task", shift.alias("_shift"))
    return dealt.join(moved, [by, "_task"]).withColumn("index", F.col("_row") + F.col("_shift")).drop(
        "_task", "_row", "_shift"
    )


def parents(nodes: DataFrame, by: str, fanout: int) -> DataFrame:
    """by, index, the children's hashes ``c0``, ``c1``, ... and ``hash`` of the level above
    ``nodes`` (by, index, hash)."""
    slot = F.col("index") % fanout
    spread = [F.max(F.when(slot == i, F.col("hash"))).alias(f"c{i}") for i in range(fanout)]
    pivot = nodes.groupBy(by, F.expr(f"index div {fanout}").alias("index")).agg(*spread)
    columns = [f"c{i}" for i in range(fanout)]
    return pivot.withColumn("hash", F.sha2(F.concat_ws("", *columns), 256))


def _siblings(slot: int, fanout: int) -> Column:
    """What stands before and after the child in ``slot``."""
    before = F.concat_ws("", *[f"c{i}" for i in range(slot)])
    after = F.concat_ws("", *[f"c{i}" for i in range(slot + 1, fanout)])
    return F.struct(before.alias("before"), after.alias("after"))


def _children(pivot: DataFrame, by: str, fanout: int, above: DataFrame) -> DataFrame:
    """The rows of ``above`` (by, index, path, ...), one per row of ``pivot``, for its children:
    the step to each child leads its path."""
    each = F.array(
        *[
            F.when(
                F.col(f"c{i}").isNotNull(),
                F.struct(
                    (F.col("index") * fanout + i).alias("_index"), _siblings(i, fanout).alias("step")
                ),
            )
            for i in range(fanout)
        ]
    )
    carried = [c for c in above.columns if c not in (by, "index", "path")]
    return (
        pivot.join(above, [by, "index"])
        .select(by, "path", *carried, F.explode(F.array_compact(each)).alias("child"))
        .select(
            by,
            F.col("child._index").alias("index"),
            F.concat(F.array("child.step"), "path").alias("path"),
            *carried,
        )
    )


def tree(nodes: DataFrame, by: str, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """``(levels, tops)`` of the trees over ``nodes`` (by, index, hash), one tree per ``by``.

    Every ``fanout`` neighbours become one again and again. ``tops`` has by, hash and level of
    the node that is left at last; a lone node is its own top, at level 0. Each level is
    stored; there are as many as the largest tree has, each with a ``fanout``-th of
    the rows of the one below.
    """
    level = nodes.select(by, "index", "hash")
    levels, first = [], [level.where("index = 0").select(by, "hash", F.lit(0).alias("level"))]
    most = level.agg(F.max("index")).first()[0]
    while most is not None and most > 0:
        # A first parent with one child is not one: its child is the top.
        above = parents(level, by, fanout).where("index > 0 or c1 is not null")
        level = stored(above, "level")
        levels.append(level)
        first.append(level.where("index = 0").select(by, "hash", F.lit(len(levels)).alias("level")))
        most //= fanout
    tops = reduce(DataFrame.unionByName, first).groupBy(by).agg(
        F.max_by("hash", "level").alias("hash"), F.max("level").alias("level")
    )
    return levels, stored(tops, "tops")


def paths(levels: list[DataFrame], tops: DataFrame, by: str, fanout: int = FANOUT) -> DataFrame:
    """by, index, path of every node under ``tops`` (by, level, path, ...), with their other columns.

    A path is an array, from the bottom up, of what stands ``before`` and ``after`` the node's
    ancestor among its siblings, and goes on with the path of its top. It grows from
    parent to child, so no join sees more rows of a tree than its level has.
    """

    def at(level: int) -> DataFrame:
        return tops.where(F.col("level") == level).withColumn("index", F.lit(0).cast("long")).drop("level")

    found = at(len(levels))
    for level in range(len(levels), 0, -1):
        found = _children(levels[level - 1], by, fanout, found).unionByName(at(level - 1))
    return found


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(
        path, leaf, lambda h, step: F.sha2(F.concat(step["before"], h, step["after"]), 256)
    )


def merkle_manifest(
    docs: DataFrame,
    columns: list[str],
    source: str = "source",
    order: str = "doc_id",
    fanout: int = FANOUT,
    also: list[str] | None = None,
) -> DataFrame:
    """doc_id (``order``), leaf, subroot, root, path and the columns ``also`` of every row of ``docs``.

    A row's leaf is the hash of its ``columns``. The leaves of one ``source`` in ``order``, nulls
    first, make a tree whose top is the subroot; the subroots by source, null first, then bytewise,
    make one whose top is the root. ``path`` holds the siblings from the leaf to
    the root, level by level, and :func:`fold` recomputes the root from it.

    Rows with the same source and order follow each other by their leaf, so equal rows have
    paths that differ, in no defined order. Null values and empty texts have leaves of
    their own. An empty table gives no rows. Texts of any length count whole; only their
    hashes are shuffled. Other columns, whatever their names, are not looked at.
    """
    extra = {f"_x{i}": F.col(c) for i, c in enumerate(also or [])}
    name = F.col(source).cast("string")
    group = F.coalesce(F.concat(F.lit("="), name), F.lit(""))
    leaves = docs.select(
        F.col(order).alias("_order"), group.alias("_group"), leaf_hash(columns).alias("hash"),
        *[c.alias(n) for n, c in extra.items()],
    )
    leaves = stored(numbered(leaves, "_group", ["_order", "hash"]), "leaves")
    levels, subroots = tree(leaves, "_group", fanout)
    tops = numbered(subroots.withColumn("_all", F.lit(0)), "_all", ["_group"])
    tops = stored(tops.select("_all", "_group", "index", "hash", "level"), "subroots")
    upper, roots = tree(tops, "_all", fanout)
    none = F.array().cast("array<struct<before: string, after: string>>")
    outside = paths(upper, roots.select("_all", "level", none.alias("path")), "_all", fanout)
    above = tops.join(outside, ["_all", "index"]).select(
        "_group", "level", "path", F.col("hash").alias("subroot")
    )
    inside = paths(levels, stored(above, "upper-paths"), "_group", fanout)
    root = roots.select("hash").first()  # one row, none for an empty table
    return leaves.join(inside, ["_group", "index"]).select(
        F.col("_order").alias(order),
        F.col("hash").alias("leaf"),
        "subroot",
        F.lit(root[0] if root else None).cast("string").alias("root"),
        "path",
        *[F.col(n).alias(c) for n, c in zip(extra, also or [], strict=True)],
    )


#: What a leaf of ``documents`` hashes, in this order.
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def verified_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` and whether each row, some tampered with, still proves in.

    Where the checksum of the id is even, line feeds are taken out of the text before its leaf
    is hashed again. Rows with a null id are not tampered with.
    """
    turned = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = docs.select(*COLUMNS).withColumn("_original", F.col("text"))
    changed = changed.withColumn(
        "text", F.when(turned, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    )
    again = changed.withColumn("leaf_now", leaf_hash(COLUMNS)).withColumn("text", F.col("_original"))
    found = merkle_manifest(again, COLUMNS, also=["leaf_now"])
    proof = F.concat_ws("", F.transform("path", lambda s: F.concat(s["before"], s["after"])))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(proof, 256).alias("proof_sha256"),
        fold(F.col("leaf_now"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
