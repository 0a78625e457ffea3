"""Ancestor pairs of a hierarchy held as parent-child edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.joins import salted_join
from millrace.session import checkpointed
from millrace.skew import GROUP_ROWS, hot_groups

SALTS = 64


def hierarchy_closure(
    edges: DataFrame,
    max_depth: int | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """All ``ancestor, descendant, depth, path, is_cycle`` below ``edges(parent, child)``.

    ``path`` is an array from ancestor to descendant. A step that returns to a
    node already on its path is reported once with ``is_cycle`` and not followed.
    ``max_depth`` limits the depth asked for; None walks to the leaves.

    Paths double: those of exactly ``n`` steps, joined with all of up to ``n`` steps
    that begin where they end, give those of ``n + 1`` to ``2 n``, so a chain of a thousand takes ten
    rounds. Each round is checkpointed in the shared folder, so plans stay short and a
    lost executor costs one round. A node from which very many paths begin is salted.
    """
    links = edges.select("parent", "child").where("parent IS NOT NULL AND child IS NOT NULL")
    links = links.distinct()
    found = checkpointed(
        links.select(
            F.col("parent").alias("ancestor"),
            F.col("child").alias("descendant"),
            F.lit(1).alias("depth"),
            F.array("parent", "child").alias("path"),
            (F.col("parent") == F.col("child")).alias("is_cycle"),
        )
    )
    rounds, steps = [found], 1
    while max_depth is None or steps < max_depth:
        ends = found.where(~F.col("is_cycle") & (F.col("depth") == steps)).select(
            "ancestor", F.col("descendant").alias("_node"), F.col("path").alias("_head")
        )
        if ends.isEmpty():
            break
        known = reduce(DataFrame.unionByName, rounds)
        if max_depth is not None:
            known = known.where(F.col("depth") <= max_depth - steps)
        tails = known.select(
            F.col("ancestor").alias("_node"), "descendant", "depth", F.col("path").alias("_tail")
        )
        hot = hot_groups(tails, ["_node"], group_rows)
        joined = salted_join(tails, ends, ["_node"], SALTS, hot=hot)
        # Nodes between the ends of the tail: a tail that meets the head in one has turned back
        # before its end.
        between = F.slice("_tail", F.lit(2), F.size("_tail") - 2)
        before = F.concat("_head", between)
        found = checkpointed(
            joined.where(~F.arrays_overlap("_head", between)).select(
                "ancestor",
                "descendant",
                (F.col("depth") + steps).alias("depth"),
                F.concat(before, F.array("descendant")).alias("path"),
                F.array_contains(before, F.col("descendant")).alias("is_cycle"),
            )
        )
        rounds.append(found)
        steps *= 2
    return reduce(DataFrame.unionByName, rounds)
