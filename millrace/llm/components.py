"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` of every id in ``links`` (a, b): one of the ids, the same for
    all ids that links connect.

    In each round every id joins its smallest neighbour, if that is smaller, and links
    are drawn anew between what ids have joined. With ids in no order along the links,
    such as hashes, a share of them is gone after each round, so rounds grow with the
    logarithm of their number; a star is done after two. Each round is stored. What
    ids joined is stored before links are joined to it, so that Spark can split the
    links of an id that has very many.
    """
    left = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    found = None
    while left.head(1):
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined = stored(
            both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).withColumnRenamed("a", "id"),
            "joined",
        )
        a, b = joined.toDF("a", "x"), joined.toDF("b", "y")
        left = stored(
            left.join(a, "a")
            .join(b, "b")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .where("a <> b")
            .distinct(),
            "links",
        )
        if found is None:
            found = joined.toDF("id", "component")
        else:
            found = found.join(joined.toDF("component", "to"), "component", "left").select(
                "id", F.coalesce("to", "component").alias("component")
            )
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")) if found is None else found
