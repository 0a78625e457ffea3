"""Mixing sources to target weights by exact subset sums over document lengths.

Every source gets a target in words. Whole copies of the source fill most of it.
The rest is a subset-sum problem over the source's lengths: an even share of
every length first, then bounded knapsack dynamic programming over exact lengths
for the words still missing. The result is a number of documents per length; which
documents those are is decided by a seeded hash of their ids.

Only tables of counts are grouped by source: one row per source and length. Rows of
documents are never gathered by source, so a source with a third of all rows is
dealt out over as many tasks as any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, whole_text, word_count

#: Weights of sources in the order of their names, repeated.
WEIGHTS = (5, 2, 1)
#: No source and no document is taken more often than this.
COPIES = 3
SEED = 17
#: Documents of a source and length are cut by hash into so many groups.
GROUPS = 1024


def source_targets(sizes: DataFrame, weights=WEIGHTS, copies: int = COPIES) -> DataFrame:
    """Targets of ``sizes`` (source, source_size): source, source_size, target.

    Sources share the sum of all sizes by weight. A target above ``copies`` times
    its source's size stops there, and the excess goes to the others by weight,
    until none is above. That is one level per unit of weight: it rises in each
    round, and a source once at its limit stays there, so there are few rounds.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    place = (F.row_number().over(order) - 1) % len(weights)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = stored(
        sizes.select(
            "source",
            "source_size",
            (F.col("source_size") * copies).cast("double").alias("most"),
            F.element_at(listed, place.cast("int") + 1).alias("weight"),
        ),
        "sources",
    )
    total, all_weights = ranked.agg(F.sum("source_size"), F.sum("weight")).head()
    level, full = (total / all_weights if all_weights else 0.0), -1
    while True:
        at_most = F.col("weight") * F.lit(level) >= F.col("most")
        count, held, open_weight = ranked.agg(
            F.count(F.when(at_most, 1)),
            F.sum(F.when(at_most, F.col("most")).otherwise(0.0)),
            F.sum(F.when(at_most, 0.0).otherwise(F.col("weight"))),
        ).head()
        if count == full or not open_weight:
            break
        full, level = count, (total - held) / open_weight
    return ranked.select(
        "source",
        "source_size",
        F.least(F.col("weight") * F.lit(float(level)), F.col("most")).alias("target"),
    )


def fill_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that they sum as near to ``budget`` as they can.

    An even share of every length comes first. Then the longest that fit are taken
    or, from the share, given back, until what is missing is about sixteen times
    the greatest length; bounded knapsack over the documents left closes that rest:
    sums within reach are the bits of one number, a length with ``c`` documents
    left adds 1, 2, 4, ... of them at a time. For every sum only the step that first
    reached it is kept, four bytes a sum.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    take = np.zeros(len(lengths), dtype=np.int64)
    whole = int((lengths * counts).sum())
    if budget <= 0 or not whole:
        return take
    if budget >= whole:
        return counts.copy()
    take = np.floor(counts * (budget / whole)).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    reach = 16 * int(lengths.max())
    rest = budget - int((take * lengths).sum())
    for i in order:
        if rest <= reach:
            break
        if lengths[i]:
            more = min(int(counts[i] - take[i]), (rest - reach) // int(lengths[i]) + 1)
            more = max(0, min(more, rest // int(lengths[i])))
            take[i] += more
            rest -= more * int(lengths[i])
    if rest <= 0:
        return take
    # Give some back, so that the programme has room and documents to choose from.
    for i in order[::-1]:
        if rest > reach:
            break
        if lengths[i] and take[i]:
            back = min(int(take[i]), max(1, (reach - rest) // int(lengths[i])))
            take[i] -= back
            rest += back * int(lengths[i])
    mask = (1 << (rest + 1)) - 1
    sums, steps = 1, []
    reached_by = np.zeros(rest + 1, dtype=np.int32)
    for i in np.argsort(lengths, kind="stable"):
        left, power = int(counts[i] - take[i]), 1
        while lengths[i] and left > 0 and not sums >> rest & 1:
            part = min(power, left)
            if part * int(lengths[i]) > rest:
                part = min(part, rest // int(lengths[i]))
                if not part:
                    break
            more = (sums << (part * int(lengths[i])) & mask) & ~sums
            if more:
                reached_by[_places(more)] = len(steps)
                steps.append((int(i), part))
                sums |= more
            left -= part
            power *= 2
        if sums >> rest & 1:
            break
    at = sums.bit_length() - 1
    while at > 0:
        i, part = steps[reached_by[at]]
        take[i] += part
        at -= part * int(lengths[i])
    return take


def _places(bits: int) -> np.ndarray:
    """The places of the ones of a number."""
    low = ((bits & -bits).bit_length() - 1) // 8 * 8
    rest = bits >> low
    raw = np.frombuffer(rest.to_bytes((rest.bit_length() + 7) // 8, "little"), dtype=np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")) + low


def _quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of one source (source, size, n, source_size, target): whole copies and extra."""
    total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    times = min(int(target // total), COPIES) if total else 0
    budget = 0 if times >= COPIES else int(round(target - times * total))
    pdf = pdf.sort_values("size", kind="stable")
    size, n = pdf["size"].to_numpy(), pdf["n"].to_numpy()
    extra = np.zeros(len(pdf), dtype=np.int64)
    # One more copy closes the budget, unless documents are too long for it: then
    # shorter ones are taken again, up to the limit.
    for _ in range(times, COPIES):
        more = fill_budget(size, n, budget)
        if not (more * size).any():
            break
        extra += more
        budget -= int((more * size).sum())
    return pdf[["source", "size"]].assign(times=(times + extra // n).astype("int32"), extra=extra % n)


def mix_sources(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, source, text) as doc_id, source, size, source_size, target, taken.

    ``size`` is the text's number of words, 0 for null; ``taken`` the words the
    mix takes of the document, repeats counted: at most three times its size. A
    source's taken words differ from its target by rounding, or by what no subset
    of its lengths can close. Null is a source, the last. Rows equal in id, source
    and size are alike; the result does not depend on their order. The choice
    depends on ids and seed alone, so runs agree. Documents without words are never
    taken. An empty table gives an empty result. Texts count whole; a source's longest text
    sets the range of the exact sums, 16 times its words, four bytes each, in one task per
    source. Targets are worked out over one row per source in one task.
    """
    number = F.xxhash64(F.lit(seed), "doc_id")
    slim = stored(
        docs.select(
            "doc_id",
            "source",
            F.xxhash64(whole_text()).alias("text_hash"),
            word_count().alias("size"),
            number.alias("number"),
            F.pmod(F.shiftright(number, 20), F.lit(GROUPS)).cast("int").alias("part"),
        ),
        "mix-sizes",
    )
    parts = stored(slim.groupBy("source", "size", "part").agg(F.count("*").alias("n")), "mix-parts")
    lengths = parts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = lengths.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")
    )
    targets = stored(source_targets(sizes), "mix-targets")
    with_target = lengths.join(
        targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))
    ).select("source", "size", "n", "source_size", "target")
    quotas = with_target.groupBy("source").applyInPandas(
        _quotas, "source string, size long, times int, extra long"
    )
    # How many of the extra documents fall to each hash group: filled in order.
    running = (
        Window.partitionBy("source", "size")
        .orderBy("part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("n").over(running), F.lit(0))
    shares = parts.withColumn("before", before)
    q = quotas.select(F.col("source").alias("_s"), F.col("size").alias("_n"), "times", "extra")
    room = F.greatest(F.col("extra") - F.col("before"), F.lit(0))
    filled = (
        shares.join(q, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_n")))
        .select(
            F.col("source").alias("_s"),
            F.col("size").alias("_n"),
            F.col("part").alias("_p"),
            "times",
            F.least(F.col("n"), room).alias("chosen"),
        )
    )
    place = F.row_number().over(
        Window.partitionBy("source", "size", "part").orderBy("number", "doc_id", "text_hash")
    )
    picked = (
        slim.withColumn("place", place)
        .join(
            filled,
            F.col("source").eqNullSafe(F.col("_s"))
            & (F.col("size") == F.col("_n"))
            & (F.col("part") == F.col("_p")),
        )
        .withColumn("copies", F.col("times") + F.when(F.col("place") <= F.col("chosen"), 1).otherwise(0))
        .select("doc_id", "source", "text_hash", "size", "copies")
    )
    listed = targets.withColumnRenamed("source", "_s")
    return picked.join(listed, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        F.col("copies").cast("int").alias("copies"),
        "text_hash",
    )


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns as they are.

    Rows equal in id and text are taken as often as the most taken of them.
    """
    taken = (
        mix_sources(docs, seed)
        .where("copies > 0")
        .groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
        .agg(F.max("copies").alias("_copies"))
    )
    named = docs.withColumn("_hash", F.xxhash64(whole_text()))
    chosen = named.join(
        stored(taken, "mix-taken"),
        F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")),
    )
    return chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
