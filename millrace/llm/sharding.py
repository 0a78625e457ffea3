"""Sharding by fixed virtual slots.

Every record is hashed into one of a fixed number of slots. Bytes and rows are
summed per slot, and a versioned table says which shard holds each slot. Growing
or rebalancing writes its next version; records never change their slot. The table has
one row per slot, so it can be collected and broadcast whatever the data's size.
"""

from __future__ import annotations

import bisect

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import scratch_path
from .common import stored, whole_text

SLOTS = 8192
SHARDS = 16
LAW = "bytes"

_MAP = T.StructType(
    [
        T.StructField("virtual_slot", T.IntegerType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("previous_shard", T.IntegerType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("first", T.LongType()),
        T.StructField("version", T.IntegerType()),
    ]
)


def virtual_slot(slots: int, *columns: Column) -> Column:
    """Slot of a record: a hash of its key and text, so that copies of a text spread."""
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def first_map(slots: int, shards: int) -> dict[int, int]:
    """The map before anything is known of the loads: ranges of slots of equal length."""
    return {slot: slot * shards // slots for slot in range(slots)}


def _level(loads: dict[int, int], shards: int) -> float:
    """Bytes of a shard when slots too big for an even share have one of their own."""
    rest = sum(loads.values())
    for size in sorted(loads.values(), reverse=True):
        if shards == 1 or size * shards <= rest:
            break
        rest -= size
        shards -= 1
    return rest / shards


def rebalance(placed: dict[int, int], loads: dict[int, int], shards: int) -> dict[int, int]:
    """An edited map for ``shards`` shards: moves slots only while that evens out bytes.

    Each move takes the biggest slot that fits from the fullest shard that has one to
    the emptiest. With one shard more, all moves of an even map go into the new shard.
    Slots of shards that are no more, and slots over an even share that are not the first such
    of their shard, are placed before that.
    """
    placed, level = dict(placed), _level(loads, shards)
    totals, whole = [0] * shards, [False] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]

    def put(slot: int, shard: int) -> None:
        size = loads.get(slot, 0)
        placed[slot] = shard
        totals[shard] += size
        whole[shard] |= size > level
        bisect.insort(held[shard], (size, -slot))

    loose = []
    for slot in sorted(placed, key=lambda s: (-loads.get(s, 0), s)):
        shard = placed[slot]
        if shard >= shards or (loads.get(slot, 0) > level and whole[shard]):
            loose.append(slot)
        else:
            put(slot, shard)
    for slot in loose:
        put(slot, min(range(shards), key=lambda s: (whole[s], totals[s], s)))
    for _ in range(len(placed)):
        taker = min(range(shards), key=lambda s: (totals[s], s))
        for giver in sorted(range(shards), key=lambda s: (-totals[s], s)):
            room = min(totals[giver] - level, level - totals[taker])
            at = bisect.bisect_right(held[giver], (room, 1))
            if room > 0 and at and held[giver][at - 1][0] > 0:
                break
        else:
            break
        size, slot = held[giver].pop(at - 1)
        totals[giver] -= size
        put(-slot, taker)
    return placed


def slot_loads(records: DataFrame) -> DataFrame:
    """Bytes and rows of each slot of ``records`` (virtual_slot, size)."""
    return records.groupBy("virtual_slot").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows")
    )


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The slot map stored at ``path``, the newest version or the one named; None if there
    is none yet."""
    try:
        kept = spark.read.schema(_MAP).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if version is None:
        version = kept.agg(F.max("version")).head()[0]
    if version is None:
        return None
    found = kept.where(F.col("version") == version)
    if found.isEmpty():
        raise ValueError(f"slot map: no version {version}")
    return found


def write_map(
    spark: SparkSession,
    path: str,
    version: int,
    placed: dict[int, int],
    loads: dict[int, tuple[int, int]],
    before: dict[int, int],
) -> DataFrame:
    """Store a version of the map and read it back.

    ``bytes`` and ``rows`` are the loads it was made for, ``first`` the place of a slot's
    first record in its shard and ``previous_shard`` where the version before had the
    slot, so that the slots to be copied are those whose two shards differ. Versions are never
    changed; a map is edited by one writer at a time.
    """
    filled: dict[int, int] = {}
    rows = []
    for slot in sorted(placed):
        size, count = loads.get(slot, (0, 0))
        shard = placed[slot]
        rows.append((slot, shard, before.get(slot), size, count, filled.get(shard, 0)))
        filled[shard] = filled.get(shard, 0) + count
    made = spark.createDataFrame(rows, T.StructType(_MAP.fields[:-1]))
    made.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={version}")
    return read_map(spark, path, version)


def edit_map(loads: DataFrame, path: str, shards: int, slots: int = SLOTS) -> DataFrame:
    """Read the newest map at ``path``, rebalance it for ``loads`` (as ``slot_loads`` gives
    them) and ``shards`` shards, and store and return it as the next version.

    Without a map, version 1 is that of no loads. The map and the loads have a row per slot,
    at most 65,536, whatever the data's size.
    """
    spark = loads.sparkSession
    kept = read_map(spark, path)
    if kept is None:
        kept = write_map(spark, path, 1, first_map(slots, shards), {}, {})
    held = kept.select("version", "virtual_slot", "shard").collect()
    if len(held) != slots:
        raise ValueError(f"slot map: it has {len(held)} slots, not {slots}")
    before = {r["virtual_slot"]: r["shard"] for r in held}
    found = {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in loads.collect()}
    placed = rebalance(before, {s: b for s, (b, _) in found.items()}, shards)
    return write_map(spark, path, held[0]["version"] + 1, placed, found, before)


def shard_documents(
    docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None
) -> DataFrame:
    """Each document with its shard and its place in the shard.

    ``docs`` needs ``doc_id`` and ``text``; other columns are left out, whatever
    their names. Size is the text's UTF-8 bytes plus 1, a null text counts as
    none. Shards come out near equal in bytes. ``slot`` is the record's place in
    its shard, gapless from 0; ``virtual_slot`` is the fixed slot of the map and
    ``map_version`` the version of the map that was used.

    The map at ``map_path``, or a new one of even slot ranges, is edited for the bytes found
    and stored as the next version, so that on a later call, with more documents or
    another number of shards, only the slots that even out the bytes change their shard.

    Null ids are hashed by their text alone; rows that are equal in id and text
    share a virtual slot. Of equal rows any may come first, the result is the same.
    An empty table gives an empty result; texts may have
    any length, and a shard with one over an even share has little else.
    """
    if not 0 < shards <= slots <= 65536:
        raise ValueError("shards must be 1 to slots, slots at most 65536")
    spark = docs.sparkSession
    text = F.col("text")
    records = stored(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(whole_text().cast("binary")).alias("text_crc32"),
            virtual_slot(slots, F.col("doc_id"), text).alias("virtual_slot"),
        ),
        "sharded",
    )
    path = map_path or scratch_path(spark, "slot-map")
    slot_map = edit_map(slot_loads(records), path, shards, slots)
    place = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("place", F.row_number().over(place))
        .join(F.broadcast(slot_map), "virtual_slot")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit(LAW).alias("law"),
            "shard",
            (F.col("first") + F.col("place") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            F.col("version").alias("map_version"),
        )
    )
