"""Size-aware Jaccard join of documents on word shingles.

Documents with the same set of shingles are one set. Under one order of all
shingles, rare ones first, two sets that are similar enough share some of their
first shingles. Small sets enumerate all subsets of two of these and meet in equal
subsets; large sets scan inverted lists of single shingles. The boundary between
small and large is the one of least counted cost. Every pair that meets is then
compared by its whole sets.

What is asked for is connection, not the list of links, so pairs inside what is
already connected are not compared: a list is first linked to its smallest set,
like a star, and then only sets of different components meet. A group of very many
near copies costs links in proportion to its size.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import marked_rows, stored, whole_text
from .components import components
from .words import chunks, shingle_sets

#: Shingles known to be frequent come last in the order. How many are known decides
#: how fast the join is, never what it finds.
FREQUENT = 200_000
#: Shingles that a task gathers before it counts them.
GATHERED = 2_000_000
#: Of the pairs between two components so many are compared at first, and so many
#: times more in each further round.
ROUND_PAIRS = 4
_EMPTY = 0


def _concat(sets: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)


def frequent_shingles(docs: DataFrame, k: int, most: int = FREQUENT) -> np.ndarray:
    """Shingles that are in the most documents, rarest first; at most ``most``.

    The counts are estimates: a task gathers the sets of its texts, counts those of some
    ``GATHERED`` shingles at a time, forgets what it met only once among them and keeps
    a few times ``most``. What tasks met is added up before any is left out as rare, so
    a shingle that is spread thinly over many tasks is known too. A shingle taken for
    rare by mistake costs work, no result.
    """

    def counted(parts):
        seen, times = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        held, size = [], 0

        def merged():
            s, n = np.unique(np.concatenate([seen, *held]), return_counts=True)
            n[np.searchsorted(s, seen)] += times - 1
            keep = n > 1
            if keep.sum() > 4 * most:
                keep &= n >= np.partition(n, -2 * most)[-2 * most]
            return s[keep], n[keep]

        for part in parts:
            for _, texts in chunks(part.column("text").cast(pa.binary()).to_pylist()):
                held += shingle_sets(texts, k)
                size += sum(len(s) for s in held[-len(texts) :])
                if size > GATHERED:
                    seen, times = merged()
                    held, size = [], 0
        seen, times = merged()
        top = np.argsort(-times, kind="stable")[:most]
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen[top].view(np.int64)), pa.array(times[top])], ["shingle", "n"]
        )

    known = stored(
        docs.select("text")
        .mapInArrow(counted, "shingle long, n long")
        .groupBy("shingle")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") > 7),
        "frequent",
    )
    # The least count that leaves at most ``most``: only those go to the driver.
    band = F.least("n", F.lit(1 << 20)).alias("n")
    least, held = (1 << 20) + 1, 0
    for n, c in sorted(map(tuple, known.groupBy(band).count().collect()), reverse=True):
        held += c
        if held > most:
            break
        least = n
    rows = known.where(F.col("n") >= least).orderBy("n", F.desc("shingle")).collect()
    return np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)


def _set_id(shingles: np.ndarray) -> int:
    if not len(shingles):
        return _EMPTY
    raw = hashlib.blake2b(shingles.tobytes(), digest_size=8).digest()
    return int.from_bytes(raw, "little", signed=True) or 1


def _parities(shingles: np.ndarray) -> np.ndarray:
    """For each cell whether it holds an odd number of shingles; two cells or more a shingle."""
    cells = max(64, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else 64
    at = ((shingles >> np.uint64(7)) & np.uint64(cells - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=cells) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(_concat(arrays).view(np.int64)))


def document_sets(docs: DataFrame, k: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """Per document: doc_id, text_hash, n, set_id, the first shingles of its set, its sketch."""
    by_value = np.argsort(frequent)
    values = frequent[by_value]

    def first(shingles: np.ndarray) -> np.ndarray:
        n = len(shingles)
        want = n - -(-num * n // den) + 2
        if not len(values) or not n:
            return shingles[:want]
        at = np.minimum(np.searchsorted(values, shingles), len(values) - 1)
        known = values[at] == shingles
        rare = shingles[~known][:want]
        if len(rare) >= want:
            return rare
        rest = by_value[at[known]]
        return np.concatenate([rare, frequent[np.sort(rest)[: want - len(rare)]]])

    def batches(parts):
        for part in parts:
            texts = part.column("text").cast(pa.binary()).to_pylist()
            for start, held in chunks(texts):
                sets = shingle_sets(held, k)
                rows = part.slice(start, len(held))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        rows.column("text_hash"),
                        pa.array(np.array([len(s) for s in sets], dtype=np.int64)),
                        pa.array(np.array([_set_id(s) for s in sets], dtype=np.int64)),
                        _lists([first(s) for s in sets]),
                        _lists([_parities(s) for s in sets]),
                    ],
                    ["doc_id", "text_hash", "n", "set_id", "first", "sketch"],
                )

    kind = "doc_id long, text_hash long, n long, set_id long, first array<long>, sketch array<long>"
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        batches, kind
    )


def boundary(sets: DataFrame, num: int, den: int) -> int:
    """The size up to which sets enumerate subsets: the one of least estimated work.

    Subsets cost their number; a scanned list costs its postings times their mean
    number in a list, both counted per class of sizes.
    """
    band = F.ceil(F.log2(F.col("n").cast("double"))).cast("int")
    rows = (
        sets.where("n > 0")
        .select(band.alias("band"), F.explode("first").alias("shingle"), "n")
        .groupBy("band")
        .agg(
            F.count("*").alias("postings"),
            F.approx_count_distinct("shingle").alias("lists"),
            F.avg("n").alias("mean"),
        )
        .orderBy("band")
        .collect()  # one row per power of two
    )
    best, least = 1, None
    for cut in [0, *[r["band"] for r in rows]]:
        cost = 0.0
        for r in rows:
            size = r["mean"]
            heads = size - num * size / den + 2
            if r["band"] <= cut:
                cost += r["postings"] / heads * comb(max(int(heads), 2), 2)
            else:
                cost += r["postings"] * max(1.0, r["postings"] / max(r["lists"], 1))
        if least is None or cost < least:
            best, least = 2**cut, cost
    return best


def _room(num: int, den: int) -> Column:
    """Whether two sets that meet at ``place`` and ``place_2`` can share enough: what they
    may share before, the key, and all of what is left.

    A shingle before the key that both have is in the beginnings of both, so its list
    has both; those whose list has one set only are not shared with any.
    """
    need = F.ceil((F.col("n") + F.col("n_2")) * num / F.lit(num + den).cast("double") - 1e-9)
    rest = F.least(F.col("n") - F.col("place"), F.col("n_2") - F.col("place_2")) - 1
    return F.least("before", "before_2") + 1 + rest >= need


def postings(sets: DataFrame, cut: int, num: int, den: int) -> DataFrame:
    """key, set_id, meta: what sets meet by; ``meta`` holds n, place, short and single.

    ``place`` is a shingle's in the order, of a subset its last one's. ``short`` says
    that the key lies within the beginning by which a set meets larger ones: as the
    larger set's size raises the overlap that is needed, the smaller of two similar
    sets shares a shingle already there, about half as long as by which the larger does.
    """
    some = sets.where("n > 1")
    heads = (F.col("n") - F.ceil(F.col("n") * num / den - 1e-9) + 1).cast("int")
    overlap = F.ceil(F.col("n") * (2 * num) / F.lit(num + den).cast("double") - 1e-9)
    pairs = F.flatten(
        F.transform(
            "first",
            lambda x, i: F.transform(
                F.slice("first", i + 2, F.size("first")),
                lambda y, j: F.struct(F.xxhash64(x, y).alias("key"), (i + j + 1).alias("place")),
            ),
        )
    )
    subsets = (
        some.where(F.col("n") <= cut)
        .select(F.explode(pairs).alias("p"), "set_id", "n", overlap.alias("overlap"))
        .select("p.key", "set_id", "n", "p.place", (F.col("n") - F.col("overlap") + 2).alias("up"))
    )
    singles = some.where(F.col("n") * den >= cut * num).select(
        F.posexplode(F.slice("first", F.lit(1), heads)).alias("place", "key"),
        "set_id",
        "n",
        (F.col("n") - overlap + 1).alias("up"),
    )
    both = subsets.withColumn("single", F.lit(False)).unionByName(
        singles.withColumn("single", F.lit(True)).select("key", "set_id", "n", "place", "up", "single")
    )
    # One number instead of four columns: this is the table that is shuffled whole.
    flags = (F.col("place") < F.col("up")).cast("long") * 2 + F.col("single").cast("long")
    meta = F.shiftleft(F.col("n"), 32) + F.col("place").cast("long") * 4 + flags
    return both.select("key", "set_id", meta.alias("meta"))


def _told(lists: DataFrame) -> DataFrame:
    """``lists`` with n, place, short and single in place of ``meta``."""
    meta = F.col("meta")
    return lists.withColumns(
        {
            "n": F.shiftright(meta, 32),
            "place": F.shiftright(meta.bitwiseAND((1 << 32) - 1), 2),
            "short": meta.bitwiseAND(2) != 0,
            "single": meta.bitwiseAND(1) != 0,
        }
    ).drop("meta")


def _follows(n: str, i: str, m: str, j: str) -> Column:
    """Whether the set ``j`` of ``m`` shingles comes after ``i`` of ``n`` in the order of sizes."""
    return (F.col(n) < F.col(m)) | ((F.col(n) == F.col(m)) & (F.col(i) < F.col(j)))


def _halved(sketch: Column) -> Column:
    """The sketch with half the cells: a cell of the upper half joins its like below."""
    half = (F.size(sketch) / 2).cast("int")
    upper = F.slice(sketch, half + 1, half)
    return F.zip_with(F.slice(sketch, F.lit(1), half), upper, lambda x, y: x.bitwiseXOR(y))


def plausible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, apart) without those whose sketches differ in more cells than similar
    sets can.

    Each cell in which parities differ holds a shingle that only one set has. Sets of
    similar size have as many cells or half as many.
    """
    side = sets.select("set_id", "n", "sketch")
    both = (
        pairs.join(side.toDF("a", "n", "x"), "a")
        .join(side.toDF("b", "m", "y"), "b")
        .where((F.col("n") * den >= F.col("m") * num) & (F.col("m") * den >= F.col("n") * num))
    )
    x = F.when(F.size("x") > F.size("y"), _halved(F.col("x"))).otherwise(F.col("x"))
    y = F.when(F.size("y") > F.size("x"), _halved(F.col("y"))).otherwise(F.col("y"))
    apart = F.aggregate(
        F.zip_with(x, y, lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda t, c: t + c
    )
    most = (F.col("n") + F.col("m")) * (den - num) / F.lit(den + num).cast("double") + 1e-9
    return both.select("a", "b", apart.alias("apart"), most.alias("most")).where("apart <= most")


def whole_sets(pairs: DataFrame, sets: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """set_id and shingles of every set in ``pairs`` (a, b), read again from the texts."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    sources = stored(
        sets.select("set_id", "doc_id", "text_hash")
        .join(wanted, "set_id")
        .select("doc_id", "text_hash")
        .distinct(),
        "sources",
    )

    def batches(parts):
        for part in parts:
            for _, held in chunks(part.column("text").cast(pa.binary()).to_pylist()):
                found = shingle_sets(held, k)
                ids = pa.array(np.array([_set_id(s) for s in found], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([ids, _lists(found)], ["set_id", "shingles"])

    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    match = sources.toDF("_d", "_h")
    texts = (
        marked_rows(hashed, sources, ["doc_id", "text_hash"])
        .join(match, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")))
        .select("text")
    )
    return stored(
        texts.mapInArrow(batches, "set_id long, shingles array<long>").dropDuplicates(["set_id"]),
        "shingles",
    )


def verified(pairs: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ``whole`` sets are similar enough."""
    left = whole.select(F.col("set_id").alias("a"), F.col("shingles").alias("x"))
    right = whole.select(F.col("set_id").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    counted = pairs.select("a", "b").join(left, "a").join(right, "b").select(
        "a", "b", shared.alias("shared"), (F.size("x") + F.size("y") - shared).alias("all")
    )
    return counted.where(F.col("shared") * den >= F.col("all") * num).select("a", "b")


def _marked(rows: DataFrame, ids: list[str], near: DataFrame) -> DataFrame:
    """``rows`` with the component of each of ``ids``, its own id where it has none."""
    for i in ids:
        mark = near.select(F.col("id").alias(i), F.col("component").alias("_c"))
        rows = rows.join(mark, i, "left").withColumn(f"{i}_part", F.coalesce("_c", i)).drop("_c")
    return rows


def connected(pairs: DataFrame, near: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """Components ``near`` (id, component), joined by all links among ``pairs`` (a, b, apart).

    Of the pairs between the same two components the nearest few are compared first.
    Most then lie inside one component and need no comparison; the rest goes on to the
    next round, which takes more.
    """
    count = ROUND_PAIRS
    while True:
        marked = _marked(pairs, ["a", "b"], near).where("a_part <> b_part")
        between = Window.partitionBy(F.least("a_part", "b_part"), F.greatest("a_part", "b_part"))
        place = F.row_number().over(between.orderBy("apart", "a", "b"))
        marked = stored(marked.withColumn("place", place).select("a", "b", "apart", "place"), "open")
        if not marked.head(1):
            return near
        now = marked.where(F.col("place") <= count)
        links = stored(verified(now, whole, num, den), "links-found")
        if links.head(1):
            known = near.select(F.col("id").alias("a"), F.col("component").alias("b"))
            near = stored(components(known.unionByName(links)), "components")
        pairs = marked.where(F.col("place") > count).select("a", "b", "apart")
        count *= 8


def _sized(n: str, m: str, num: int, den: int) -> Column:
    return F.col(n) * den >= F.col(m) * num


def meetings(lists: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that meet in ``lists`` (key, set_id, n,
    place, short, before, last, component) and can share enough.

    ``last`` is the key before this one among a set's own. Where it is the same for both,
    they have met there already, so pairs come once for each run of lists that both
    share, not once a list. The first list that both share is never left out.
    """
    other = lists.select("key", *[F.col(c).alias(f"{c}_2") for c in lists.columns if c != "key"])
    return (
        lists.where("short")
        .join(other, "key")
        .where(_follows("n", "set_id", "n_2", "set_id_2") & _sized("n", "n_2", num, den))
        .where("component <> component_2")
        .where(_room(num, den))
        .where(F.coalesce(F.col("last") != F.col("last_2"), F.lit(True)))
        .select(F.least("set_id", "set_id_2").alias("a"), F.greatest("set_id", "set_id_2").alias("b"))
    )


def _row() -> Column:
    """A row's place among its like: by id, null last, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")


def grouped_rows(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, text_hash, n, set_id, group of every row of ``docs`` (doc_id, text).

    ``group`` is one number for all sets that links connect, null for empty sets.
    """
    texts = docs.select("doc_id", whole_text().alias("text"))
    frequent = frequent_shingles(texts, k)
    rows = stored(document_sets(texts, k, num, den, frequent), "shingle-sets")
    sets = stored(
        rows.where("n > 0")
        .groupBy("set_id")
        .agg(
            F.min(_row()).alias("r"),
            F.min("n").alias("n"),
            F.first("first").alias("first"),
            F.first("sketch").alias("sketch"),
        )
        .select("set_id", "r.doc_id", "r.text_hash", "n", "first", "sketch"),
        "distinct-sets",
    )
    slim = sets.select("set_id", "n", "first")
    posts = postings(slim, boundary(slim, num, den), num, den)
    short = F.when(F.col("meta").bitwiseAND(2) != 0, F.col("meta"))
    heads = stored(
        posts.groupBy("key")
        .agg(
            F.min_by("set_id", short).alias("head"),
            F.shiftright(F.min(short), 32).alias("head_n"),
            F.count("*").alias("c"),
        )
        .where("c > 1")
        .drop("c"),
        "list-heads",
    )
    earlier = Window.partitionBy("set_id", "single").orderBy("place", "key")
    before = F.when(F.col("single"), F.row_number().over(earlier) - 1).otherwise(F.col("place"))
    # Most keys are in one set only: a bitmap keeps most of them from a second shuffle.
    several = marked_rows(posts, heads.select("key"), ["key"]).join(heads, "key")
    lists = stored(
        _told(several).withColumns({"before": before, "last": F.lag("key").over(earlier)}), "lists"
    )
    star = stored(
        lists.where((F.col("head") != F.col("set_id")) & _sized("head_n", "n", num, den))
        .select(F.least("head", "set_id").alias("a"), F.greatest("head", "set_id").alias("b"))
        .distinct(),
        "star-pairs",
    )
    likely = stored(plausible(star, sets, num, den), "plausible")
    links = stored(verified(likely, whole_sets(likely, sets, texts, k), num, den), "star-links")
    near = stored(components(links), "near")

    marked = stored(
        _marked(
            lists.select("key", "set_id", "n", "place", "short", "before", "last"), ["set_id"], near
        ).withColumnRenamed("set_id_part", "component"),
        "marked",
    )
    open_keys = (
        marked.groupBy("key")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo < hi")
        .select("key")
    )
    still = stored(marked.join(open_keys, "key", "left_semi"), "open-lists")
    across = meetings(still, num, den).distinct()
    across = stored(across.join(star, ["a", "b"], "left_anti"), "cross-pairs")
    likely = stored(plausible(across, sets, num, den).select("a", "b", "apart"), "plausible")
    final = connected(likely, near, whole_sets(likely, sets, texts, k), num, den)

    named = sets.select("set_id").join(
        final.select(F.col("id").alias("set_id"), "component"), "set_id", "left"
    )
    named = stored(named.select("set_id", F.coalesce("component", "set_id").alias("group")), "groups")
    return rows.select("doc_id", "text_hash", "n", "set_id").join(named, "set_id", "left")


def similar_components(
    docs: DataFrame, k: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Two documents link when ``den * intersection >= num * union`` of their sets of
    ``k``-word shingles; ``component_id`` is the smallest id reachable by links. Words
    are folded from A-Z to a-z. A text of fewer than ``k`` words is one shingle; null
    and wordless texts have an empty set, link with nothing and keep their own id.
    Rows with a null id take part; where all ids of a component are null, so is the
    component. Rows of equal id and text are alike. Other columns are not looked at.

    Shingles and sets are compared by 64-bit hashes.
    """
    rows = stored(grouped_rows(docs, k, num, den), "grouped")
    least = rows.where("n > 0").groupBy("group").agg(F.min("doc_id").alias("least"))
    return rows.join(stored(least, "least-ids"), "group", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_per_group(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns as they are, one of each group of similar ones.

    The row of the smallest id stays, null ids counting as greatest; of repeated rows
    one. Rows with an empty set of shingles are like no other and all stay.
    """
    rows = stored(grouped_rows(docs, k, num, den), "grouped")
    first = rows.where("n > 0").groupBy("group").agg(F.min(_row()).alias("r")).select("r.*")
    keep = first.join(
        rows.groupBy("doc_id", "text_hash").count(),
        first["doc_id"].eqNullSafe(rows["doc_id"]) & (first["text_hash"] == rows["text_hash"]),
    ).select(first["doc_id"], first["text_hash"], F.col("count") == 1)
    keep = stored(keep.toDF("_d", "_h", "_once"), "kept")
    wordless = rows.where("n = 0").select("doc_id", "text_hash").distinct()
    named = docs.withColumn("_hash", F.xxhash64(whole_text()))
    match = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h"))
    once = named.join(keep.where("_once"), match, "left_semi")
    rest = keep.where("not _once").select(F.col("_d").alias("doc_id"), F.col("_h").alias("_hash"))
    several = marked_rows(named, rest, ["doc_id", "_hash"]).join(
        keep.where("not _once"), match, "left_semi"
    )
    empty = marked_rows(
        named, wordless.withColumnRenamed("text_hash", "_hash"), ["doc_id", "_hash"]
    ).join(wordless.toDF("_d", "_h"), match, "left_semi")
    return (
        once.unionByName(several.dropDuplicates(["doc_id", "_hash"]))
        .unionByName(empty)
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
