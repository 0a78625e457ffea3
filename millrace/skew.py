"""Splitting groups that are too big for one task.

A window, an as-of join or a running total sends each group to one task. When a
single key may hold a third of the table that task never ends. The helpers here
find such groups, cut each one into pieces along the window's own order, and
hand every piece what it must know about the pieces before it (its carry).

Every group over ``group_rows`` rows is split, into pieces of about that size.
There are at most as many large groups as the table has ``group_rows`` rows, and
about as many pieces, so what the driver holds is one cut per ``group_rows`` rows
of data, in Arrow. Carries are broadcast up to ``BROADCAST_ROWS`` rows, cuts up to
``BROADCAST_CUTS``, and joined as any other table beyond.

A row finds its piece by descending a tree of cuts with a join on a node's number for each
level, so its cost grows with the logarithm of the number of pieces, and no row is copied
together with all cuts of its group.

Both the large groups and the cuts are found by sampling. Sampling only decides
how the work is divided; every row is used and no result depends on it.

The sampled cuts become literal data before the plan that uses them is built.
A task that is run again therefore puts each row into the same piece.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.internal import InternalFunction

GROUP_ROWS = 10_000_000
BROADCAST_ROWS = 65_536
#: Cuts lie in arrays and take a few tens of bytes each.
BROADCAST_CUTS = 2_097_152
#: Cuts to a node: Spark's search makes an array of objects of each node it looks into.
FAN = 16
SAMPLES_PER_PIECE = 16
SAMPLES_PER_GROUP = 200

PIECE = "_piece"


def parse_order(order: Sequence[str]) -> list[tuple[str, bool]]:
    """``["ts", "value desc"]`` to ``[("ts", False), ("value", True)]``."""
    parsed = []
    for item in order:
        name, _, direction = item.partition(" ")
        if direction.strip().lower() not in ("", "asc", "desc"):
            raise ValueError(f"order entry {item!r}: use 'column' or 'column desc'")
        parsed.append((name, direction.strip().lower() == "desc"))
    if not parsed:
        raise ValueError("order must name at least one column")
    return parsed


def order_by(order: Sequence[str], backwards: bool = False) -> list[Column]:
    """Sort columns: nulls first going up, nulls last going down."""
    return [
        F.col(name).asc_nulls_first() if desc == backwards else F.col(name).desc_nulls_last()
        for name, desc in parse_order(order)
    ]


def _rising(col: Column, desc: bool, kind: T.DataType) -> list[Column] | None:
    """Columns whose ascending order is that of ``col`` in :func:`order_by`, if there are some."""
    if not desc:
        return [col]
    if isinstance(kind, T.IntegralType):
        turned = [F.bitwise_not(col)]
    elif isinstance(kind, T.FractionalType):
        turned = [-col] if isinstance(kind, T.DecimalType) else [~F.isnan(col), -col]
    elif isinstance(kind, T.BooleanType):
        turned = [~col]
    elif isinstance(kind, T.DateType):
        turned = [-F.unix_date(col)]
    elif isinstance(kind, T.TimestampType):
        turned = [-F.unix_micros(col)]
    elif isinstance(kind, T.TimestampNTZType):
        turned = [F.lit("1970-01-01").cast(kind) - col]
    elif kind in (T.StringType(), T.BinaryType()):
        # The last sign is above all digits: what begins like another and goes on comes before it.
        turned = [F.concat(F.translate(F.hex(col), "0123456789ABCDEF", "fedcba9876543210"), F.lit("g"))]
    else:
        return None
    return [col.isNull(), *turned]


def _sort_key(df: DataFrame, order: Sequence[str]) -> Column | None:
    """A struct that sorts ascending as ``order`` does, if its types allow one."""
    found = [_rising(F.col(n), desc, df.schema[n].dataType) for n, desc in parse_order(order)]
    if None in found:
        return None
    return F.struct(*(c.alias(f"_k{i}") for i, c in enumerate(c for part in found for c in part)))


def at_or_after(order: Sequence[str], mark: Column) -> Column:
    """True where the row sorts at or after the struct ``mark``."""
    result = F.lit(True)
    for name, desc in reversed(parse_order(order)):
        value, bound = F.col(name), mark[name]
        if desc:
            beyond = F.coalesce(value < bound, value.isNull() & bound.isNotNull())
        else:
            beyond = F.coalesce(value > bound, bound.isNull() & value.isNotNull())
        result = beyond | (value.eqNullSafe(bound) & result)
    return result


def same_keys(left: DataFrame, right: DataFrame, names: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of ``names`` with the ``prefix``-named copies."""
    terms = [left[n].eqNullSafe(right[prefix + n]) for n in names]
    return reduce(and_, terms) if terms else F.lit(True)


def hot_groups(df: DataFrame, by: Sequence[str], group_rows: int = GROUP_ROWS) -> list:
    """Rows ``(*by, _n)`` for the largest groups over about ``group_rows`` rows.

    Reads only the key columns and counts a sample in which such a group has
    ``SAMPLES_PER_GROUP`` rows, so a table with very many small groups shuffles
    next to nothing. Low thresholds count all rows. ``_n`` is scaled up.
    """
    rate = min(1.0, SAMPLES_PER_GROUP / group_rows)
    sample = df.select(*by) if by else df.select(F.lit(0).alias("_all"))
    sample = sample if rate == 1.0 else sample.sample(rate)
    counts = sample.groupBy(*by).agg(F.count(F.lit(1)).alias("_seen"))
    large = counts.where(F.col("_seen") > group_rows * rate)
    return large.select(*by, (F.col("_seen") / rate).cast("long").alias("_n")).collect()


def _renamed(field: T.StructField, name: str) -> T.StructField:
    return T.StructField(name, field.dataType, True)


def key_table(df: DataFrame, by: Sequence[str], rows: list, prefix: str) -> DataFrame:
    """The keys of ``rows``, one row per large group, numbered by ``{prefix}``."""
    schema = T.StructType(
        [_renamed(df.schema[n], prefix + n) for n in by]
        + [T.StructField(prefix, T.IntegerType(), False)]
    )
    keyed = [(*(r[n] for n in by), i) for i, r in enumerate(rows)]
    return df.sparkSession.createDataFrame(keyed, schema)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its known number of rows allows one."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class Split:
    """How the groups of ``by``, sorted by ``order``, are cut into pieces.

    The cuts of a group lie in a tree, ``FAN`` to a node. ``cuts`` has a row for each group that
    is split: its keys, its number, its first and last piece, and the root of its tree
    (``_tree_heads``). ``levels`` has a table of nodes for each level below, with its number of rows.
    Pieces are numbered over all groups, so that a number tells the group as well.
    """

    fan = FAN

    def __init__(
        self,
        by: Sequence[str],
        order: Sequence[str],
        cuts: DataFrame | None = None,
        levels: Sequence[tuple[DataFrame, int]] = (),
        pieces: int = 0,
        groups: int = 0,
    ):
        self.by = list(by)
        self.order = list(order)
        self.cuts = cuts
        self.levels = levels
        self.pieces = pieces
        self.groups = groups

    @property
    def keys(self) -> list[str]:
        """Partition columns for windows over a tagged table."""
        return self.by if self.cuts is None else [*self.by, PIECE]

    def window(self, backwards: bool = False):
        return Window.partitionBy(*self.keys).orderBy(*order_by(self.order, backwards))

    def tag(self, df: DataFrame, how: str = "left") -> DataFrame:
        """Add the piece number; null marks a group that is not split.

        ``how="inner"`` keeps only the groups that are split. Piece numbers rise along the
        order of a group.
        """
        if self.cuts is None:
            return df
        key = _sort_key(df, self.order)

        def reached(rows: DataFrame, cuts: Column) -> DataFrame:
            """How many of a node's cuts are not above the row, in ``_tree_reached``."""
            if key is None:
                return rows.withColumn("_tree_reached", F.size(F.filter(cuts, lambda c: at_or_after(self.order, c))))
            rows = rows.withColumn("_tree_place", InternalFunction.array_binary_search(cuts, key))
            return rows.withColumn("_tree_reached", F.greatest(F.col("_tree_place") + 1, -F.col("_tree_place") - 1)).drop("_tree_place")

        if self.by:
            match = same_keys(df, self.cuts, self.by, "_cut_")
            rows = reached(df.join(small(self.cuts, self.groups), match, how), F.col("_tree_heads"))
        else:
            # The heads stay in the expression: as a column they would be copied with each row.
            rows = reached(df, self.cuts.select("_tree_heads").scalar())
            rows = rows.withColumns({"_tree_group": F.lit(0), "_tree_before": F.lit(0), "_tree_first": F.lit(0)})
        rows = rows.withColumn("_tree_node", F.when(F.col("_tree_reached") > 0, F.col("_tree_first") + F.col("_tree_reached") - 1))
        for nodes, count in self.levels:
            rows = rows.drop("_tree_reached", "_tree_first", "_tree_heads")
            if count * FAN > BROADCAST_CUTS:
                # Rows that no node belongs to are spread, as a join of large tables shuffles them too.
                rows = rows.withColumn("_tree_node", F.coalesce("_tree_node", -1 - spread(df, 1 << 20)))
            else:
                nodes = F.broadcast(nodes)
            rows = reached(rows.join(nodes, rows["_tree_node"] == nodes["_tree_number"], "left"), F.col("_tree_heads"))
            rows = rows.withColumn("_tree_node", F.col("_tree_first") + F.col("_tree_reached") - 1).drop("_tree_number")
        # The last cut that is not above the row; a row before all cuts has none.
        piece = F.coalesce(F.col("_tree_node") + F.col("_tree_group") + 1, F.col("_tree_before"))
        rows = rows.withColumn(PIECE, piece.cast("int"))
        spent = ["_tree_heads", "_tree_group", "_tree_before", "_tree_last", "_tree_first", "_tree_reached", "_tree_node"]
        return rows.drop(*spent, *("_cut_" + n for n in self.by))

    def carry(
        self,
        df: DataFrame,
        partial: dict[str, Column],
        fold: dict[str, Callable],
        following: bool = False,
    ) -> DataFrame:
        """Tag ``df`` and add, per piece, ``fold`` of the ``partial`` values of other pieces.

        ``fold`` maps an output name to a function of a window over the pieces
        before this one (after it and backwards, when ``following``) and of the whole
        group's window. Outputs are null where a group is not split.
        """
        if self.cuts is None:
            schema = self._fold(df.withColumn(PIECE, F.lit(0)), partial, fold, following).schema
            return df.withColumns({n: F.lit(None).cast(schema[n].dataType) for n in fold})
        folded = self._fold(self.tag(df, "inner"), partial, fold, following)
        return self.attach(self.tag(df), folded)

    def fold(
        self,
        df: DataFrame,
        partial: dict[str, Column],
        before: dict[str, Callable],
        after: dict[str, Callable],
    ) -> DataFrame:
        """The ``before`` and ``after`` of every piece for :meth:`attach`, from the rows ``df``.

        As in :meth:`carry`, but from either side, and also for pieces without a row in ``df``.
        """
        sums = self.tag(df, "inner").groupBy(PIECE).agg(*(c.alias("_p_" + n) for n, c in partial.items()))
        every = self.cuts.select("_tree_group", F.explode(F.sequence("_tree_before", "_tree_last")).alias("_carry_"))
        sums = every.join(sums, every["_carry_"] == sums[PIECE], "left")
        found = [F.col("_carry_")]
        for fold, place in ((before, F.col("_carry_")), (after, F.desc("_carry_"))):
            pieces = Window.partitionBy("_tree_group").orderBy(place)
            others = pieces.rowsBetween(Window.unboundedPreceding, -1)
            whole = pieces.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            found += [make(others, whole).alias(n) for n, make in fold.items()]
        return sums.select(*found)

    def attach(self, tagged: DataFrame, folded: DataFrame) -> DataFrame:
        """Join a tagged table with ``folded``, which has one row for each piece (``_carry_``)."""
        if self.pieces <= BROADCAST_ROWS:
            folded = F.broadcast(folded)
        else:
            # The window that follows finds the rows where this join has put them. Groups that
            # are not split have no piece and get numbers that none has, so as not to meet in one task.
            folded = folded.hint("shuffle_hash")
            if self.by:
                # Texts that a collation takes for equal have hashes of their own.
                plain = [n for n in self.by if "collate" not in tagged.schema[n].dataType.simpleString()]
                lone = F.pmod(F.xxhash64(*plain), F.lit(1 << 30)) if plain else F.lit(0)
                tagged = tagged.withColumn(PIECE, F.coalesce(PIECE, -1 - lone.cast("int")))
        return tagged.join(folded, tagged[PIECE] == folded["_carry_"], "left").drop("_carry_")

    def _fold(self, hot, partial, fold, following):
        sums = hot.groupBy(*self.by, PIECE).agg(*(c.alias("_p_" + n) for n, c in partial.items()))
        # A frame that reaches to the end is computed anew for each row, one that comes from the start is not.
        pieces = Window.partitionBy(*self.by).orderBy(F.desc(PIECE) if following else F.col(PIECE))
        others = pieces.rowsBetween(Window.unboundedPreceding, -1)
        whole = pieces.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return sums.select(
            F.col(PIECE).alias("_carry_"), *(make(others, whole).alias(n) for n, make in fold.items())
        )


def plan_split(
    df: DataFrame, by: Sequence[str], order: Sequence[str], group_rows: int | None = GROUP_ROWS
) -> Split:
    """Decide how to cut the groups of ``by`` that exceed ``group_rows`` rows.

    Runs one job over a sample of the key columns and, only if a group is too
    big, one over a sample of those groups. ``group_rows=None`` skips both, for
    input whose groups are known to be small.
    """
    hot = [] if group_rows is None else hot_groups(df, by, group_rows)
    if not hot:
        return Split(by, order)

    names = [name for name, _ in parse_order(order)]
    slim = df.select(*dict.fromkeys([*by, *names]))
    # Groups are known by number from here on: a key may be NaN, or not hashable.
    if by:
        keys = key_table(slim, by, hot, "_hot_")
        numbered = slim.join(small(keys, len(hot)), same_keys(slim, keys, by, "_hot_"))
    else:
        numbered = slim.withColumn("_hot_", F.lit(0))
    sample = numbered.sample(min(1.0, SAMPLES_PER_PIECE / group_rows))
    w = Window.partitionBy("_hot_").orderBy(*order_by(order))
    picked = sample.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") % SAMPLES_PER_PIECE == 0)
    key = _sort_key(slim, order)
    picked = picked.withColumn("_tree_cut", F.struct(*names) if key is None else key)
    fresh = picked.withColumn("_tree_last", F.lag("_tree_cut").over(w)).where(~F.col("_tree_cut").eqNullSafe(F.col("_tree_last")))
    found = fresh.select("_hot_", "_tree_cut", (F.row_number().over(w) - 1).alias("_rank"))
    kind = found.schema["_tree_cut"].dataType

    table = found.toArrow().sort_by([("_hot_", "ascending"), ("_rank", "ascending")])
    group, rank = (table.column(c).to_numpy().astype(np.int64) for c in ("_hot_", "_rank"))
    cuts = table.column("_tree_cut").combine_chunks()
    starts, stops = (np.searchsorted(group, np.arange(len(hot)), side) for side in ("left", "right"))

    def literal(numbers: dict, offsets: np.ndarray) -> DataFrame:
        heads = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cuts)
        schema = T.StructType([T.StructField(n, T.IntegerType()) for n in numbers])
        columns = {n: pa.array(v, pa.int32()) for n, v in numbers.items()}
        return df.sparkSession.createDataFrame(
            pa.table({**columns, "_tree_heads": heads}), schema.add("_tree_heads", T.ArrayType(kind))
        )

    levels, pieces = [], len(cuts) + len(hot)
    while len(rank) and rank.max() >= FAN:
        first = np.flatnonzero(rank % FAN == 0)
        nodes = literal({"_tree_number": np.arange(len(first)), "_tree_first": first}, np.append(first, len(cuts)))
        levels.insert(0, (nodes, len(first)))
        cuts, group, rank = cuts.take(pa.array(first)), group[first], rank[first] // FAN
    first = np.searchsorted(group, np.arange(len(hot) + 1))
    numbers = np.arange(len(hot))
    ends = {"_tree_before": starts + numbers, "_tree_last": stops + numbers}
    roots = literal({"_tree_group": numbers, **ends, "_tree_first": first[:-1]}, first)
    if by:
        keys = key_table(slim, by, hot, "_cut_")
        roots = keys.join(F.broadcast(roots), keys["_cut_"] == roots["_tree_group"]).drop("_cut_")
    return Split(by, order, roots, levels, pieces, len(hot))


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def spread(df: DataFrame, parts: int) -> Column:
    """A number below ``parts`` that divides any set of rows about evenly.

    Equal rows differ by the task that read them, so a group of copies is
    divided too. A task run again gives each row the same number. Columns that
    cannot be hashed, such as maps, are left out.
    """
    columns = [F.col(f"`{f.name}`") for f in df.schema if _hashable(f.dataType)]
    content = F.pmod(F.xxhash64(*columns) if columns else F.lit(0), F.lit(parts))
    return F.pmod(content + F.spark_partition_id(), F.lit(parts)).cast("int")


class Parts:
    """Into how many pieces the groups of ``by`` over ``group_rows`` rows are cut, in no order."""

    def __init__(self, df: DataFrame, by: Sequence[str], group_rows: int = GROUP_ROWS):
        self.by = list(by)
        hot = hot_groups(df, by, group_rows)
        schema = T.StructType(
            [_renamed(df.schema[n], "_hot_" + n) for n in by]
            + [T.StructField("_parts", T.IntegerType(), False)]
        )
        rows = [(*(r[n] for n in by), -(-r["_n"] // group_rows)) for r in hot]
        self.count = len(rows)
        self.keys = df.sparkSession.createDataFrame(rows, schema) if rows else None

    def _counted(self, df: DataFrame) -> DataFrame:
        match = same_keys(df, self.keys, self.by, "_hot_")
        joined = df.join(small(self.keys, self.count), match, "left")
        return joined.drop(*("_hot_" + n for n in self.by))

    def divide(self, df: DataFrame) -> DataFrame:
        """Add the number of the piece that a row belongs to."""
        if self.keys is None:
            return df.withColumn(PIECE, F.lit(0))
        rows = self._counted(df.withColumn("_spread", spread(df, 1 << 30)))
        piece = F.coalesce(F.col("_spread") % F.col("_parts"), F.lit(0))
        return rows.withColumn(PIECE, piece).drop("_spread", "_parts")

    def copy(self, df: DataFrame, name: str) -> DataFrame:
        """A row of ``df`` for every piece of its group, with the piece's number in ``name``.

        The numbers come from the plan, not from the divided rows, so none is missing
        should these be read twice and differ.
        """
        if self.keys is None:
            return df.withColumn(name, F.lit(0))
        last = F.coalesce(F.col("_parts"), F.lit(1)) - 1
        rows = self._counted(df).withColumn(name, F.explode(F.sequence(F.lit(0), last)))
        return rows.drop("_parts")


def divide(df: DataFrame, by: Sequence[str], group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add a piece number that cuts groups over ``group_rows`` rows, in no order.

    For work that can be done on parts of a group and combined afterwards.
    """
    return Parts(df, by, group_rows).divide(df)
