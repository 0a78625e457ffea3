"""Test items leaked into documents, found within an error budget.

An item that occurs in a text with at most ``e`` edits, cut into ``e + 1`` pieces,
has a piece that occurs unchanged. All pieces of a block of items are looked for in
one pass over a text, and around each hit Myers' bit-parallel algorithm finds the
least edit distance between the whole item and any part of the text.

Items and texts are compared with a blank at either end: an item is looked for as whole
words, and one that begins or ends within a word is an edit away there.

Items travel to the tasks in blocks of bounded size; a large benchmark means more
passes, not larger blocks. Documents are not shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: Edits allowed per sign of an item.
ERROR_RATE = 0.07
#: Bytes of items in one block.
BLOCK_BYTES = 4_000_000

_FOLD = bytes(
    c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def normalised(text: str | bytes | None) -> str:
    """Lower case, and one blank for each run of ASCII signs other than letters and digits."""
    if not text:
        return ""
    if isinstance(text, bytes):
        text = text.decode("utf-8", "replace")
    return b" ".join(text.lower().encode().translate(_FOLD).split()).decode()


def budget(item: str, rate: float) -> int:
    return int(rate * len(item))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length that make up the item, with their places."""
    n = errors + 1
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    """For each sign the places of the item at which it stands, as bits."""
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return dict(out)


def least_distance(places: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of an item of ``m`` signs to any part of ``text``, and where the
    first such part ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, now, best, at = full, 0, m, m, 0
    for j, c in enumerate(text):
        same = places.get(c, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        rise = down | (full & ~(across | up))
        fall = up & across
        if rise & top:
            now += 1
        elif fall & top:
            now -= 1
        rise, fall = (rise << 1) & full, (fall << 1) & full
        up = fall | (full & ~(vertical | rise))
        down = rise & vertical
        if now < best:
            best, at = now, j + 1
    return best, at


class Matcher:
    """A block of items made ready for looking them up in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        by_text: dict[str, list[int]] = defaultdict(list)
        for item_id, text in items:
            if text:
                by_text[text].append(item_id)
        self.items = [
            (ids, f" {text} ", budget(text, rate), masks(f" {text} ")) for text, ids in by_text.items()
        ]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, text, errors, _) in enumerate(self.items):
            for place, piece in pieces(text, errors):
                found[piece].append((i, place))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item_id, distance, end) of each item in the normalised ``text``, at its best place."""
        starts: dict[int, list[int]] = defaultdict(list)
        size_of, text = len(text), f" {text} "
        if self.any and size_of:
            for end, (size, where) in self.automaton.iter(text):
                for i, place in where:
                    starts[i].append(end + 1 - size - place)
        for i, at in starts.items():
            ids, item, errors, places = self.items[i]
            m, best, end = len(item), errors + 1, 0
            at.sort()
            lo = 0
            while lo < len(at) and best:
                hi = lo  # starts near each other are looked at as one stretch of text
                while hi + 1 < len(at) and at[hi + 1] - at[hi] <= 2 * errors:
                    hi += 1
                a = max(0, at[lo] - errors)
                stretch = text[a : at[hi] + m + errors]
                whole = stretch.find(item)
                if whole >= 0:
                    best, end = 0, a + whole + m
                elif errors and len(stretch) >= m - errors:
                    d, e = least_distance(places, m, stretch)
                    if d < best:
                        best, end = d, a + e
                lo = hi + 1
            if best <= errors:
                for item_id in ids:  # the blank before the text and the one behind the item do not count
                    yield item_id, best, min(max(end - 2, 0), size_of)


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items, normalised, in blocks of about ``block_bytes``."""
    items = benchmark.where("text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = -(-total // block_bytes)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    for b in range(n):
        yield [(r[0], normalised(r[1])) for r in items.where(block == b).collect()]


def leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, item_id, distance, ends_at: every item in every document that holds it.

    An item of ``m`` signs (after folding case, punctuation and white space) may
    differ by ``rate * m`` edits, rounded down; ``distance`` is the least, and
    ``ends_at`` the sign of the folded text after its first best match. The blanks around
    words count: an item too short for an edit is only found as whole words, and a longer
    one that stands within words is as many edits away. Items that
    fold to nothing, or are null, match nothing; null and empty texts hold nothing.
    Items with equal text are all reported, and each of repeated rows is. A null id
    is carried along. Other columns are not looked at. Texts count whole; a long one costs
    its task a copy of it, folded, and the places where pieces of items stand in it.
    """
    kind = "doc_id long, item_id long, distance int, ends_at long"
    texts = docs.select("doc_id", whole_text().alias("text"))
    found = docs.sparkSession.createDataFrame([], kind)
    for items in item_blocks(benchmark, block_bytes):
        found = found.unionByName(texts.mapInArrow(_finder(items, rate), kind))
    return found


def _finder(items: list[tuple[int, str]], rate: float):
    def batches(parts):
        matcher = Matcher(items, rate)
        for part in parts:
            rows = [
                (doc, item, distance, end)
                for doc, text in zip(
                    part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True
                )
                for item, distance, end in matcher.matches(normalised(text))
            ]
            columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["doc_id", "item_id", "distance", "ends_at"],
            )

    return batches


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are.

    Null and empty texts hold nothing and stay, as do repeated rows without an item; null ids
    and further columns, whatever their names, are carried along.
    """

    def cleaner(items):
        def batches(parts):
            matcher = Matcher(items, rate)
            for part in parts:
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                clean = [next(matcher.matches(normalised(t)), None) is None for t in texts]
                yield part.filter(pa.array(clean, pa.bool_()))

        return batches

    for items in item_blocks(benchmark, block_bytes):
        docs = docs.mapInArrow(cleaner(items), docs.schema)
    return docs
