"""Hierarchical packing of documents into sequences of several lengths.

Documents go to tiers by length: a tier takes what fits its window and not the next
shorter one. Windows are opened for the longest documents first; the gap behind a document
is filled with the longest whole documents of shorter tiers that fit, and the last bit
with the beginning of a document that is cut. So windows are full, whatever their length.

Each task packs what it reads. What does not fill a window there, less than one window in all,
goes on to the next level, where one task packs the rest of many, and so on to one task.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, whole_text

#: Window lengths in tokens, ascending, each twice the one before.
TIERS = (512, 1024, 2048, 4096)
#: Tokens that a task gathers before it packs them.
BATCH_TOKENS = 1 << 20
#: Tokens of a training step; windows of one length are dealt to steps of about this size.
STEP_TOKENS = 1 << 16
#: Tasks whose rest one task packs together: each leaves less than one longest window.
REST_TASKS = 512
#: Words whose ids a task keeps, and the length in bytes up to which a word is kept.
KEPT_WORDS = 500_000
KEPT_BYTES = 64

_ID = 4  # bytes of a token id


class _Kept(dict):
    """What a task has loaded or computed already; travels empty."""

    def __reduce__(self):
        return type(self), ()


_LOADED = _Kept()


class WordIds(dict):
    """The ids of words, four little-endian bytes an id, found when first asked for.

    A word of Latin letters, with or without a mark behind it, is given to the tokenizer's
    model directly, which costs a third: what becomes of each letter before is asked once.
    That is done only if the tokenizer keeps all letters in a row together and
    parts them from the mark.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        normal, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer

        def pieces(text: str) -> list[str]:
            text = normal.normalize_str(text) if normal else text
            return [w for w, _ in cut.pre_tokenize_str(text)] if cut else [text]

        letters = [c for c in map(chr, range(0x250)) if c.isalpha() and len(pieces(c)) == 1]
        self.table = str.maketrans({c: pieces(c)[0] for c in letters})
        self.direct = pieces("".join(letters)) == ["".join(self.table.values())]
        self.latin = re.compile("[" + "".join(letters) + "]+").fullmatch
        self.marks = tuple(
            m.encode() for m in ".,;:!?" if pieces(f"ab{m}") == [*pieces("ab"), *pieces(m)]
        )

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        marked = word.endswith(self.marks)
        latin = self.direct and self.latin(text[:-1] if marked else text)
        if latin and marked:
            found = self[word[:-1]] + self[word[-1:]]
        elif latin:
            ids = [t.id for t in self.tokenizer.model.tokenize(text.translate(self.table))]
            found = struct.pack(f"<{len(ids)}I", *ids)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= KEPT_BYTES:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = found
        return found


def token_bytes(text: bytes, path: str) -> bytes:
    """Token ids of a text, four little-endian bytes an id, without special tokens.

    The tokenizer in the file ``path`` must not join what white space separates, nor give
    white space tokens, so that a text can be told word by word and every word once.
    """
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    ids = _LOADED[path]
    return b"".join([ids[w] for w in text.split()])


class Pool:
    """Pieces waiting to be packed, by length."""

    def __init__(self) -> None:
        self.lengths: list[int] = []
        self.held: dict[int, list] = {}
        self.tokens = 0

    def add(self, piece: tuple) -> None:
        """A piece (document, start, end)."""
        n = piece[2] - piece[1]
        if not self.held.get(n):
            insort(self.lengths, n)
            self.held[n] = []
        self.held[n].append(piece)
        self.tokens += n

    def _take(self, at: int) -> tuple:
        n = self.lengths[at]
        piece = self.held[n].pop()
        if not self.held[n]:
            del self.lengths[at]
        self.tokens -= n
        return piece

    def longest(self) -> tuple:
        return self._take(len(self.lengths) - 1)

    def fill(self, gap: int) -> list[tuple]:
        """Pieces that fill ``gap``: the longest that fit, and a beginning of the next longer one."""
        window = []
        while gap:
            at = bisect_right(self.lengths, gap)
            if at:
                window.append(self._take(at - 1))
                gap -= window[-1][2] - window[-1][1]
            else:
                doc, start, end = self._take(0)
                window.append((doc, start, start + gap))
                self.add((doc, start + gap, end))
                gap = 0
        return window


def windows(pool: Pool, tiers: tuple[int, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """``(tier, pieces)`` of full windows, as many as ``pool`` fills with its longest piece's tier.

    What is left is less than that window.
    """
    while pool.tokens:
        n = pool.lengths[-1]
        tier = next((t for t in tiers if n <= t), tiers[-1])
        if pool.tokens < tier:
            return
        doc, start, end = pool.longest()
        if end - start > tier:
            pool.add((doc, start + tier, end))
            end = start + tier
        yield tier, [(doc, start, end), *pool.fill(tier - (end - start))]


def rest(pool: Pool, tiers: tuple[int, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """Windows for the last of all: by falling tiers while they are full, then one that is not."""
    for tier in reversed(tiers):
        while pool.tokens >= tier:
            yield tier, pool.fill(tier)
    if pool.tokens:
        yield tiers[-1], pool.fill(pool.tokens)


def balanced_steps(costs: list[int], steps: int) -> list[int]:
    """A step for each window: steps hold as many windows, give or take one, and like costs.

    Windows by falling cost are dealt out forth and back.
    """
    out = [0] * len(costs)
    for place, at in enumerate(sorted(range(len(costs)), key=lambda i: -costs[i])):
        turn, step = divmod(place, steps)
        out[at] = steps - 1 - step if turn % 2 else step
    return out


_PIECE = [
    ("doc_id", pa.int64()),
    ("start", pa.int64()),
    ("length", pa.int64()),
    ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()),
    ("offset", pa.int64()),
    ("tier", pa.int32()),
    ("step_id", pa.int64()),
    ("task", pa.int64()),
    ("ids", pa.large_binary()),
]
_KIND = ", ".join(
    f"{n} {({pa.int64(): 'long', pa.int32(): 'int'}).get(t, 'binary')}" for n, t in _PIECE
)
_SCHEMA = pa.schema([pa.field(n, pa.binary() if t == pa.large_binary() else t) for n, t in _PIECE])


class Packer:
    """Packs the documents of one task; a document is (doc_id, start, ids, all its tokens)."""

    def __init__(self, first: int, task: int, tiers: tuple[int, ...]):
        self.tiers, self.task = tiers, task
        self.sequence = self.step = first
        self.pool, self.docs, self.rows = Pool(), {}, []
        self.full: list[tuple[int, list]] = []
        self.number = 0

    def add(self, doc: tuple) -> None:
        """A document to pack; what exceeds the longest window is a window at once."""
        _, _, ids, _ = doc
        self.docs[self.number] = doc
        n = len(ids) // _ID
        longest = self.tiers[-1]
        full = n - n % longest
        self.full += [(longest, [(self.number, a, a + longest)]) for a in range(0, full, longest)]
        if n > full:
            self.pool.add((self.number, full, n))
        self.number += 1

    def _row(self, piece: tuple, sequence, offset, tier, step, keep: bool) -> None:
        doc_id, begin, ids, total = self.docs[piece[0]]
        part = ids[piece[1] * _ID : piece[2] * _ID]
        self.rows.append(
            (
                doc_id, begin + piece[1], piece[2] - piece[1], zlib.crc32(part), total,
                sequence, offset, tier, step, self.task, part if keep else None,
            )
        )

    def pack(self, last: bool = False) -> None:
        """Windows of all that fills some; with ``last`` of all there is."""
        made = [*self.full, *windows(self.pool, self.tiers)]
        self.full = []
        if last:
            made += rest(self.pool, self.tiers)
        for tier in self.tiers:
            some = [pieces for t, pieces in made if t == tier]
            if not some:
                continue
            # Attention costs the square of a piece's length.
            costs = [sum((b - a) ** 2 for _, a, b in pieces) for pieces in some]
            steps = max(1, round(len(some) * tier / STEP_TOKENS))
            for pieces, step in zip(some, balanced_steps(costs, steps), strict=True):
                offset = 0
                for piece in pieces:
                    self._row(piece, self.sequence, offset, tier, self.step + step, False)
                    offset += piece[2] - piece[1]
                self.sequence += 1
            self.step += steps
        waiting = {p[0] for held in self.pool.held.values() for p in held}
        self.docs = {i: d for i, d in self.docs.items() if i in waiting}

    def leave(self) -> None:
        """The pieces that fill no window, as rows that keep their ids."""
        for n in self.pool.lengths:
            for piece in self.pool.held[n]:
                self._row(piece, None, None, None, None, True)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in _SCHEMA]
        self.rows = []
        arrays = [pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)


def _rest_packer(first: int, final: bool, tiers: tuple[int, ...]):
    """A function that packs what a group of tasks left, all of it if it is the ``final`` one."""

    def again(key, table):
        group = key[0].as_py()
        packer = Packer(first + (group << 32), group, tiers)
        table = table.sort_by([(c, "ascending") for c in ("task", "doc_id", "start", "ids_crc32")])
        for r in table.select(["doc_id", "start", "ids", "doc_tokens"]).to_pylist():
            packer.add((r["doc_id"], r["start"], r["ids"], r["doc_tokens"]))
        packer.pack(last=final)
        if not final:
            packer.leave()
        return pa.Table.from_batches([packer.batch()])

    return again


def pack_documents(
    docs: DataFrame, tokenizer: str, end: int, tiers: tuple[int, ...] = TIERS
) -> DataFrame:
    """One row per piece of the token ids of ``docs`` (doc_id, text), ``end`` added to each.

    doc_id, start (ids of its document before the piece), length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset in the sequence, tier
    (the window's length) and step_id. Every sequence but one fills its window; each id
    lies in one piece. Steps hold windows of one length.

    A null text is empty: its one id is ``end``. Rows are documents by themselves, whether
    ids repeat, are null or not. An empty table gives no rows. A long text is split into
    longest windows and a rest; a task holds ``BATCH_TOKENS`` ids and the ids of one text at a time.
    Other columns are not looked at. Sequences depend on how the table is cut into
    tasks, for a given cut they are the same in every run.
    """
    tail = np.array([end], dtype="<u4").tobytes()
    if any(b != 2 * a for a, b in zip(tiers, tiers[1:], strict=False)):
        raise ValueError("each tier must be twice as long as the one before")

    def read(parts):
        packer = None
        for part in parts:
            if not len(part):
                continue
            task = part.column("task")[0].as_py()
            packer = packer or Packer(task << 32, task, tiers)
            texts = part.column("text").cast(pa.large_binary())
            for doc_id, text in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                tokens = token_bytes(text.as_py(), tokenizer) + tail
                packer.add((doc_id, 0, tokens, len(tokens) // _ID))
                if packer.pool.tokens >= BATCH_TOKENS:
                    packer.pack()
                    yield packer.batch()
            packer.pack()
            yield packer.batch()
        if packer:
            packer.leave()
            yield packer.batch()

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        whole_text().alias("text"),
        F.spark_partition_id().cast("long").alias("task"),
    )
    found = stored(rows.mapInArrow(read, _KIND), "packed")
    packed = found.where("sequence_id is not null")
    left, level = found.where("sequence_id is null"), 1
    most = left.agg(F.max("task")).first()[0]
    while most is not None:
        # Levels count sequences from places of their own.
        final = most < REST_TASKS
        group = F.expr(f"task div {REST_TASKS}").alias("group")
        again = _rest_packer(level << 58, final, tiers)
        found = stored(left.groupBy(group).applyInArrow(again, _KIND), "packed")
        packed = packed.unionByName(found.where("sequence_id is not null"))
        if final:
            break
        left, level = found.where("sequence_id is null"), level + 1
        most //= REST_TASKS
    return packed.drop("task", "ids")
