"""Periodic runs of words: stretches that repeat a shorter stretch over and over.

A suffix automaton grows word by word. Every state of the path of suffixes of the words so
far carries the place where its strings ended last; a link-cut tree over the suffix links
keeps equal places together as segments of paths. Appending a word recolours its path:
each old segment says where the longest string of the segment ended before. Where that is
no further back than the string is long, string and shift make a square. All squares of
one period that begin at one word are one run, which ends where the last of them does.

Only words that can lie in a run are given to the automaton. In a run every few words
(``window_words``) occur once more in the same text, no further off than a period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .words import chunks, hash_words, mix

#: A run has so many words and periods at least.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: How often stretches are narrowed before they go to the automaton; decides its work only.
_ROUNDS = 8

_U = np.uint64


def window_words(least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> int:
    """So many words in a row occur twice in a text wherever they lie in a run.

    They do if the run is as long as two periods and all but one of them.
    """
    return min(max(least, periods * q) - 2 * q + 1 for q in range(1, least + 1))


def squares(
    words: list, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS
) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of ``words``, by start, then period.

    A run is a stretch with smallest period ``q`` of at least ``least`` words and
    ``periods * q`` (two or more) that cannot be made longer to either side.
    """
    # State 1 is the root; 0 stands for none. One transition lies in two lists, more in a dict.
    length, link = [0, 0], [0, 0]
    only, target, more = [None, None], [0, 0], [None, None]
    left, right, above, place = [0, 0], [0, 0], [0, 0], [-1, -1]

    def state(n: int, to: int) -> int:
        for column, value in (
            (length, n), (link, to), (only, None), (target, 0), (more, None),
            (left, 0), (right, 0), (above, 0), (place, -1),
        ):
            column.append(value)
        return len(length) - 1

    def follow(s: int, word) -> int:
        if more[s] is not None:
            return more[s].get(word, 0)
        return target[s] if only[s] == word and target[s] else 0

    def lead(s: int, word, to: int) -> None:
        if more[s] is not None:
            more[s][word] = to
        elif not target[s] or only[s] == word:
            only[s], target[s] = word, to
        else:
            more[s] = {only[s]: target[s], word: to}

    def up(x: int) -> None:
        """``x`` one step up in the tree of its segment."""
        y = above[x]
        z = above[y]
        if left[y] == x:
            b = right[x]
            left[y], right[x] = b, y
        else:
            b = left[x]
            right[y], left[x] = b, y
        if b:
            above[b] = y
        above[y], above[x] = x, z
        if z:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x

    def expose(x: int) -> None:
        """``x`` to the top of the tree of its segment, which keeps its place there."""
        y = above[x]
        if not y or (left[y] != x and right[y] != x):
            return
        while True:
            z = above[y]
            if not z or (left[z] != y and right[z] != y):
                place[x] = place[y]
                up(x)
                return
            top = z
            up(y if (left[y] == x) == (left[z] == y) else x)
            up(x)
            y = above[x]
            if not y or (left[y] != x and right[y] != x):
                place[x] = place[top]
                return

    found: dict[tuple[int, int], int] = {}
    last = 1
    for i, word in enumerate(words):
        new = state(i + 1, 0)
        s = last
        while s and not (to := follow(s, word)):
            lead(s, word, new)
            s = link[s]
        if not s:
            above[new] = link[new] = 1
        elif length[s] + 1 == length[to]:
            above[new] = link[new] = to
        else:
            copy = state(length[s] + 1, link[to])
            only[copy], target[copy] = only[to], target[to]
            more[copy] = None if more[to] is None else dict(more[to])
            link[to] = link[new] = copy
            # The copy stands just above in the same segment: it was last seen there too.
            expose(to)
            a = left[to]
            left[copy], above[copy], left[to] = a, to, copy
            if a:
                above[a] = copy
            above[new] = copy
            while s and follow(s, word) == to:
                lead(s, word, copy)
                s = link[s]
        # Recolour the path from the root: each segment met tells where it was seen last.
        below, x = 0, new
        while x:
            expose(x)
            seen, size = place[x], length[x]
            if seen >= 0:
                period = i - seen
                if size >= period * (periods - 1) and size + period >= least:
                    found[period, seen - size + 1] = i
            rest = right[x]
            if rest:
                place[rest] = seen
            right[x] = below
            below, x = x, above[x]
        place[below] = i
        expose(new)
        last = new
    return sorted((start, end - start + 1, period) for (period, start), end in found.items())


def _bounds(held: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of windows that are ``held`` and of one text begin and end."""
    on = held[1:] & held[:-1] & (of[1 : len(held)] == of[: len(held) - 1])
    starts = held & ~np.concatenate([[False], on])
    ends = held & ~np.concatenate([on, [False]])
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def stretches(
    texts: list[bytes], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS
) -> Iterator[tuple[int, int, int]]:
    """``(text, first word, end)`` of the parts of ``texts`` outside which no run reaches.

    Every word within the windows of a run is in a window that occurs again no further
    off than a period, so windows without such a twin end a stretch. Numbers of words count
    within the text.
    """
    k = window_words(least, periods)
    words, of, *_ = hash_words(texts)
    n = len(words) - k + 1
    if n < 2:
        return
    windows = of[:n].astype(np.uint64)
    for j in range(k):
        windows = mix(windows * _U(0xA24BAED4963EE407) + words[j : j + n])
    whole = of[:n] == of[k - 1 :]
    at = np.argsort(windows, kind="stable")
    same = np.flatnonzero((windows[at[1:]] == windows[at[:-1]]) & whole[at[1:]] & whole[at[:-1]])
    near = np.full(n, len(words), dtype=np.int64)
    off = at[same + 1] - at[same]
    near[at[same]] = off
    near[at[same + 1]] = np.minimum(near[at[same + 1]], off)
    held = near < len(words)
    first = np.searchsorted(of, np.arange(len(texts)))
    for _ in range(_ROUNDS):
        starts, ends = _bounds(held, of)
        size = ends - starts + k - 1
        limit = np.where(size >= least, size // periods, 0)
        kept = held.copy()
        kept[held] = near[held] <= np.repeat(limit, ends - starts)
        if np.array_equal(kept, held):
            break
        held = kept
    for lo, hi in zip(*[b.tolist() for b in _bounds(held, of)], strict=True):
        if hi - lo + k - 1 >= least:
            text = int(of[lo])
            yield text, lo - int(first[text]), hi - int(first[text]) + k - 1


def runs_of(
    texts: list[bytes], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS
) -> tuple[list[list[bytes]], list[list[tuple[int, int, int]]]]:
    """The words and the runs of each text."""
    words = [t.split() for t in texts]
    found: list[list] = [[] for _ in texts]
    for text, lo, hi in stretches(texts, least, periods):
        part = words[text][lo:hi]
        found[text] += [(lo + s, n, q) for s, n, q in squares(part, least, periods)]
    return words, [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats, joined by a blank."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, n, q in runs:
        drop[start + q] += 1
        drop[start + n] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist())


def periodic_runs(
    docs: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS
) -> DataFrame:
    """doc_id, n_words, runs and collapsed text of every row of ``docs`` (doc_id, text).

    ``runs`` is an array of (start, length, period), by start, then period: the stretches
    of words with a smallest period that are ``least`` words and ``periods`` periods long
    or more and that no neighbouring word extends. ``collapsed`` are the words that no run
    contains after its first period, joined by a blank.

    Words are what lies between blanks and U+0009 to U+000D, compared by their bytes. A
    null text has no words; it and texts without words give no runs and an empty
    text. Repeated rows give repeated results, a null id stays null, other columns are not
    looked at. A text is worked on whole by one task, whose memory grows with its longest
    stretch of repeated words, about 600 bytes a word; other texts cost a few bytes a byte.
    """

    def batches(parts):
        for part in parts:
            for first, held in chunks(part.column("text").cast(pa.large_binary()).to_pylist()):
                words, runs = runs_of(held, least, periods)
                ends = np.zeros(len(runs) + 1, dtype=np.int32)
                np.cumsum([len(r) for r in runs], out=ends[1:])
                flat = np.array([r for rs in runs for r in rs], dtype=np.int64).reshape(-1, 3)
                fields = [pa.array(flat[:, i]) for i in range(3)]
                structs = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
                text = [collapsed(w, r).decode() for w, r in zip(words, runs, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").slice(first, len(held)),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), structs),
                        pa.array(text, pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    kind = "runs array<struct<start: long, length: long, period: long>>"
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(
        batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, {kind}, collapsed string"
    )


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, the text of every tenth id made periodic from a word on.

    With ``h`` the checksum of the id and ``g`` its tenth, ids with ``h % 10 = 0`` are
    taken; from word ``a = g % n`` on the words repeat with period
    ``1 + (n - a) div (3 + g % 8)``. Rows with a null id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.size("_words").cast("long")
    rows = docs.select("doc_id", "text", h.alias("_h"), g.alias("_g")).withColumn(
        "_words",
        F.when(
            F.col("_h") % 10 == 0, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
        ),
    )
    a = F.when(n > 0, F.col("_g") % n)
    rows = rows.withColumns({"_n": n, "_a": a}).withColumn(
        "_p", F.floor((F.col("_n") - F.col("_a")) / (F.col("_g") % 8 + 3)) + 1
    )
    period = F.slice("_words", (F.col("_a") + 1).cast("int"), F.col("_p").cast("int"))
    times = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    tail = F.flatten(F.array_repeat(period, times))
    head = F.slice("_words", F.lit(1), F.col("_a").cast("int"))
    made = F.array_join(F.slice(F.concat(head, tail), F.lit(1), F.col("_n").cast("int")), " ")
    return rows.select("doc_id", F.when(F.col("_n") > 0, made).otherwise(F.col("text")).alias("text"))


def strongest(runs: str = "runs") -> Column:
    """The run with the greatest length in periods, of ties the first, then shortest period."""
    none = F.struct(*[F.lit(None).cast("long").alias(c) for c in ("start", "length", "period")])
    # Runs come by start and period, so only a greater exponent replaces the one held.
    return F.aggregate(
        runs,
        none,
        lambda best, r: F.when(
            best["period"].isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r
        ).otherwise(best),
    )


def run_digest(docs: DataFrame) -> DataFrame:
    """The strongest run of each text and digests of all its runs and of what is left."""
    found = periodic_runs(docs).withColumn("best", strongest())
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
