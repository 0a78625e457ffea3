"""Word and shingle hashes of many texts at once, as numpy arrays.

A word is a run of bytes other than the blank and U+0009 to U+000D; ``A`` to ``Z``
count as ``a`` to ``z``. Its hash is a polynomial over the bytes, taken from one
running sum over a whole chunk of texts, so no Python loop visits words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Texts are worked on in chunks of about this many bytes; a longer text is a chunk alone.
CHUNK_BYTES = 500_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += _U(32)
_CODE = mix((_FOLD + _U(1)) * _U(0xD1342543DE82EF95))
_CODE_EXACT = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _U(0xD1342543DE82EF95))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    done = 1
    while done < n:  # doubling: each pass fills as many as are there
        more = min(done, n - done)
        out[done : done + more] = out[:more] * _U(pow(base, done, 1 << 64))
        done += more
    return out


class _Kept(dict):
    """What a task has computed already; travels empty."""

    def __reduce__(self):
        return type(self), ()


_POWERS = _Kept()


def powers_up_down(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; a longer list replaces the one kept."""
    if len(_POWERS.get("up", ())) < n:
        _POWERS["up"], _POWERS["down"] = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
    return _POWERS["up"], _POWERS["down"]


def as_bytes(text) -> bytes:
    if text is None:
        return b""
    return text if isinstance(text, bytes) else text.encode()


def chunks(texts: Iterable, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``limit`` bytes, with the number of the first."""
    first, held, size = 0, [], 0
    for text in texts:
        raw = as_bytes(text)
        if held and size + len(raw) > limit:
            yield first, held
            first, held, size = first + len(held), [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def hash_words(
    texts: list[bytes], cuts: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the text each belongs to, its start and length in the buffer,
    and the buffer, in which texts are joined by a line feed.

    For each number in ``cuts`` the first so many bytes of longer words follow, as
    if they were words too, with other hashes than whole words.
    """
    buffer = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    none = np.zeros(0, dtype=np.int64)
    if not len(buffer):
        return none.astype(np.uint64), none, none, none, buffer
    inside = ~_SPACE[buffer]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = powers_up_down(len(buffer) + 1)
    total = np.empty(len(buffer) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_CODE[buffer] * up[: len(buffer)], out=total[1:])
    tags = (ends - starts).astype(np.uint64)
    for cut in cuts:
        longer = np.flatnonzero(ends[: len(edges) // 2] - starts[: len(edges) // 2] > cut)
        starts = np.concatenate([starts, starts[longer]])
        ends = np.concatenate([ends, starts[longer] + cut])
        tags = np.concatenate([tags, np.full(len(longer), cut + (1 << 40), dtype=np.uint64)])
    hashes = mix((total[ends] - total[starts]) * down[starts] + tags)
    of = np.searchsorted(offsets, starts, side="right") - 1
    return hashes, of, starts, ends - starts, buffer


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles.

    A text of fewer words has the whole sequence as its one shingle; a text
    without words has none.
    """
    words, of, *_ = hash_words(texts)
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    n = max(len(words) - k + 1, 0)
    shingles = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        shingles = mix(shingles * _U(0xA24BAED4963EE407) + words[j : j + n])
    out = []
    for i in range(len(texts)):
        lo, hi = int(bounds[i]), int(bounds[i + 1])
        if hi - lo >= k:
            out.append(np.unique(shingles[lo : hi - k + 1]))
        elif hi > lo:
            h = np.full(1, hi - lo, dtype=np.uint64)
            for w in words[lo:hi]:
                h = mix(h * _U(0xA24BAED4963EE407) + w)
            out.append(h)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
