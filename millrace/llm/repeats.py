"""Repeated passages, by sparse suffix arrays and their common-prefix interval trees.

Every passage of ``length`` bytes holds an anchor: the ``GRAM`` bytes whose hash is
least among all in the passage. Equal passages have equal anchors at equal places,
so only the suffixes that start at anchors are needed, about one in 16, and those of
different anchors never have to meet.

1. Anchors are dealt out by hash; those of one text only are dropped.
2. Kept anchors get their context: the bytes to the left and right that a passage
   around the anchor can reach.
3. The contexts of an anchor are sorted by what follows it, a suffix array. A stack
   scan over the common prefixes of neighbours gives the tree of intervals; within an
   interval the contexts are sorted by what precedes the anchor, and the same scan
   tells where members differ to the left. Each interval of members that can be
   extended neither way as a whole is a maximal repeat, with all its occurrences.

Copies of a text, and of a context, are collapsed before they are dealt out, so an
anchor in a third of all documents reaches its task once from each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import marked_rows, stored, whole_text
from .words import _CODE_EXACT, as_bytes, chunks, mix, powers_up_down

LENGTH = 50
GRAM = 20
#: Bytes of text whose anchors, and bytes of contexts that, go to one task.
TEXT_BYTES = 24_000_000
CHUNK = 500_000
#: Stands for a null id, which counts as greater than any other.
LAST = (1 << 63) - 1

_U = np.uint64
_ANCHOR = np.dtype([("id", "<u4"), ("text", "<i8"), ("ord", "<i8"), ("pos", "<u4")])
_WITNESS = np.dtype([("id", "<u4"), ("text", "<i8")])
_KNOWN = np.dtype(
    [("bucket", "<u4"), ("id", "<u4"), ("text", "<i8"), ("ord", "<i8"), ("pos", "<u4")]
)
_DONE = np.dtype(
    [("ord", "<i8"), ("text", "<i8"), ("start", "<u4"), ("end", "<u4"), ("least", "<i8")]
)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over ``width`` values from each place on."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def find_anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text number, place and 64-bit hash of every anchor."""
    none = np.zeros(0, dtype=np.int64)
    buffer = np.frombuffer(b"\0".join(texts), dtype=np.uint8)
    width = length - gram + 1
    if len(buffer) < length:
        return none, none, none.astype(np.uint64)
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    up, down = powers_up_down(len(buffer) + 1)
    total = np.empty(len(buffer) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_CODE_EXACT[buffer] * up[: len(buffer)], out=total[1:])
    hashes = mix((total[gram:] - total[:-gram]) * down[: len(buffer) - gram + 1])
    order = (hashes >> _U(32)).astype(np.uint32) | np.uint32(1)
    least = _sliding(order, width, np.minimum)  # by start of the passage
    inside = np.zeros(len(least), dtype=bool)
    for o, n in zip(offsets, sizes, strict=True):
        if n >= length:
            inside[o : o + n - length + 1] = True
    least = np.where(inside, least, np.uint32(0))
    pad = np.zeros(width - 1, dtype=np.uint32)
    chosen = _sliding(np.concatenate([pad, least, pad]), width, np.maximum) == order
    at = np.flatnonzero(chosen)
    at = at[_needed(at, hashes[at], length, gram)]
    of = np.searchsorted(offsets, at, side="right") - 1
    return of, at - offsets[of], hashes[at]


def _needed(at: np.ndarray, hashes: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Which anchors are needed: inside long stretches of a short period, where the same
    anchor comes back at equal distances with equal contexts, one for each passage."""
    near = np.zeros(len(at), dtype=bool)
    step = np.diff(at)
    near[1:] = (hashes[1:] == hashes[:-1]) & (step <= gram // 2)
    near[2:] &= ~near[1:-1] | (step[1:] == step[:-1])
    first = np.flatnonzero(~near)
    if len(first) == len(at):
        return np.ones(len(at), dtype=bool)
    run = np.cumsum(~near) - 1
    last = np.append(first[1:], len(at)) - 1
    before, behind = at - at[first[run]], at[last[run]] - at
    cell = before // (length - gram + 1)
    new = np.ones(len(at), dtype=bool)
    new[1:] = cell[1:] != cell[:-1]
    return new | (before < length + gram) | (behind < length + gram)


def _split(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit name of an anchor; two anchors of one name are told apart later."""
    bucket = (mix(hashes) >> _U(16)) % _U(buckets)
    return bucket.astype(np.uint32), hashes.astype(np.uint32)


def _packed(rows: np.ndarray, bucket: np.ndarray, buckets: int) -> list[bytes]:
    """The rows of each bucket as bytes, column after column."""
    order = np.argsort(bucket, kind="stable")
    rows = rows[order]
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        out.append(b"".join(np.ascontiguousarray(rows[f][a:b]).tobytes() for f in rows.dtype.names))
    return out


def _unpacked(parts: list[bytes], kind: np.dtype) -> np.ndarray:
    arrays = []
    for raw in parts:
        n = len(raw) // kind.itemsize
        rows, at = np.empty(n, dtype=kind), 0
        for name in kind.names:
            size = kind[name].itemsize * n
            rows[name] = np.frombuffer(raw[at : at + size], dtype=kind[name])
            at += size
        arrays.append(rows)
    return np.concatenate(arrays) if arrays else np.zeros(0, dtype=kind)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys each place is in; keys are sorted."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new) if n else np.zeros(0, dtype=np.int64)


def _several(run: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each place whether its run holds more than one value."""
    if not len(run):
        return np.zeros(0, dtype=bool)
    first = np.searchsorted(run, run)
    other = (value != value[first]).astype(np.int64)
    return np.bincount(run, weights=other)[run] > 0


def anchors(texts: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """bucket, known, single, witness: the anchors of ``texts`` (ord, key, text), packed.

    ``known`` anchors were met in two texts of one batch and go to any bucket; their
    own bucket gets one witness, by which others of the name learn that they repeat.
    """

    def batches(parts):
        for part in parts:
            ords = part.column("ord").to_pylist()
            raws = [as_bytes(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
            keys = part.column("key").to_pylist()
            least: dict[int, int] = {}
            for i, key in enumerate(keys):
                if ords[i] < ords[least.setdefault(key, i)]:
                    least[key] = i
            kept = sorted(i for i in least.values() if len(raws[i]) >= length)
            found = [
                (np.asarray(kept)[first + of], pos, h)
                for first, held in chunks((raws[i] for i in kept), CHUNK)
                for of, pos, h in [find_anchors(held, length, gram)]
            ]
            if not found:
                continue
            of, pos, h = (np.concatenate(c) for c in zip(*found, strict=True))
            bucket, name = _split(h, buckets)
            o = np.lexsort((name, bucket))
            run = _runs(bucket[o], name[o])
            many = np.zeros(len(of), dtype=bool)
            many[o] = _several(run, of[o])
            ord_of, text_of = np.asarray(ords, dtype=np.int64)[of], np.asarray(keys)[of]
            single = np.rec.fromarrays([name, text_of, ord_of, pos], dtype=_ANCHOR)[~many]
            known = np.rec.fromarrays([bucket, name, text_of, ord_of, pos], dtype=_KNOWN)[many]
            head = o[np.flatnonzero(np.diff(run, prepend=-1))]
            head = head[many[head]]
            witness = np.rec.fromarrays([name[head], text_of[head]], dtype=_WITNESS)
            spread = (mix(ord_of[many].astype(np.uint64)) % _U(buckets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(buckets, dtype=np.int32)),
                    pa.array(_packed(known, spread, buckets), pa.binary()),
                    pa.array(_packed(single, bucket[~many], buckets), pa.binary()),
                    pa.array(_packed(witness, bucket[head], buckets), pa.binary()),
                ],
                ["bucket", "known", "single", "witness"],
            )

    return texts.mapInArrow(batches, "bucket int, known binary, single binary, witness binary")


def shared_anchors(texts: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """ord, key, bucket, id, pos of the anchors that occur in more than one text."""

    def several(group: pa.Table) -> pa.Table:
        known = _unpacked(group.column("known").to_pylist(), _KNOWN)
        single = _unpacked(group.column("single").to_pylist(), _ANCHOR)
        witness = _unpacked(group.column("witness").to_pylist(), _WITNESS)
        own = np.concatenate([np.ones(len(single), bool), np.zeros(len(witness), bool)])
        name = np.concatenate([single["id"], witness["id"]])
        text = np.concatenate([single["text"], witness["text"]])
        # A witness stands for two texts, so its run has several whatever else is in it.
        text_ = np.where(own, text, text ^ np.int64(1))
        order = np.lexsort((own, name))
        run = _runs(name[order])
        more = np.zeros(len(order), dtype=bool)
        more[order] = _several(run, text_[order])
        if len(witness):
            more |= np.isin(name, witness["id"])
        found = single[more[: len(single)]]
        if len(found):  # copies of a text: one of the least id stays
            order = np.lexsort((found["ord"], found["pos"], found["text"], found["id"]))
            found = found[order]
            first = np.diff(_runs(found["id"], found["text"], found["pos"]), prepend=-1) > 0
            found = found[first]
        here = group.column("bucket")[0].as_py()
        return pa.table(
            {
                "ord": np.concatenate([known["ord"], found["ord"]]),
                "key": np.concatenate([known["text"], found["text"]]),
                "bucket": np.concatenate([known["bucket"], np.full(len(found), here)]).astype("i4"),
                "id": np.concatenate([known["id"], found["id"]]).view("i4"),
                "pos": np.concatenate([known["pos"], found["pos"]]).astype("i4"),
            }
        )

    return (
        anchors(texts, buckets, length, gram)
        .groupBy("bucket")
        .applyInArrow(several, "ord long, key long, bucket int, id int, pos int")
    )


def _context_kind(length: int, gram: int) -> np.dtype:
    return np.dtype(
        [("bucket", "<u4"), ("id", "<u4"), ("left", "u1"), ("right", "u1"),
         ("bytes", f"V{2 * length - gram}"), ("ord", "<i8"), ("text", "<i8"), ("pos", "<u4")]
    )


def _merged(done: np.ndarray) -> np.ndarray:
    """Intervals of one text that overlap, as one."""
    if not len(done):
        return done
    done = done[np.lexsort((done["start"], done["text"], done["ord"]))]
    offset = _runs(done["ord"], done["text"]).astype(np.int64) << 33
    ends = np.maximum.accumulate(done["end"] + offset)
    new = np.ones(len(done), dtype=bool)
    new[1:] = done["start"][1:] + offset[1:] > ends[:-1]
    first = np.flatnonzero(new)
    out = done[first].copy()
    last = np.append(first[1:], len(done)) - 1
    out["end"] = ends[last] - offset[last]
    out["least"] = np.minimum.reduceat(done["least"], first)
    return out


def _collapse(rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal contexts those of the least id; what the others repeat of it."""
    if not len(rows):
        return rows, np.zeros(0, dtype=_DONE)
    kind = rows.dtype
    head = rows.view(np.uint8).reshape(len(rows), kind.itemsize)
    size = kind.fields["ord"][1]  # bytes before the id: anchor, extent and context
    keys = np.ascontiguousarray(head[:, :size]).view(f"V{size}").ravel()
    _, same = np.unique(keys, return_inverse=True)
    least = np.full(same.max() + 1, LAST, dtype=np.int64)
    np.minimum.at(least, same, rows["ord"])
    later = rows["ord"] > least[same]
    gone = rows[later]
    done = np.empty(len(gone), dtype=_DONE)
    done["ord"], done["text"], done["least"] = gone["ord"], gone["text"], least[same[later]]
    done["start"], done["end"] = gone["pos"] - gone["left"], gone["pos"] + gone["right"]
    return rows[~later], _merged(done[done["end"] - done["start"] >= length])


def contexts(texts: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """bucket, contexts, done: contexts of the anchors of ``texts`` (ord, key, text, at)."""
    kind = _context_kind(length, gram)
    left, size = length - gram, 2 * length - gram

    def batches(parts):
        for part in parts:
            rows = []
            ords, keys = part.column("ord").to_pylist(), part.column("key").to_pylist()
            raws = part.column("text").cast(pa.binary()).to_pylist()
            lists = part.column("at")
            for i, (o, key, raw) in enumerate(zip(ords, keys, raws, strict=True)):
                at = lists[i].values
                pos = at.field("pos").to_numpy(zero_copy_only=False).astype(np.int64)
                keep = pos + gram <= len(raw)
                pos = pos[keep]
                padded = np.zeros(len(raw) + size + length, dtype=np.uint8)
                padded[left : left + len(raw)] = np.frombuffer(raw, dtype=np.uint8)
                out = np.empty(len(pos), dtype=kind)
                out["bucket"] = at.field("bucket").to_numpy(zero_copy_only=False)[keep]
                out["id"] = at.field("id").to_numpy(zero_copy_only=False)[keep].view("u4")
                out["left"] = np.minimum(pos, left)
                out["right"] = np.minimum(len(raw) - pos, length)
                around = np.lib.stride_tricks.sliding_window_view(padded, size)[pos]
                out["bytes"] = np.ascontiguousarray(around).view(f"V{size}").ravel()
                out["ord"], out["text"], out["pos"] = o, key, pos
                rows.append(out)
            if not rows:
                continue
            kept, done = _collapse(np.concatenate(rows), length)
            name = (kept["bucket"].astype(np.uint64) << _U(32)) | kept["id"]
            to = (mix(name) % _U(buckets)).astype(np.int64)
            spread = (mix(done["ord"].astype(np.uint64)) % _U(buckets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(buckets, dtype=np.int32)),
                    pa.array(_packed(kept, to, buckets), pa.binary()),
                    pa.array(_packed(done, spread, buckets), pa.binary()),
                ],
                ["bucket", "contexts", "done"],
            )

    return texts.mapInArrow(batches, "bucket int, contexts binary, done binary")


def prefix_intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Intervals (value, first, last) of the tree over ``common``, the prefixes that
    neighbours of a sorted list share, from the value ``least`` on: a stack scan."""
    stack: list[list[int]] = []
    for i in range(1, len(common) + 2):
        value = common[i - 1] if i <= len(common) else -1
        first = i - 1
        while stack and stack[-1][0] > value:
            top, first = stack.pop()
            yield top, first, i - 1
        if value >= least and (not stack or stack[-1][0] < value):
            stack.append([value, first])


def _common(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Number of leading equal columns of the rows of ``a`` and ``b``, at most ``limit``."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, limit)


def maximal_repeats(
    right: np.ndarray, left: np.ndarray, n_right: np.ndarray, n_left: np.ndarray, length: int
) -> Iterator[tuple[np.ndarray, int, int]]:
    """Members, extent to the left and to the right of every maximal repeat of ``length``
    or more among the contexts of an anchor.

    ``right`` holds the bytes from the anchor on, rows in sorted order, ``left`` those
    before it, nearest first.
    """
    follow = _common(right[1:], right[:-1], np.minimum(n_right[1:], n_right[:-1]))
    for forward, a, b in prefix_intervals(follow.tolist(), 1):
        members = np.arange(a, b + 1)
        keys = [left[a : b + 1, c] for c in range(left.shape[1] - 1, -1, -1)]
        members = members[np.lexsort([n_left[a : b + 1], *keys])]
        x, n = left[members], n_left[members]
        before = _common(x[1:], x[:-1], np.minimum(n[1:], n[:-1]))
        for back, c, d in prefix_intervals(before.tolist(), max(0, length - forward)):
            yield members[c : d + 1], back, forward


def _occurrences(rows: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Occurrences (ord, start, end, least) of the maximal repeats among contexts."""
    left, size = length - gram, 2 * length - gram
    kept, done = _collapse(rows, length)
    out = [done]
    if len(kept):
        kept = kept[np.lexsort((kept["right"], kept["id"], kept["bucket"]))]
        text = np.ascontiguousarray(kept["bytes"]).view(np.uint8).reshape(len(kept), size)
        after = np.ascontiguousarray(text[:, left:]).view(f"S{length}").ravel()
        order = np.lexsort((after, kept["id"], kept["bucket"]))
        kept, text = kept[order], text[order]
        run = _runs(kept["bucket"], kept["id"])
        right, before = text[:, left:], text[:, :left][:, ::-1]
        same = run[1:] == run[:-1]
        cap = np.minimum(kept["right"][1:], kept["right"][:-1])
        follow = np.where(same, _common(right[1:], right[:-1], cap), 0)
        preceded = np.ascontiguousarray(before).view(f"S{left}").ravel()
        by_left = np.lexsort((kept["left"], preceded, run))
        b, n = before[by_left], kept["left"][by_left]
        back = np.where(same, _common(b[1:], b[:-1], np.minimum(n[1:], n[:-1])), 0)
        # No pair of a run shares more than some pair of neighbours does.
        most = np.zeros(run[-1] + 1, dtype=np.int64)
        more = np.zeros(run[-1] + 1, dtype=np.int64)
        np.maximum.at(most, run[1:], follow)
        np.maximum.at(more, run[1:], back)
        size_of = np.bincount(run)
        starts = np.concatenate([[0], np.cumsum(size_of)])
        worth = (size_of > 1) & (most + more >= length)
        ids = kept["ord"]
        found: list[tuple[np.ndarray, ...]] = []
        two = np.flatnonzero(worth & (size_of == 2))
        if len(two):
            a = starts[two]
            f = follow[a]
            cap = np.minimum(kept["left"][a], kept["left"][a + 1])
            p = _common(before[a], before[a + 1], cap)
            ok = f + p >= length
            for at in (a[ok], a[ok] + 1):
                found.append((at, p[ok], f[ok], np.minimum(ids[a[ok]], ids[a[ok] + 1])))
        for g in np.flatnonzero(worth & (size_of > 2)):
            lo, hi = starts[g], starts[g + 1]
            for members, p, f in maximal_repeats(
                right[lo:hi], before[lo:hi], kept["right"][lo:hi], kept["left"][lo:hi], length
            ):
                at = lo + members
                n = len(at)
                found.append((at, np.full(n, p), np.full(n, f), np.full(n, ids[at].min())))
        if found:
            at, p, f, least = (np.concatenate(c) for c in zip(*found, strict=True))
            rows_ = np.empty(len(at), dtype=_DONE)
            rows_["ord"], rows_["text"], rows_["least"] = ids[at], kept["text"][at], least
            rows_["start"], rows_["end"] = kept["pos"][at] - p, kept["pos"][at] + f
            later = rows_["ord"] > rows_["least"]
            out += [_merged(rows_[later]), rows_[~later]]
    return np.concatenate(out)


def _keyed(docs: DataFrame) -> DataFrame:
    """ord, key and text: the id, a hash of the text, and the text."""
    return docs.select(
        F.coalesce("doc_id", F.lit(LAST)).alias("ord"),
        F.xxhash64(whole_text()).alias("key"),
        whole_text().alias("text"),
    )


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """ord, key, start, end, least: where maximal repeats of ``length`` or more bytes occur.

    ``docs`` needs ``doc_id`` and ``text``. ``ord`` is the id, or ``LAST`` for null,
    ``key`` a hash of the text, ``least`` the least of the repeat's documents. Occurrences that repeat a document
    with a smaller id may be given merged where they overlap. Texts that are equal to
    another of a smaller id are not given: all of them repeats it.
    """
    if not 0 < gram < length <= 255:
        raise ValueError("the anchor must be shorter than the passage, which is at most 255")
    texts = _keyed(docs)
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).head()[0] or 0
    buckets = max(16, -(-total // TEXT_BYTES))
    at = stored(shared_anchors(texts, buckets, length, gram), "shared-anchors")
    same = ["ord", "key"]
    lists = at.groupBy(*same).agg(F.collect_list(F.struct("bucket", "id", "pos")).alias("at"))
    near = marked_rows(texts, at.select(*same).distinct(), same).join(lists, same)

    def repeats(group: pa.Table) -> pa.Table:
        rows = _unpacked(group.column("contexts").to_pylist(), _context_kind(length, gram))
        done = _unpacked(group.column("done").to_pylist(), _DONE)
        found = np.concatenate([done, _occurrences(rows, length, gram)])
        columns = {n: found[n].astype(np.int64) for n in found.dtype.names}
        columns["key"] = columns.pop("text")
        return pa.table(columns).select(["ord", "key", "start", "end", "least"])

    # Contexts overlap: there are more bytes of them than of text.
    packed = contexts(near.select("ord", "key", "text", "at"), 4 * buckets, length, gram)
    kind = "ord long, key long, start long, end long, least long"
    return stored(packed.groupBy("bucket").applyInArrow(repeats, kind), "occurrences")


def _cut(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Spans as maximal runs, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], min(s["end"], size)) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif a < b:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``.

    Removed is each byte covered by ``length`` bytes that also start in a document with a
    smaller id. A null text is empty. A null id counts as greater than any other; rows
    of equal id do not remove from each other, and equal rows give equal results. Texts
    shorter than ``length`` bytes stay whole. Other columns are not looked at. Of a long
    text a task holds about 60 bytes a byte while it looks for anchors; stretches of one sign
    or a short period cost no more than others.
    """
    slim = stored(
        docs.select(
            "doc_id",
            F.coalesce("doc_id", F.lit(LAST)).alias("ord"),
            F.xxhash64(whole_text()).alias("key"),
            F.sha2(whole_text().cast("binary"), 256).alias("sha"),
            F.octet_length(whole_text()).cast("long").alias("n_bytes"),
        ),
        "text-keys",
    )
    first = slim.groupBy("sha").agg(F.min("ord").alias("least"))
    same = ["ord", "key"]
    spans = repeated_passages(docs, length, gram).where("ord > least")
    lists = spans.groupBy(*same).agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def batches(parts):
        for part in parts:
            rows = []
            for o, key, raw, cuts in zip(
                part.column("ord").to_pylist(),
                part.column("key").to_pylist(),
                part.column("text").cast(pa.binary()).to_pylist(),
                part.column("spans").to_pylist(),
                strict=True,
            ):
                runs = _cut(cuts, len(raw))
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((o, key, sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
            names = ["ord", "key", "n_removed", "n_spans", "kept_sha256"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

    kind = "ord long, key long, n_removed long, n_spans long, kept_sha256 string"
    near = marked_rows(_keyed(docs), spans.select(*same).distinct(), same).join(lists, same)
    cut = stored(
        near.select(*same, "text", "spans").mapInArrow(batches, kind).dropDuplicates(same),
        "cut-texts",
    )
    whole = (F.col("ord") > F.col("least")) & (F.col("n_bytes") >= length)
    return (
        slim.join(first, "sha")
        .join(cut, same, "left")
        .select(
            "doc_id",
            "n_bytes",
            F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(whole, hashlib.sha256().hexdigest())
            .otherwise(F.coalesce("kept_sha256", "sha"))
            .alias("kept_sha256"),
        )
    )
