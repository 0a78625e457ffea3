"""Quality scores: ridge regression on random Fourier features, then isotonic calibration.

Text statistics of a document are standardised and mapped to cosines of random
projections, whose inner products approximate a Gaussian kernel. Each partition
adds up its part of the normal equations; only their sum, whose size depends on
the number of features alone, reaches the driver. Part of the training rows is
kept back to calibrate the raw scores by isotonic regression over bins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .words import chunks, hash_words

STATS = (
    "log_bytes", "log_words", "log_lines", "word_bytes", "word_spread", "long_words",
    "upper", "digits", "blank", "foreign", "stops", "commas", "symbols", "bars", "shouts",
    "other_marks", "distinct_words", "same_as_last", "same_as_second_last", "ends_marked",
    "capital_words", "line_bytes", "distinct_pairs",
)
FEATURES = 256
WIDTH = 0.12
RIDGE = 1e-3
BINS = 512
SEED = 20_240_501


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(chars)] = 1
    return out


_UPPER = _mask(bytes(range(65, 91)))
_CLASSES = [
    _UPPER,
    _mask(bytes(range(48, 58))),
    _mask(b" \t\n\r\x0b\x0c"),
    _mask(bytes(range(128, 256))),
    _mask(b"."),
    _mask(b","),
    _mask(b"#$%&*@^~=+<>{}[]\\_"),
    _mask(b"|"),
    _mask(b"!?"),
    _mask(b"\"'()-/:;`"),
]
_MARKS = _mask(b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~").astype(bool)


def text_stats(texts: list[bytes]) -> np.ndarray:
    """One row of ``STATS`` per text; a text without bytes is all zeros."""
    words, of, starts, lengths, buffer = hash_words(texts)
    out = np.zeros((len(texts), len(STATS)))
    if not len(buffer):
        return out
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    ends = np.minimum(offsets + sizes, len(buffer))

    def per_text(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return run[ends] - run[offsets]

    n = np.bincount(of, minlength=len(texts)).astype(float)
    some, wide = np.maximum(n, 1), np.maximum(sizes, 1).astype(float)

    def per_word(values: np.ndarray, at: np.ndarray = of) -> np.ndarray:
        return np.bincount(at, weights=values, minlength=len(texts))

    mean = per_word(lengths.astype(float)) / some
    spread = np.sqrt(np.maximum(per_word(lengths.astype(float) ** 2) / some - mean**2, 0))
    lines = per_text(buffer == 10) + (sizes > 0)
    last = starts + lengths - 1
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(sizes), np.log1p(n), np.log1p(lines)
    out[:, 3], out[:, 4] = np.log1p(mean), np.log1p(spread)
    out[:, 5] = per_word((lengths > 24).astype(float)) / some
    for i, kind in enumerate(_CLASSES):
        out[:, 6 + i] = np.sqrt(per_text(kind[buffer]) / wide)
    if len(words):
        order = np.lexsort((words, of))
        new = np.ones(len(words))
        new[1:] = (words[order][1:] != words[order][:-1]) | (of[order][1:] != of[order][:-1])
        out[:, 16] = np.bincount(of[order], weights=new, minlength=len(texts)) / some
    for i, back in ((17, 1), (18, 2)):
        same = (words[back:] == words[:-back]) & (of[back:] == of[:-back])
        out[:, i] = per_word(same.astype(float), of[back:]) / some
    out[:, 19] = per_word(_MARKS[buffer[last]].astype(float)) / some
    out[:, 20] = per_word(_UPPER[buffer[starts]].astype(float)) / some
    out[:, 21] = np.log1p(sizes / np.maximum(lines, 1))
    if len(words) > 1:
        inside = of[1:] == of[:-1]
        pairs = (words[:-1] * np.uint64(31) + words[1:])[inside]
        at = of[1:][inside]
        order = np.lexsort((pairs, at))
        new = np.ones(len(pairs))
        new[1:] = (pairs[order][1:] != pairs[order][:-1]) | (at[order][1:] != at[order][:-1])
        out[:, 22] = np.bincount(at[order], weights=new, minlength=len(texts)) / np.maximum(n - 1, 1)
    return out


def document_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``stats``, an array of ``STATS`` of the whole text."""
    schema = docs.select(*keep).schema
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def batches(parts):
        for part in parts:
            texts = part.column("text").cast(pa.binary()).to_pylist()
            for first, held in chunks(texts):
                stats = text_stats(held)
                rows = part.slice(first, len(held)).select(keep)
                values = pa.array(stats.ravel())
                ends = pa.array(np.arange(len(held) + 1, dtype=np.int32) * len(STATS))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.ListArray.from_arrays(ends, values)], [*keep, "stats"]
                )

    return docs.select(*keep, "text").mapInArrow(batches, f"{names}, stats array<double>")


@dataclass
class QualityModel:
    """Everything a score needs; a few hundred kilobytes whatever the corpus."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    ridge: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        cosines = np.sqrt(2 / len(self.phase)) * np.cos(x @ self.weights + self.phase)
        return np.hstack([np.ones((len(x), 1)), x / 10, cosines])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.ridge

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.levels), 0, 1)


def _matrix(column) -> np.ndarray:
    """An Arrow array of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def normal_equations(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """Sums of outer products and of labelled features over ``rows`` (stats, y).

    Every partition sends one row per feature, and Spark adds those of a feature
    up; the driver gets as many rows as there are features.
    """

    def partial(parts):
        total = None
        for part in parts:
            if part.num_rows:
                x = model.fourier(_matrix(part.column("stats")))
                y = part.column("y").to_numpy(zero_copy_only=False)
                here = np.hstack([x.T @ x, (x.T @ y)[:, None]])
                total = here if total is None else total + here
        if total is not None:
            ends = np.arange(len(total) + 1, dtype=np.int32) * total.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(len(total), dtype=np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(total.ravel())),
                ],
                ["i", "sums"],
            )

    def add(group: pa.Table) -> pa.Table:
        total = _matrix(group.column("sums").combine_chunks()).sum(axis=0)
        return pa.table({"i": group.column("i").slice(0, 1), "sums": pa.array([total])})

    kind = "i int, sums array<double>"
    parts = rows.select("stats", "y").mapInArrow(partial, kind)
    found = sorted(parts.groupBy("i").applyInArrow(add, kind).collect())
    sums = np.array([r[1] for r in found])
    return sums[:, :-1], sums[:, -1]


def pool_adjacent(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to ``values`` in squares weighted by ``counts``."""
    blocks: list[list[float]] = []
    for v, c in zip(values, counts, strict=True):
        blocks.append([v * c, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c2, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + c2, blocks[-1][2] + n]
    return np.concatenate([np.full(int(n), s / c) for s, c, n in blocks])


def fit(rows: DataFrame) -> QualityModel:
    """A model from ``rows`` (stats, y, fold): fold 0 fits the ridge, fold 1 calibrates.

    Without rows every score is 0.5; with one label only, that label's.
    """
    d = len(STATS)
    rng = np.random.default_rng(SEED)
    model = QualityModel(
        mean=np.zeros(d),
        scale=np.ones(d),
        weights=rng.normal(0, np.sqrt(2 * WIDTH / d * 2), (d, FEATURES)),
        phase=rng.uniform(0, 2 * np.pi, FEATURES),
        ridge=np.zeros(1 + d + FEATURES),
        edges=np.zeros(1),
        levels=np.full(1, 0.5),
    )
    at = [F.col("stats")[i] for i in range(d)]
    sums = [f(x) for x in at for f in (F.avg, F.stddev_pop)]
    found = rows.agg(F.count("*"), F.avg("y"), *sums).head()
    if not found[0]:
        return model
    model.mean = np.array(found[2::2], dtype=float)
    spread = np.array(found[3::2], dtype=float)
    model.scale = np.where(spread > 1e-9, spread, 1.0)
    folds = {r[0] for r in rows.select("fold").distinct().collect()}  # at most two rows
    fitted = rows.where("fold = 0") if 0 in folds else rows
    kept = rows.where("fold = 1") if 1 in folds else rows
    gram, target = normal_equations(fitted, model)
    model.ridge = np.linalg.solve(gram + RIDGE * gram[0, 0] / 100 * np.eye(len(gram)), target)

    def binned(parts):
        total = np.zeros((BINS, 3))
        for part in parts:
            raw = model.raw(_matrix(part.column("stats"))) if part.num_rows else np.zeros(0)
            y = part.column("y").to_numpy(zero_copy_only=False)
            slot = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
            for i, w in enumerate((None, y, raw)):
                total[:, i] += np.bincount(slot, weights=w, minlength=BINS)
        used = np.flatnonzero(total[:, 0])
        names = ["bin", "n", "y", "raw"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), *[pa.array(total[used, i]) for i in range(3)]], names
        )

    bins = (
        kept.select("stats", "y")
        .mapInArrow(binned, "bin long, n double, y double, raw double")
        .groupBy("bin")
        .agg(F.sum("n"), F.sum("y"), F.sum("raw"))
        .orderBy("bin")
        .collect()  # at most BINS rows
    )
    n, y, raw = (np.array([r[i] for r in bins], dtype=float) for i in (1, 2, 3))
    model.edges, model.levels = raw / n, pool_adjacent(y / n, n)
    return model


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def train(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on the labelled rows that are not held out.

    ``labels.quality`` other than null marks a row; contradicting labels of one id
    count as the higher. Rows of remainder 0 fit the ridge, those of 2 calibrate.
    """
    marks = (
        labels.where("quality is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").cast("double").alias("y"))
    )
    rows = (
        stats.withColumn("part", remainder(F.col("doc_id")))
        .where("part <> 1")
        .join(marks, "doc_id")
        .select("stats", "y", F.when(F.col("part") == 0, 0).otherwise(1).alias("fold"))
    )
    return fit(stored(rows, "quality-rows"))


def scored(stats: DataFrame, keep: list[str], model: QualityModel) -> DataFrame:
    schema = stats.select(*keep).schema
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def batches(parts):
        for part in parts:
            x = _matrix(part.column("stats")) if part.num_rows else np.zeros((0, len(STATS)))
            rows = part.select(keep)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(model.score(x))], [*keep, "score"]
            )

    return stats.select(*keep, "stats").mapInArrow(batches, f"{names}, score double")


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    A null text is empty; empty texts get a score as others do. A null id is never
    held out and never trained on. Repeated rows get equal scores, and a labelled
    id that has several rows trains on each. Columns other than ``doc_id`` and
    ``text`` are not looked at. An empty table gives an empty result; without
    labels every score is 0.5.
    """
    stats = stored(document_stats(docs, ["doc_id"]), "quality-stats")
    result = scored(stats, ["doc_id"], train(stats, labels))
    return result.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score 0.5 or more."""
    model = train(stored(document_stats(docs, ["doc_id"]), "quality-stats"), labels)

    def batches(parts):
        for part in parts:
            raws = part.column(part.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            keep = [
                model.score(text_stats(held)) >= 0.5 for _, held in chunks(raws)
            ]
            yield part.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(batches, docs.schema)
