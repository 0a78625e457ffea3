"""Toxicity by classifier chains.

Categories are predicted one after another; each linear model sees the words of a
text and the probabilities of the categories before it. For training these
probabilities come from models that have not seen the row (out of fold), so later
models learn from what they will meet. The last category is toxicity itself.

``labels.toxic`` says whether a text is toxic. What kind of toxicity it is follows
from seed words in toxic rows; which words speak for a category is learned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, whole_text
from .words import chunks, hash_words, shingle_sets

# Seed words of the categories, in the order of the chain.
SEEDS = {
    "insult": ("idiot", "moron", "stupid", "dumb", "fool", "clown", "loser", "imbecile"),
    "contempt": ("worthless", "pathetic", "trash", "scum", "garbage", "vermin", "disgusting"),
    "threat": ("kill", "die", "hurt", "destroy", "burn", "murder"),
}
CHAIN = (*SEEDS, "toxic")
#: Bound of the fit: labelled rows per label.
SAMPLE = 10_000
#: A word is looked at if it is in so many of them.
LEAST_TEXTS = 4
#: A word is left out if the penalty holds its weight, in log odds, below this.
UNFELT = 0.1
FOLDS = 5
#: Besides whole words the models see beginnings of so many bytes, for inflected words.
BEGINNINGS = (4, 5, 6, 7, 8)
PENALTY = 0.01
THRESHOLD = 0.5

_WHOLE = 1 << 30  # size of a whole word among sizes of beginnings
_LETTERS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, folded, and of the first bytes of longer ones; their texts."""
    words, of, *_ = hash_words([t.translate(_LETTERS) for t in texts], BEGINNINGS)
    return words, of


def _word(text: str) -> int:
    return int(_hashed([text.encode()])[0][0])


class Marks:
    """A matrix of zeros with ones at ``rows`` and ``columns``, which come by row."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int]):
        self.rows, self.columns, self.shape = rows, columns, shape
        new = np.ones(len(rows), dtype=bool)
        new[1:] = rows[1:] != rows[:-1]
        self._starts = np.flatnonzero(new)
        self._turned: Marks | None = None

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[0])
        if len(self.rows):
            out[self.rows[self._starts]] = np.add.reduceat(v[self.columns], self._starts)
        return out

    def __pow__(self, n: int) -> Marks:
        return self

    @property
    def T(self) -> Marks:  # noqa: N802
        if self._turned is None:
            order = np.argsort(self.columns, kind="stable")
            self._turned = Marks(self.columns[order], self.rows[order], self.shape[::-1])
            self._turned._turned = self
        return self._turned


def held(names: np.ndarray, texts: list[bytes]) -> Marks:
    """Texts by words: which of ``names``, sorted hashes, each text holds."""
    words, of = _hashed(texts)
    shape = len(texts), len(names)
    if not len(names) or not len(words):
        none = np.zeros(0, dtype=np.int64)
        return Marks(none, none, shape)
    at = np.minimum(np.searchsorted(names, words), len(names) - 1)
    hit = names[at] == words
    pairs = np.unique(of[hit] * len(names) + at[hit])
    return Marks(pairs // len(names), pairs % len(names), shape)


@dataclass
class ToxicityModel:
    """Words looked at, sorted, and the weights of each category's model."""

    words: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Texts by categories: probabilities, each step fed the ones before."""
        x, found = held(self.words, texts), np.zeros((len(texts), 0))
        for w in self.weights:
            found = np.hstack([found, probability([x, found], w)[:, None]])
        return found


def _times(block, v: np.ndarray) -> np.ndarray:
    """``block @ v`` without the threads of a linear algebra library, which would wait busily."""
    return block @ v if isinstance(block, Marks) else np.einsum("ij,j->i", block, v)


def _ahead(blocks: list, weights: np.ndarray) -> np.ndarray:
    """Intercept, and the blocks side by side, times the weights."""
    out, at = weights[0], 1
    for b in blocks:
        out = out + _times(b, weights[at : at + b.shape[1]])
        at += b.shape[1]
    return out


def _back(blocks: list, v: np.ndarray) -> np.ndarray:
    return np.concatenate([[v.sum()], *[_times(b.T, v) for b in blocks]])


def probability(blocks: list, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_ahead(blocks, weights), -30, 30)))


def logistic(
    x,
    y: np.ndarray,
    penalty: float | np.ndarray = PENALTY,
    use: np.ndarray | None = None,
    start: np.ndarray | None = None,
) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept is not penalised.

    ``x`` is a matrix or a list of them that stand side by side, ``penalty`` one number
    or one per column, ``use`` says which rows count. A step is solved by conjugate
    gradients, so the matrix is only ever multiplied with, and halved while it does
    not lessen the loss. With one label only, the intercept says so and all else is 0.
    """
    blocks = x if isinstance(x, list) else [x]
    size = 1 + sum(b.shape[1] for b in blocks)
    use = np.ones(len(y)) if use is None else use.astype(float)
    seen = y[use > 0]
    if not len(seen) or seen.min() == seen.max():
        weights = np.zeros(size)
        weights[0] = -12.0 if not len(seen) or seen.max() == 0 else 12.0
        return weights
    ridge = np.concatenate([[1e-6], np.broadcast_to(penalty, size - 1)])
    squares = [b**2 for b in blocks]

    def loss(margin, w):
        return (use * (np.logaddexp(0, margin) - y * margin)).sum() + (ridge * w * w).sum() / 2

    weights = np.zeros(size) if start is None else start.copy()
    if start is None:
        weights[0] = np.log(seen.mean() / (1 - seen.mean()))
    margin = _ahead(blocks, weights) + np.zeros(len(y))
    now = loss(margin, weights)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        slope = _back(blocks, use * (p - y)) + ridge * weights
        bend = use * p * (1 - p) + 1e-9
        scale = _back(squares, bend) + ridge
        step, left = np.zeros(size), -slope
        way = left / scale
        size_now = size_first = (left * way).sum()
        for _ in range(60):
            if size_now <= 1e-2 * size_first:
                break
            curved = _back(blocks, bend * _ahead(blocks, way)) + ridge * way
            far = size_now / (way * curved).sum()
            step += far * way
            left = left - far * curved
            size_before, size_now = size_now, (left * left / scale).sum()
            way = left / scale + size_now / size_before * way
        more, t = _ahead(blocks, step), 1.0
        while (then := loss(margin + t * more, weights + t * step)) > now and t > 1e-4:
            t /= 2
        if then > now:
            break
        weights, margin = weights + t * step, margin + t * more
        done = now - then <= 1e-5 * now
        now = then
        if done:
            break
    return weights


@dataclass
class Fits:
    """The models of each category so far: one without each fold, then one of all rows."""

    weights: list[list[np.ndarray]] = field(default_factory=list)

    def earlier(self, x, fold: np.ndarray) -> np.ndarray:
        """Rows by categories so far: what models say that have not seen the row."""
        seen = np.zeros((len(fold), 0))
        for models in self.weights:
            unseen = np.zeros(len(fold))
            for f in range(FOLDS):
                unseen[fold == f] = probability([x, seen], models[f])[fold == f]
            seen = np.hstack([seen, unseen[:, None]])
        return seen

    def fit(self, f: int, x, y: np.ndarray, fold: np.ndarray, penalty) -> np.ndarray:
        """The next category's model without fold ``f``; ``FOLDS`` leaves none out."""
        each = np.concatenate(
            [np.broadcast_to(penalty, x.shape[1]), np.full(len(self.weights), PENALTY)]
        )
        return logistic([x, self.earlier(x, fold)], y, each, use=fold != f)


def fit_chain(
    words: np.ndarray, x, targets: np.ndarray, penalty: float | np.ndarray = PENALTY
) -> ToxicityModel:
    """A chain for ``targets`` (rows by categories) over ``x`` (rows by words)."""
    n, categories = targets.shape
    fold, fits = np.arange(n) % FOLDS, Fits()
    for c in range(categories):
        which = range(FOLDS + 1) if c + 1 < categories else [FOLDS] * (FOLDS + 1)
        fits.weights.append([fits.fit(f, x, targets[:, c], fold, penalty) for f in which])
    return ToxicityModel(words, [models[FOLDS] for models in fits.weights])


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Up to ``sample`` labelled texts of either label, those of smallest id hash.

    Of copies and near copies with one label, told by the least hash of three words
    in a row, one stays: else words of a text often copied would look telling.
    """
    marks = (
        labels.where("toxic is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("y"))
    )
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = [marks.where(F.col("y") == y).orderBy(*order).limit(sample) for y in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * sample pairs of numbers

    def shaped(parts):
        for part in parts:
            texts = part.column("text").cast(pa.binary()).to_pylist()
            for first, held in chunks(texts):
                least = [int(s.min()) if len(s) else 0 for s in shingle_sets(held, 3)]
                rows = part.slice(first, len(held))
                shape = pa.array(np.array(least, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([*rows.columns, shape], [*rows.schema.names, "shape"])

    return (
        docs.select("doc_id", whole_text().alias("text"))
        .join(few, "doc_id")
        .mapInArrow(shaped, "doc_id long, text string, y int, shape long")
        .groupBy("y", "shape")
        .agg(F.min(F.struct("doc_id", "text")).alias("r"))
        .select("r.doc_id", "r.text", "y")
    )


def evidence(toxic, clean, share: float) -> np.ndarray:
    """Log of how much likelier a word's counts are if it tells something than if not.

    Half the likelihood ratio, less what one more free number is worth.
    """
    toxic, clean = np.asarray(toxic, dtype=float), np.asarray(clean, dtype=float)
    n = toxic + clean
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(toxic > 0, toxic * np.log(toxic / (n * share)), 0)
        b = np.where(clean > 0, clean * np.log(clean / (n * (1 - share))), 0)
    return np.minimum(a + b, 50) - np.log(n) / 2


def chance_of_telling(logs: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """For words of so much evidence the chance that they tell something; of each there
    may be several, ``times``.

    What share of all words tells is found from the words themselves, so a word needs
    less among many telling ones than among many that only seem so.
    """
    times = np.ones(len(logs)) if times is None else times
    ratio, prior = np.exp(logs), 0.01
    for _ in range(200):
        chance = prior * ratio / (prior * ratio + 1 - prior)
        before, prior = prior, max((chance * times).sum(), 1.0) / (times.sum() + 2)
        if abs(prior - before) < 1e-3 * before:
            break
    return prior * ratio / (prior * ratio + 1 - prior)


def word_counts(rows: DataFrame) -> DataFrame:
    """word, toxic, clean: texts of either label that hold it, for all words and beginnings
    in ``LEAST_TEXTS`` texts, without the beginnings found in just the texts of a longer one
    or of a whole word."""

    def counted(parts):
        for part in parts:
            y = part.column("y").to_numpy(zero_copy_only=False)
            marks = part.column("mark").to_numpy(zero_copy_only=False)
            texts = part.column("text").cast(pa.binary()).to_pylist()
            for first, some in chunks(texts):
                folded = [t.translate(_LETTERS) for t in some]
                words, of, _, size, _ = hash_words(folded, BEGINNINGS)
                if not len(words):
                    continue
                size[: len(hash_words(folded)[0])] = _WHOLE
                order = np.lexsort((of, words))
                words, of, size = words[order], of[order], size[order]
                new = np.ones(len(words), dtype=bool)
                new[1:] = (words[1:] != words[:-1]) | (of[1:] != of[:-1])
                words, of, size = words[new], of[new] + first, size[new]
                starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
                toxic = np.add.reduceat((y[of] == 1).astype(np.int64), starts)
                n = np.diff(np.append(starts, len(words)))
                columns = [
                    words[starts].view(np.int64), size[starts], toxic, n - toxic,
                    np.bitwise_xor.reduceat(marks[of], starts),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], ["word", "size", "toxic", "clean", "texts"]
                )

    counts = (
        rows.select("text", "y", F.xxhash64("doc_id", "text").alias("mark"))
        .mapInArrow(counted, "word long, size long, toxic long, clean long, texts long")
        .groupBy("word", "size")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_xor("texts").alias("texts"))
        .where(F.col("toxic") + F.col("clean") >= LEAST_TEXTS)
    )
    longest = F.max("size").over(Window.partitionBy("texts"))
    return counts.withColumn("longest", longest).where("size = longest").select("word", "toxic", "clean")


def telling_words(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, sorted, and the penalty of each: the less a word's counts speak for
    its telling anything, the more is asked of its weight.

    No number of words is fixed. A weight is at most the word's texts over its penalty;
    words whose weight would stay under ``UNFELT`` are left out. The driver sees how
    many words have which counts, and the words that are left.
    """
    none = np.zeros(0, dtype=np.uint64), np.zeros(0)
    totals = dict(rows.groupBy("y").count().collect())
    share = totals.get(1, 0) / max(sum(totals.values()), 1)
    if not 0 < share < 1:
        return none
    counts = stored(word_counts(rows), "toxic-words")
    pairs = counts.groupBy("toxic", "clean").count().toPandas().sort_values(["toxic", "clean"])
    toxic, clean = pairs["toxic"].to_numpy(), pairs["clean"].to_numpy()
    chance = np.maximum(chance_of_telling(evidence(toxic, clean, share), pairs["count"].to_numpy()), 1e-9)
    pairs["penalty"] = PENALTY / chance**2
    felt = pairs[(toxic + clean) / pairs["penalty"] > UNFELT]
    if felt.empty:
        return none
    few = rows.sparkSession.createDataFrame(felt[["toxic", "clean", "penalty"]])
    found = counts.join(few, ["toxic", "clean"]).select("word", "penalty").toArrow()
    words = found.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    return words[order], found.column("penalty").to_numpy()[order]


def placed_words(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """fold, kinds, places of each of ``rows`` (doc_id, y, text): which of ``words`` it holds and,
    as bits, of which categories it is."""
    seeds = [np.sort(np.array([_word(w) for w in ws], dtype=np.uint64)) for ws in SEEDS.values()]

    def places(parts):
        for part in parts:
            labels = part.column("y").to_numpy(zero_copy_only=False)
            for first, some in chunks(part.column("text").cast(pa.binary()).to_pylist()):
                y = labels[first : first + len(some)] == 1
                kinds = y.astype(np.int64) << len(seeds)
                for i, names in enumerate(seeds):
                    seen = np.bincount(held(names, some).rows, minlength=len(some)) > 0
                    kinds |= (y & seen).astype(np.int64) << i
                marks = held(words, some)
                ends = np.searchsorted(marks.rows, np.arange(len(some) + 1))
                at = marks.columns.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("fold").slice(first, len(some)),
                        pa.array(kinds),
                        pa.array([at[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary()),
                    ],
                    ["fold", "kinds", "places"],
                )

    fold = F.pmod(F.xxhash64("doc_id", "text"), F.lit(FOLDS)).alias("fold")
    return rows.select(fold, "y", "text").mapInArrow(places, "fold long, kinds long, places binary")


def _fitter(category: int, fits: Fits, penalty: np.ndarray):
    """A function that fits one of a category's models to all sampled rows, in one task."""

    def fit(key, table):
        table = table.sort_by([(c, "ascending") for c in ("fold", "kinds", "places")])
        each = table.column("places").to_pylist()  # bounded by the sample
        fold, kinds = table.column("fold").to_numpy(), table.column("kinds").to_numpy()
        of = np.repeat(np.arange(len(each)), np.array([len(b) // 4 for b in each], dtype=np.int64))
        x = Marks(of, np.frombuffer(b"".join(each), dtype=np.int32), (len(each), len(penalty)))
        y = (kinds >> category & 1).astype(float)
        weights = fits.fit(key[0].as_py(), x, y, fold, penalty)
        return pa.table({"fit": pa.array([key[0].as_py()], pa.int32()), "weights": [weights.tobytes()]})

    return fit


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """The chain, from at most ``2 * sample`` labelled texts.

    A category's models, one without each fold and one of all rows, are fitted side by side
    in tasks; the driver only hands the weights on to the next category.
    """
    rows = stored(training_rows(docs, labels, sample), "toxic-rows")
    words, penalty = telling_words(rows)
    placed = stored(placed_words(rows, words), "toxic-places")
    fits = Fits()
    for c in range(len(CHAIN)):
        which = range(FOLDS + 1) if c + 1 < len(CHAIN) else [FOLDS]
        each = placed.withColumn("fit", F.explode(F.array(*[F.lit(f) for f in which])))
        done = each.groupBy("fit").applyInArrow(_fitter(c, fits, penalty), "fit int, weights binary")
        found = {r["fit"]: np.frombuffer(r["weights"]) for r in done.collect()}  # six at most
        if FOLDS not in found:  # no rows: as if no text were of the category
            found = {}
        none = np.zeros(1 + len(words) + c)
        none[0] = -12.0
        fits.weights.append([found.get(f, none) for f in range(FOLDS + 1)])
    return ToxicityModel(words, [models[FOLDS] for models in fits.weights])


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic (true or false), score and a probability per category, for all documents.

    ``score`` is the last category's probability, ``toxic`` whether it is 0.5 or
    more. A null text is empty. Without labels, or with one label only, all scores
    are next to 0 or 1. Contradicting labels of one id count as toxic, null labels
    and ids train nothing. Repeated rows get equal scores. Other columns are not
    looked at.
    """
    model = train(docs, labels)
    names = [f"p_{c}" for c in SEEDS]

    def batches(parts):
        for part in parts:
            for first, held in chunks(part.column("text").cast(pa.binary()).to_pylist()):
                p = model.predict(held)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").slice(first, len(held)),
                        pa.array(p[:, -1] >= THRESHOLD),
                        pa.array(p[:, -1]),
                        *[pa.array(p[:, i]) for i in range(len(names))],
                    ],
                    ["doc_id", "toxic", "score", *names],
                )

    kinds = ", ".join(f"{n} double" for n in names)
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(
        batches, f"doc_id long, toxic boolean, score double, {kinds}"
    )
