"""Approximate nearest neighbours by learned partitions.

On a bounded sample a graph of near neighbours is cut into parts of equal size with
few edges between them, and a small classifier learns from a vector the parts its
neighbours are in. The classifier then puts every row of the table into a part and
sends every query to its most probable parts, where candidates are compared exactly.
How many parts a query visits is chosen so that, on vectors the classifier has not
seen, the wanted share of true neighbours is found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Bounds of the fit: vectors, of which one in six only measures recall.
SAMPLE = 6000
PARTS = 32
GRAPH = 12
HIDDEN = 96
EPOCHS = 40
SEED = 11
#: Share of true neighbours to be found on the sample; in a fuller table it is higher.
RECALL = 0.96
#: Vectors and queries that meet in one task.
BLOCK_VECTORS = 32_768
BLOCK_QUERIES = 2048


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has ``size`` finite components, not all of them 0."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(
        (F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def nearest(x: np.ndarray, among: np.ndarray, k: int, skip: np.ndarray) -> np.ndarray:
    """For each row of ``x`` the ``k`` rows of ``among`` of largest inner product, but not
    the one numbered ``skip``."""
    out = np.empty((len(x), min(k, len(among) - 1)), dtype=np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ among.T
        s[np.arange(len(s)), skip[a : a + 512]] = -np.inf
        out[a : a + 512] = np.argsort(-s, axis=1, kind="stable")[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """Parts of equal size with few edges of ``graph`` between them.

    Halving along random directions gives parts of equal size near each other. Then
    every vector in turn goes where most of its neighbours are, if there is room.
    """
    rng = np.random.default_rng(seed)
    n = len(x)
    part = np.zeros(n, dtype=np.int64)
    groups = [(np.arange(n), 0, parts)]
    while groups:
        members, first, count = groups.pop()
        if count == 1 or not len(members):
            part[members] = first
            continue
        spread = x[members] - x[members].mean(axis=0)
        way = rng.normal(size=x.shape[1])
        for _ in range(8):  # towards the direction in which they differ most
            way = spread.T @ (spread @ way)
            way /= max(np.linalg.norm(way), 1e-30)
        half = count // 2
        order = members[np.argsort(spread @ way, kind="stable")]
        cut = len(order) * half // count
        groups += [(order[:cut], first, half), (order[cut:], first + half, count - half)]
    near: list[set[int]] = [set(row.tolist()) for row in graph]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            near[j].add(i)
    listed = [list(s) for s in near]
    room = int(np.ceil(1.05 * n / parts))
    size = np.bincount(part, minlength=parts)
    for _ in range(12):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[listed[i]], minlength=parts)
            votes_here = votes[part[i]]
            votes[size >= room] = -1
            best = int(votes.argmax())
            if votes[best] > votes_here:
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return part


@dataclass
class Router:
    """A classifier of one hidden layer from vectors to parts, and how many to visit."""

    size: int
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def best(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` most probable parts of each vector, the likeliest first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def fit_classifier(x: np.ndarray, target: np.ndarray, seed: int) -> Router:
    """Adam on the cross entropy to ``target``, the parts of each vector's neighbours."""
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], target.shape[1]
    scale = float(1 / max(np.sqrt((x**2).sum(axis=1)).mean(), 1e-30))
    r = Router(
        d, scale, rng.normal(0, np.sqrt(2 / d) * 4, (d, HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts),
    )
    weights = [r.w1, r.b1, r.w2, r.b2]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 128):
            batch = x[order[a : a + 128]] * scale
            y = target[order[a : a + 128]]
            hidden = np.maximum(batch @ r.w1 + r.b1, 0)
            z = hidden @ r.w2 + r.b2
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            dz = (p - y) / len(batch)
            dh = (dz @ r.w2.T) * (hidden > 0)
            slopes = [batch.T @ dh + 1e-4 * r.w1, dh.sum(0), hidden.T @ dz + 1e-4 * r.w2, dz.sum(0)]
            step += 1
            for w, g, m, v in zip(weights, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                rate = 2e-3 * (1 - 0.8 * epoch / EPOCHS)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return r


def fit_router(x: np.ndarray, k: int, parts: int = PARTS, seed: int = SEED) -> Router:
    """The router for the sample ``x``; one part for a small sample."""
    n, d = x.shape
    parts = max(1, min(parts, n // 40))
    kept = np.arange(n) % 6 == 0
    train = np.flatnonzero(~kept) if parts > 1 else np.arange(n)
    if parts == 1:
        zero = np.zeros
        return Router(d, 1.0, zero((d, 1)), zero(1), zero((1, 1)), zero(1), 1)
    own = x[train]
    graph = nearest(own, own, GRAPH, np.arange(len(own)))
    part = balanced_parts(own, graph, parts, seed)
    target = np.zeros((len(own), parts))
    for j in range(graph.shape[1]):
        target[np.arange(len(own)), part[graph[:, j]]] += 0.5 / graph.shape[1]
    target[np.arange(len(own)), part] += 0.5
    router = fit_classifier(own, target, seed)
    held = np.flatnonzero(kept)
    true = nearest(x[held], x, k, held)
    place = router.best(x, 1)[:, 0]
    ranked = router.best(x[held], parts)
    rank_of = np.empty_like(ranked)
    rank_of[np.arange(len(held))[:, None], ranked] = np.arange(parts)
    visited = rank_of[np.arange(len(held))[:, None], place[true]]
    found = np.array([(visited < m).mean() for m in range(1, parts + 1)])
    router.visits = int(np.argmax(found >= RECALL)) + 1 if (found >= RECALL).any() else parts
    return router


def train(vectors: DataFrame, k: int, sample: int = SAMPLE) -> Router:
    """The router from up to ``sample`` different vectors, those of smallest hash."""
    rows = (
        vectors.select("embedding")
        .distinct()
        .orderBy(F.xxhash64("embedding"), "embedding")
        .limit(sample)
        .collect()
    )
    return fit_router(np.array([r[0] for r in rows], dtype=np.float64), k)


def _matrix(column, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, size)


def _routed(rows: DataFrame, router: Router, visits: int) -> DataFrame:
    """``rows`` (vec_id, embedding) once for each of the ``visits`` likeliest parts."""

    def batches(parts):
        for part in parts:
            if part.num_rows:
                best = router.best(_matrix(part.column("embedding"), router.size), visits)
                index = pa.array(np.repeat(np.arange(part.num_rows), best.shape[1]))
                rows = part.take(index)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(best.ravel().astype(np.int32))],
                    [*rows.schema.names, "part"],
                )

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.mapInArrow(batches, f"vec_id long, embedding {kind}, part int")


def _top(query_ids, queries, ids, vectors, k: int):
    """The best ``k`` of ``vectors`` for each query: numbers of queries, ids, scores.

    Candidates come from one matrix product. Its rounding depends on where a row
    stands, so all within rounding of the k-th are scored again, in a fixed order.
    """
    out = [[], [], []]
    for a in range(0, len(queries), 128):
        q = queries[a : a + 128]
        s = q @ vectors.T
        s[query_ids[a : a + 128, None] == ids[None, :]] = -np.inf
        keep = min(k, s.shape[1])
        last = np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep]
        slack = 1e-12 * (np.abs(q).max(axis=1) * np.abs(vectors).max() * q.shape[1] + 1e-300)
        for i in range(len(q)):
            at = np.flatnonzero((s[i] >= last[i] - slack[i]) & (s[i] > -np.inf))
            exact = (vectors[at] * q[i]).sum(axis=1)
            order = np.lexsort((ids[at], -exact))[:k]
            out[0].append(np.full(len(order), query_ids[a + i]))
            out[1].append(ids[at][order])
            out[2].append(exact[order])
    kinds = (np.int64, np.int64, np.float64)
    return [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, kinds, strict=True)]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query, nearest first.

    ``vectors`` and ``queries`` have ``vec_id`` and ``embedding``. Near is a large
    inner product, computed in double precision on the vectors as they are; ties go to
    the smaller id. A row of the query's own id is no candidate. Vectors that are null,
    zero, or have null or non-finite components, or another number of components than
    most, take no part, nor do rows without an id. Repeated rows of an id are
    candidates each; of repeated queries one is answered. Other columns are not looked at.

    Parts, however full, are cut into blocks of bounded size, and so are the queries
    that visit them; every block of one meets every block of the other.
    """
    sized = (
        vectors.where("embedding is not null")
        .groupBy(F.size("embedding").alias("size"))
        .count()
        .orderBy(F.desc("count"), "size")
        .head()
    )
    kind = "query_id long, rank int, vec_id long, score double"
    if sized is None:
        return vectors.sparkSession.createDataFrame([], kind)
    size = sized[0]
    some = F.col("vec_id").isNotNull() & usable(F.col("embedding"), size)
    rows = vectors.select("vec_id", "embedding").where(some)
    asked = queries.select("vec_id", "embedding").where(some).dropDuplicates(["vec_id"])
    if not rows.head(1):
        return vectors.sparkSession.createDataFrame([], kind)
    router = train(rows, k, sample)
    index = stored(_routed(rows, router, 1), "index")
    visits = stored(_routed(asked, router, router.visits), "visits")

    def blocks(df: DataFrame, most: int) -> dict[int, int]:
        return {r[0]: -(-r[1] // most) for r in df.groupBy("part").count().collect()}

    of_vectors, of_queries = blocks(index, BLOCK_VECTORS), blocks(visits, BLOCK_QUERIES)
    parts = [
        (p, of_vectors.get(p, 0), of_queries.get(p, 0)) for p in {*of_vectors, *of_queries}
    ]  # at most PARTS
    plan = F.broadcast(
        vectors.sparkSession.createDataFrame(parts, "part int, v_blocks int, q_blocks int")
    )
    own = F.xxhash64("vec_id")
    left = (
        index.join(plan.where("q_blocks > 0"), "part")
        .withColumn("vb", F.pmod(own, F.col("v_blocks")).cast("int"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
    )
    right = (
        visits.join(plan.where("v_blocks > 0"), "part")
        .withColumn("qb", F.pmod(own, F.col("q_blocks")).cast("int"))
        .withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("v_blocks") - 1)))
    )
    key, columns = ["part", "vb", "qb"], ["part", "vb", "qb", "vec_id", "embedding"]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64)]
        if a.num_rows and b.num_rows:
            found = _top(
                b.column("vec_id").to_numpy(),
                _matrix(b.column("embedding"), size),
                a.column("vec_id").to_numpy(),
                _matrix(a.column("embedding"), size),
                k,
            )
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    met = (
        left.select(columns)
        .groupBy(*key)
        .cogroup(right.select(columns).groupBy(*key))
        .applyInArrow(meet, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        met.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
