"""Approximate nearest neighbours by adaptive dimension scan.

Largest inner product is nearest distance once each vector gets one more
coordinate that brings it to the longest vector's norm. A random rotation then
makes every block of coordinates a fair sample of the whole. Vectors lie in lists
around centroids; for each query, a probed list is scanned block of columns by
block of columns, and a candidate is abandoned as soon as its partial distance
rejects the hypothesis that the whole one is within the best k so far. What is
left is ranked by exact double-precision products of the original vectors. Lists
are probed in waves, nearest first, each four times as large as all before, so
that later lists are scanned against the k-th best score found in earlier ones and
hand on few candidates.

How many lists are probed is not given but measured: where the nearest neighbours
of sampled vectors lie among a sample of the table decides. Clustered vectors need
few lists; vectors without any structure need most of them, as with every index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SAMPLE = 16_384  # vectors that centroids are fitted on, chosen by hash; four for each list where that is more
LIST_SIZE = 2000  # wanted vectors in a list, until there are as many lists as the square root of all vectors
RECALL = 0.97  # share of sampled neighbours that must lie in the probed lists
BLOCK = 16  # columns in a block
EPSILON = 2.1  # of the hypothesis test
TASK_ROWS = 16_384  # vectors, and queries, that meet in one group
SEED = 42


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of doubles): vectors that are not null, empty or zero and have finite components only."""
    v = F.col(vec_col).cast("array<double>")
    bad: Column = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))


class Lists:
    """Rotation and centroids, as many as the square root of the table's rows at most."""

    def __init__(self, sample: np.ndarray, dim: int, longest: float, n_lists: int, rounds: int = 8):
        rng = np.random.default_rng(SEED)
        self.dim, self.longest = dim, longest
        self.rotation = np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0].astype(np.float32)
        x = self.place(sample)
        self.centroids = x[rng.choice(len(x), size=min(n_lists, len(x)), replace=False)]
        for _ in range(rounds):
            at = self.order(x, 1)[:, 0]
            sums, n = np.zeros_like(self.centroids, dtype=np.float64), np.bincount(at, minlength=len(self.centroids))
            np.add.at(sums, at, x)
            self.centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], self.centroids).astype(np.float32)

    def place(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated coordinates, with the one that evens out the norms (0 for queries)."""
        more = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.longest**2 - (v * v).sum(axis=1), 0))
        return np.hstack([v, more[:, None]]).astype(np.float32) @ self.rotation

    def order(self, x: np.ndarray, first: int) -> np.ndarray:
        """The nearest centroids of each row, nearest first."""
        d = (self.centroids**2).sum(axis=1)[None, :] - 2 * x @ self.centroids.T
        return np.argsort(d, axis=1, kind="stable")[:, :first]

    def probes(self, sample: np.ndarray, k: int, recall: float) -> int:
        """Lists to probe, nearest first, so that they hold ``recall`` of the k nearest of sampled vectors, among the sample.

        Neighbours in a whole table are nearer than those in its sample, so more of them lie in near lists."""
        asked, every = sample[:: max(1, len(sample) // 512)], np.arange(len(sample))
        if len(self.centroids) == 1 or len(sample) < 2:
            return 1
        own = self.order(self.place(sample), 1)[:, 0]
        place = np.argsort(self.order(self.place(asked, True), len(self.centroids)), axis=1)
        score = asked @ sample.T
        score[np.arange(len(asked)), every[:: max(1, len(sample) // 512)]] = -np.inf
        k = min(k, len(sample) - 1)
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        return int(np.quantile(np.take_along_axis(place, own[near], axis=1), recall, method="higher")) + 1


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if isinstance(column, pa.ChunkedArray) else column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _listed(rows: DataFrame, lists: Lists, probes: int, query: bool) -> DataFrame:
    """vec_id, v (bytes), list, turn: one row for each of the nearest lists, turn 0 the nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"), lists.dim)
            for s in range(0, len(v), 1024):
                some = v[s : s + 1024]
                at = lists.order(lists.place(some, query), probes)
                n = at.shape[1]
                take = pa.array(np.repeat(np.arange(len(some)), n))
                raw = pa.array([r.tobytes() for r in some], pa.binary())
                yield pa.record_batch({"vec_id": b.column("vec_id").slice(s, 1024).take(take), "v": raw.take(take), "list": pa.array(at.ravel().astype(np.int32)), "turn": pa.array(np.tile(np.arange(n, dtype=np.int32), len(some)))})

    return rows.mapInArrow(run, "vec_id long, v binary, list int, turn int")


def scan(q: np.ndarray, x_blocks: list[np.ndarray], k: int, known: float = np.inf, epsilon: float = EPSILON) -> np.ndarray:
    """Rows that may be among the k nearest to q; ``scan_many`` for one query."""
    return scan_many(q[None, :], x_blocks, k, np.array([known]), epsilon)[1]


def scan_many(q: np.ndarray, x_blocks: list[np.ndarray], k: int, known: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Queries and rows (by number) that may be among the query's k nearest. x_blocks: the list's columns, block by block.

    known: squared distances of the k-th nearest found elsewhere. Without one the
    first rows set the bound; others are abandoned by their partial distances, in
    ever later blocks: all pairs by matrix products while many are left, then those left."""
    n, d = len(x_blocks[0]), q.shape[1]
    edges = np.cumsum([0, *(b.shape[1] for b in x_blocks)])
    squares = [(b * b).sum(axis=1) for b in x_blocks]
    # distances are differences of products: what single precision may lose is allowed for
    slack = 4e-6 * ((q * q).sum(axis=1) + sum(squares).max())
    bound, unset = known.astype(np.float64), np.isinf(known)
    if n > k and unset.any():
        some = np.hstack([b[: 4 * k] for b in x_blocks])
        whole = (q[unset] ** 2).sum(axis=1)[:, None] + (some * some).sum(axis=1)[None, :] - 2 * q[unset] @ some.T
        bound[unset] = np.partition(whole, k - 1, axis=1)[:, k - 1]
    partial, at, rows = np.zeros((len(q), n), np.float32), None, None
    for b, square, lo, hi in zip(x_blocks, squares, edges, edges[1:], strict=False):
        part, done = q[:, lo:hi], hi / d
        limit = (bound * (1 + 1e-5) * (done * (1 + epsilon / np.sqrt(hi)) ** 2 if hi < d else 1) + slack).astype(np.float32)
        if at is None:
            partial += (part * part).sum(axis=1)[:, None] + square[None, :] - 2 * part @ b.T
            alive = partial <= limit[:, None]
            if hi == d or np.count_nonzero(alive) * 16 < alive.size:
                at, rows = np.nonzero(alive)
                partial = partial[at, rows]
        else:
            partial = partial + ((b[rows] - part[at]) ** 2).sum(axis=1)
            alive = partial <= limit[at]
            at, rows, partial = at[alive], rows[alive], partial[alive]
    order = np.lexsort((partial, at))
    starts = np.searchsorted(at[order], np.arange(len(q)))
    counts = np.bincount(at, minlength=len(q))
    best = np.full(len(q), np.inf)
    more = counts > k
    best[more] = partial[order][starts[more] + k - 1]
    keep = partial <= best[at] * (1 + 1e-5) + slack[at]
    return at[keep], rows[keep]


def _meet(lists: Lists, k: int, block: int):
    d = lists.dim

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, q_ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        v = np.frombuffer(b"".join(left["v"].to_pylist()), np.float64).reshape(-1, d)
        x, v = lists.place(v), v.T.copy()
        qv = np.frombuffer(b"".join(right["v"].to_pylist()), np.float64).reshape(-1, d)
        qx = lists.place(qv, True)
        # k-th best product so far, as a squared distance in the evened-out space
        least = right["least"].to_numpy()
        known = lists.longest**2 + (qv * qv).sum(axis=1) - 2 * least
        blocks = [np.ascontiguousarray(x[:, a : a + block]) for a in range(0, d + 1, block)]
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        step = max(1, 4_000_000 // max(len(ids), 1))  # queries whose distances are held at once
        for s in range(0, len(q_ids), step) if len(ids) else ():
            at, rows = scan_many(qx[s : s + step], blocks, k + 1, known[s : s + step])  # one more: the query itself may lie here
            at = at + s
            other = ids[rows] != q_ids[at]
            at, rows = at[other], rows[other]
            for e in range(0, len(at), 1_000_000):
                a, r = at[e : e + 1_000_000], rows[e : e + 1_000_000]
                score = v[0, r] * qv[a, 0]
                for c in range(1, d):  # component by component, in order
                    score += v[c, r] * qv[a, c]
                good = score >= least[a]
                out.append((a[good], r[good], score[good]))
        at, rows, score = (np.concatenate(z) for z in zip(*out, strict=True))
        order = np.lexsort((ids[rows], -score, at))
        at, rows, score = at[order], rows[order], score[order]
        best = np.arange(len(at)) - np.searchsorted(at, at) < k
        return pa.table({"query_id": pa.array(q_ids[at[best]], pa.int64()), "vec_id": pa.array(ids[rows[best]], pa.int64()), "score": pa.array(score[best], pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL,
            list_size: int = LIST_SIZE, block: int = BLOCK, sample: int = SAMPLE, task_rows: int = TASK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` found with the largest inner products.

    Ties go to the smaller vec_id; a query is no candidate of its own. Null, empty
    and zero vectors, those with null or non-finite components and those without an
    identifier take no part, as candidates or as queries. Vectors shorter than the
    longest count as zero in the components that they lack. Repeated rows are
    candidates each. Empty tables give no rows; further columns are ignored.
    """
    rows, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    spark = vectors.sparkSession
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    n, longest, dim = rows.agg(F.count(F.lit(1)), F.max(squares), F.max(F.size("v"))).first()
    q_dim = asked.agg(F.max(F.size("v"))).first()[0]
    if not n or not q_dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = max(dim, q_dim)
    rows, asked = (x.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v")))) for x in (rows, asked))
    n_lists = max(1, int(min(n // list_size, n**0.5)))
    fitted = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(max(sample, 4 * n_lists)).select("v").toArrow()
    fitted = _matrix(fitted["v"], dim)
    lists = Lists(fitted, dim, float(longest) ** 0.5, n_lists)
    probes = lists.probes(fitted, k, recall)

    inside = cut(_listed(rows, lists, 1, False))
    probing = cut(_listed(asked, lists, probes, True))
    # a long list is cut by hash into parts, and the queries into chunks: one part and one chunk meet in a group
    parts = inside.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / task_rows).cast("int").alias("parts"))
    chunks = probing.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / task_rows).cast("int").alias("chunks"))
    sizes = F.broadcast(cut(parts.join(chunks, "list")))  # a row a list, the square root of the table
    left = inside.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = probing.join(sizes, "list").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["list", "part", "chunk"]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    found, begin, end = None, 0, 1
    while begin < probes:
        wave = right.filter((F.col("turn") >= begin) & (F.col("turn") < end)).select(*key, "vec_id", "v")
        if found is not None:
            least = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
            wave = wave.join(least, "vec_id", "left").select(*key, "vec_id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        else:
            wave = wave.withColumn("least", F.lit(float("-inf")))
        more = (
            left.select(*key, "vec_id", "v").groupBy(*key).cogroup(wave.groupBy(*key))
            .applyInArrow(_meet(lists, k, block), "query_id long, vec_id long, score double")
        )
        both = more if found is None else found.select("query_id", "vec_id", "score").unionByName(more)
        found = cut(both.withColumn("rank", rank).filter(F.col("rank") <= k))
        begin, end = end, 5 * end
    return found.select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
