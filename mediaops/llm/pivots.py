"""Centroid clustering with a pivot table (LAESA).

The distances of every vector to a few fixed pivots are computed once and stored
beside it. In each round a centroid's distances to the same pivots bound its
distance to a vector from below, by the largest difference of the two rows; only
centroids whose bound does not exceed the nearest one found so far get an exact
distance, in whole numbers. The pivots are the starting centroids: while a centroid
stays near where it began, its own pivot rules it in or out almost alone. Clustered
vectors need few exact distances; vectors without structure need nearly all of them,
as with every bound by the triangle inequality.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

DIMS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Components must be under this in absolute value, so that squared distances fit a long.
LARGEST = 2**21
#: Bounds are lowered by this share: square roots are rounded, and a tie must reach the exact comparison.
SLACK = 1e-9


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of int): floor(scale * x) of the vectors with ``dims`` components, none null or non-finite."""
    v = F.col(vec_col).cast("array<double>")
    fit = (F.size(v) == dims) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    wide = F.exists(v, lambda x: F.abs(x) >= LARGEST)
    whole = F.when(wide, F.raise_error(F.lit(f"components must be under {LARGEST}"))).otherwise(F.transform(v, lambda x: F.floor(x * scale).cast("int")))
    return vectors.filter(F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def starts(points: DataFrame, k: int = CLUSTERS, seed: int = 1) -> np.ndarray:
    """The k vectors whose identifiers have the smallest hashes, in their order; of one identifier's, the smallest vectors come first."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.filter("vec_id is not null").select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def _roots(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1).astype(float))


def pivot_table(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """points with ``p``, the distances to the pivots; written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _roots(_matrix(b.column("v"), np.int64), pivots)
            yield pa.record_batch({"vec_id": b.column("vec_id"), "v": b.column("v"), "p": pa.array(list(d), pa.list_(pa.float64()))})

    return cut(points.mapInArrow(run, "vec_id long, v array<int>, p array<double>"))


def nearest(x: np.ndarray, p: np.ndarray, centroids: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest centroid (ties: smaller number), and how many exact distances that took."""
    bound = np.zeros((len(x), len(centroids)))
    for j in range(p.shape[1]):
        np.maximum(bound, np.abs(p[:, j, None] - to_pivots[None, :, j]) - SLACK * (p[:, j, None] + to_pivots[None, :, j]), out=bound)
    cluster = bound.argmin(axis=1)
    best = ((x - centroids[cluster]) ** 2).sum(axis=1)
    exact, first = len(x), cluster.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= np.sqrt(best.astype(float)) * (1 + SLACK)) & (first != c))
        d = ((x[rows] - centroids[c]) ** 2).sum(axis=1)
        nearer = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
        best[rows[nearer]], cluster[rows[nearer]] = d[nearer], c
        exact += len(rows)
    return cluster, best, exact


def _each(centroids: np.ndarray, pivots: np.ndarray) -> Callable:
    to_pivots = _roots(centroids, pivots)

    def found(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        x = _matrix(b.column("v"), np.int64)
        return (x, *nearest(x, _matrix(b.column("p"), np.float64), centroids, to_pivots))

    return found


def moved(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, int, int]:
    """One round: the centroids' new places, with the exact distances and the rows it took. A task hands on one row a cluster."""
    found, (k, dims) = _each(centroids, pivots), centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, exact = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0
        for b in batches:
            x, cluster, _, n = found(b)
            for c in np.unique(cluster):
                sums[c] += x[cluster == c].sum(axis=0)
            counts += np.bincount(cluster, minlength=k)
            exact += n
        yield pa.record_batch({"cluster": pa.array(range(k), pa.int32()), "n": pa.array(counts), "exact": pa.array([exact] + [0] * (k - 1), pa.int64()), "sums": pa.array(list(sums), pa.list_(pa.int64()))})

    total = F.array(*(F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(dims)))
    parts = table.select("v", "p").mapInArrow(run, "cluster int, n long, exact long, sums array<long>")
    new, exact, rows = centroids.copy(), 0, 0
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("exact").alias("exact"), total.alias("sums")).collect():  # k rows
        exact, rows = exact + r.exact, rows + r.n
        if r.n:
            new[r.cluster] = [int(s) // r.n for s in r.sums]
    return new, exact, rows


def assigned(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    found = _each(centroids, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, cluster, distance, _ = found(b)
            yield pa.record_batch({"vec_id": b.column("vec_id"), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance, pa.int64())})

    return table.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length, or hold a null or non-finite component
    take no part; components of 2^21 or more raise an error, as squared distances would
    not fit a long. Repeated rows take part as often as they occur, and may start two
    equal centroids, of which the smaller number gets all. A null identifier takes part
    but starts no centroid. With fewer vectors than k, there are as many centroids as
    vectors with an identifier; with none, or an empty table, no rows come back. Ties go to the smaller number;
    further columns are ignored. Centroids (k times dims numbers) are all that
    reaches the driver."""
    points = quantised(vectors, id_col, vec_col, dims, scale)
    centroids = pivots = starts(points, k, seed)
    if not len(pivots):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    table = pivot_table(points, pivots)
    for _ in range(rounds):
        centroids, _, _ = moved(table, centroids, pivots)
    out = cut(assigned(table, centroids, pivots))
    sums = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows

    def of_cluster(values: list):
        return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)

    inertias = of_cluster([sums.get(c, 0) for c in range(len(centroids))]).cast("long")
    names = of_cluster([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()])
    return out.select("vec_id", "cluster", "distance", inertias.alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), names.alias("centroid_sha256"))


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _rounds_sql(rounds: int = ROUNDS) -> str:
    """Each round's assignment a<r> and centroids c<r + 1>."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""m{r} AS (SELECT p.r, p.vec_id, any_value(p.v) AS v, min(((p.q + c.q - 2 * list_inner_product(p.v, c.v))::BIGINT * 100 + c.cluster)) AS best
FROM p CROSS JOIN (SELECT *, list_inner_product(v, v) AS q FROM c{r}) c GROUP BY p.r, p.vec_id),
a{r} AS MATERIALIZED (SELECT r, vec_id, v, (best % 100)::INT AS cluster, best // 100 AS distance FROM m{r})""")
        if r < rounds:
            out.append(f"""s{r} AS (SELECT cluster, i, floor(sum(x)::DOUBLE / count(*)) AS x FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT cluster, list(x ORDER BY i) AS v FROM s{r} GROUP BY 1) n USING (cluster))""")
    return ",\n".join(out)


SQL = f"""WITH p AS MATERIALIZED (SELECT *, list_inner_product(v, v) AS q FROM (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIMS})),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM p WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {CLUSTERS})),
{_rounds_sql()}
SELECT vec_id, cluster, distance::BIGINT AS distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} c USING (cluster)"""
