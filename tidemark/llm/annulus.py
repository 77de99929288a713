"""Centroid clustering by annulus search over integer vectors.

A round sorts the centroids by norm. For every vector the exact distance to one likely centroid (the nearest in a few directions
along which the centroids spread most) is an upper bound: whatever is nearer, or as near, has a norm that differs from the
vector's by no more than it. Binary searches find that annulus of centroids and only those are compared, exactly, in integers.

A round is one pass over the vectors, whose sums by cluster are added up within each task before they are shuffled. What the
driver holds is the centroids, k of them; nothing is kept of a vector between rounds, so a lost task is simply run again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Centroids, components, rounds, the factor before components are rounded down, and the prefix of the seeds' hashes.
K, DIM, ROUNDS, SCALE, SALT = 40, 64, 5, 256, "2"
#: Directions of the likely centroid, pairs of vector and candidate that are compared at a time, and the largest component that squared distances allow.
DIRECTIONS, PAIRS, LARGEST = 8, 1 << 15, 1 << 26


class Annuli:
    """Centroids (rows of integers) sorted by norm."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        norm = np.sqrt((centroids.astype(float) ** 2).sum(axis=1))
        self.order = np.argsort(norm, kind="stable")
        self.norms = norm[self.order]
        exact = centroids.astype(float)
        self.middle = exact.mean(axis=0)
        self.axes = np.linalg.svd(exact - self.middle, full_matrices=False)[2][:DIRECTIONS].T
        self.spread = (exact - self.middle) @ self.axes

    def likely(self, x: np.ndarray) -> np.ndarray:
        """A centroid for each vector that is probably near; it decides how wide the annulus is, not what is found."""
        flat = (x - self.middle) @ self.axes
        return np.argmin((self.spread**2).sum(axis=1) - 2 * flat @ self.spread.T, axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid of each vector (ties: the smaller number), its squared distance, and how many pairs were compared."""
        guess = self.likely(x)
        best = ((x - self.centroids[guess]) ** 2).sum(axis=1)
        norm, bound = np.sqrt((x.astype(float) ** 2).sum(axis=1)), np.sqrt(best.astype(float))
        slack = 1e-9 * (norm + bound + 1)  # rounding widens the annulus and never narrows it
        low = np.searchsorted(self.norms, norm - bound - slack, "left")
        high = np.searchsorted(self.norms, norm + bound + slack, "right")
        number, count = guess.copy(), high - low
        upto = np.cumsum(count)
        a = 0
        while a < len(x):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
            c = count[a:b]
            row = np.repeat(np.arange(a, b), c)
            first = np.cumsum(c) - c
            which = self.order[np.arange(len(row)) - np.repeat(first - low[a:b], c)]
            d = ((x[row] - self.centroids[which]) ** 2).sum(axis=1)
            best[a:b] = np.minimum.reduceat(d, first)
            tied = np.where(d == np.repeat(best[a:b], c), which, len(self.centroids))
            number[a:b] = np.minimum.reduceat(tied, first)
            a = b
        return number, best, int(upto[-1]) if len(x) else 0


def integers(column: pa.Array, dim: int = DIM, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have `dim` components, none null or non-finite, and their components times scale, rounded down, as integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets, flat = np.asarray(column.offsets), column.values
    size, valid = np.diff(offsets), np.asarray(column.is_valid())
    x = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")), dtype=float)
    at = np.flatnonzero(valid & (size == dim))
    v = x[offsets[at][:, None] + np.arange(dim)]
    fine = np.isfinite(v).all(axis=1)
    v = np.floor(scale * v[fine])
    if v.size and np.abs(v).max() > LARGEST:
        raise OverflowError(f"components times {scale} beyond {LARGEST}: squared distances would not fit 64 bits")
    return at[fine], v.astype(np.int64)


def seeds(vectors: DataFrame, k: int, dim: int, scale: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of `salt:vec_id`, in that order, as integers. Rows of a null id are no seeds; equal ids go by their components."""
    def quantised(batches):
        for b in batches:
            at, v = integers(b.column("embedding"), dim, scale)
            yield pa.RecordBatch.from_arrays([b.column("h").take(pa.array(at)), pa.array(list(v), pa.list_(pa.int64()))], ["h", "v"])

    # few rows hash low, but which of them are fit to be kept is not known before: so all go by, k of them come back
    hashed = vectors.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"), "embedding")
    first = hashed.mapInArrow(quantised, "h string, v array<bigint>").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in first], dtype=np.int64).reshape(len(first), dim)


def cluster(vectors: DataFrame, k: int = K, dim: int = DIM, rounds: int = ROUNDS, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector of `dim` components, none null or non-finite.

    vectors has vec_id and embedding. Components count as floor(scale * x). A round assigns every vector to its nearest centroid (ties: the smaller number)
    and sets every centroid that has vectors to their mean, rounded down; after the last one vectors are assigned once more.

    Null, short, long and non-finite vectors take no part and give no rows; a null vec_id takes part but is no seed; repeated rows each count; with fewer
    than k vectors there are as many centroids; without any there are no rows; extra columns are ignored. Components beyond LARGEST / scale are an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    centroids = seeds(rows, k, dim, scale, salt)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)

    def sums(at: np.ndarray) -> list:
        """(cluster, vectors, sum of distances, sums of components) under these centroids: at most k rows."""
        def partial(batches):
            annuli, n, far, total = Annuli(at), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(at.shape, np.int64)
            for b in batches:
                _, x = integers(b.column("embedding"), dim, scale)
                number, distance, _ = annuli.nearest(x)
                np.add.at(n, number, 1)
                np.add.at(far, number, distance)
                np.add.at(total, number, x)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(far[some]), *[pa.array(total[some, i]) for i in range(dim)]], ["cluster", "n", "far", *[f"s{i}" for i in range(dim)]])

        parts = rows.select("embedding").mapInArrow(partial, "cluster int, n long, far long, " + ", ".join(f"s{i} long" for i in range(dim)))
        return parts.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in ("n", "far", *[f"s{i}" for i in range(dim)])]).collect()

    for _ in range(rounds):
        moved = centroids.copy()
        for r in sums(centroids):
            moved[r.cluster] = [r[3 + i] // r.n for i in range(dim)]
        centroids = moved
    final = centroids
    inertia = {r.cluster: r.far for r in sums(final)}
    total = sum(inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]

    def assign(batches):
        annuli = Annuli(final)
        for b in batches:
            at, x = integers(b.column("embedding"), dim, scale)
            number, distance, _ = annuli.nearest(x)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(pa.array(at)), pa.array(number.astype(np.int32)), pa.array(distance), pa.array([inertia[c] for c in number.tolist()], pa.int64()),
                    pa.array([total] * len(at), pa.int64()), pa.array([digest[c] for c in number.tolist()], pa.string()),
                ],
                ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return rows.mapInArrow(assign, schema)


def annulus_sql(table: str, k: int = K, dim: int = DIM, rounds: int = ROUNDS, scale: int = SCALE, salt: str = SALT) -> str:
    """The same rows as DuckDB SQL, every distance computed. Rows of one id must not differ."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM {table}"
        f" WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS cluster, v FROM (SELECT sha256('{salt}:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        distance = "list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, min((d, cluster)) AS m FROM (SELECT rid, cluster, {distance} AS d FROM kept, c{r} c) GROUP BY rid)")
        if r < rounds:
            means = f"SELECT cluster, list(m ORDER BY i) AS v FROM (SELECT m[2] AS cluster, i, floor(sum(v[i])::HUGEINT // count(*)) - (CASE WHEN sum(v[i]) < 0 AND sum(v[i]) % count(*) <> 0 THEN 1 ELSE 0 END) AS m FROM kept JOIN a{r} USING (rid), (SELECT unnest(range(1, {dim + 1})) AS i) GROUP BY ALL) GROUP BY cluster"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.v::BIGINT[], c.v) AS v FROM c{r} c LEFT JOIN ({means}) n USING (cluster))")
    return (
        "WITH " + ", ".join(steps) + f" SELECT vec_id, m[2] AS cluster, m[1] AS distance, sum(m[1]) OVER (PARTITION BY m[2])::BIGINT AS cluster_inertia, sum(m[1]) OVER ()::BIGINT AS inertia,"
        f" sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM kept JOIN a{rounds} USING (rid) JOIN c{rounds} c ON c.cluster = m[2]"
    )
