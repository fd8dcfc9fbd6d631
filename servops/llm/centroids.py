"""Centroid clustering with a Walsh-Hadamard progressive search (operator 11).

Vectors become whole numbers. The integer Walsh-Hadamard transform of a vector and of the centroids keeps squared
distances, times the number of components, so the search can add up differences of coefficients from coarse to fine
(by sequency): after each band of coefficients, the norms of the rest bound a centroid's distance from both sides,
and one that is strictly worse than another is left out. Those that stay are finished over all coefficients, so
distances and ties are exact.

Only centroids (k rows) and their sums pass the driver, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: whole numbers up to which 64-bit arithmetic holds the distances of transforms; beyond it Python's integers are used
EXACT = 1 << 24


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has ``size`` components, none of them null or non-finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == size) & ~bad, F.lit(False))


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, exactly, for a ``scale`` that is a power of two."""
    with np.errstate(over="ignore"):
        x = np.floor(values * scale)
    if x.size and not np.abs(x).max() < 2.0 ** 62:
        raise ValueError("a component is too large for distances in 64 bits")
    return x.astype(np.int64)


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows of integers, coefficients by sequency."""
    n, size = x.shape
    out = x.copy()
    step = 1
    while step < size:
        pairs = out.reshape(n, size // (2 * step), 2, step)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, size)
        step *= 2
    return out[:, sequency(size)]


def sequency(size: int) -> np.ndarray:
    """Places of the transform's coefficients by the number of sign changes of their basis vector."""
    at = np.arange(size)
    signs = np.array([[bin(i & j).count("1") & 1 for j in at] for i in at])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(1), kind="stable")


def _bands(size: int):
    """(first, end) of coefficients that are added together: 1, 1, 2, 4, ... of them."""
    end = 1
    yield 0, 1
    while end < size:
        yield end, 2 * end
        end *= 2


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of rows of integers; of equally near ones the smallest number.

    The number of components is a power of two.
    """
    n, size = x.shape
    k = len(centers)
    if max(np.abs(x).max(initial=0), np.abs(centers).max(initial=0)) > EXACT:
        x, centers = x.astype(object), centers.astype(object)
    a, b = transform(x), transform(centers)
    part = np.zeros((n, k), a.dtype)
    alive = np.ones((n, k), bool)
    energy_a, energy_b = (a.astype(float) ** 2), (b.astype(float) ** 2)
    rest_a, rest_b = energy_a.sum(1), energy_b.sum(1)
    for lo, hi in _bands(size):
        for c in range(k):
            rows = np.flatnonzero(alive[:, c])
            part[rows, c] += ((a[rows, lo:hi] - b[c, lo:hi]) ** 2).sum(1)
        if hi == size:
            break
        rest_a = np.maximum(rest_a - energy_a[:, lo:hi].sum(1), 0)
        rest_b = np.maximum(rest_b - energy_b[:, lo:hi].sum(1), 0)
        # the rest adds between the squared difference and the squared sum of its norms; the slack covers rounding
        slack = 1e-9 * (energy_a.sum(1)[:, None] + energy_b.sum(1)[None, :]) + 1
        ra, rb = np.sqrt(rest_a)[:, None], np.sqrt(rest_b)[None, :]
        known = part.astype(float)
        upper = np.where(alive, known + (ra + rb) ** 2 + slack, np.inf).min(1)
        alive &= known + (ra - rb) ** 2 - slack <= upper[:, None]
    # those alive have all coefficients; their least sum is the nearest, and argmin takes the smallest number
    most = part.max() + 1 if part.size else 0
    part = np.where(alive, part, most)
    label = part.argmin(1).astype(np.int64)
    total = part[np.arange(n), label]
    return label, total // size


def _matrix(column: pa.Array, size: int, scale: int) -> np.ndarray:
    return whole_numbers(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size), scale)


def _sums(rows: DataFrame, centers: np.ndarray, size: int, scale: int) -> dict:
    """cluster -> (vectors, sums of its components) under ``centers``, summed in each task before the shuffle."""
    k = len(centers)

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, size), object)
        for b in batches:
            x = _matrix(b.column(0), size, scale)
            label, _ = nearest(x, centers)
            count += np.bincount(label, minlength=k)
            for c in range(k):
                total[c] += x[label == c].sum(0)
        held = np.flatnonzero(count)
        for c in held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, c, np.int32)), pa.array(np.arange(size, dtype=np.int32)),
                 pa.array(np.full(size, count[c])), pa.array([int(t) for t in total[c]], pa.decimal128(38, 0))],
                names=["cluster", "at", "n", "total"])
    parts = rows.select("v").mapInArrow(run, "cluster int, at int, n long, total decimal(38,0)")
    out: dict = {}
    for r in parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        n, total = out.setdefault(r["cluster"], (r["n"], [0] * size))
        total[r["at"]] = int(r["total"])
    return out


def seed_centroids(rows: DataFrame, k: int, seed: int, size: int, scale: int) -> np.ndarray:
    """The k vectors with the least sha256 of ``seed:id``, in that order; equal hashes by the vector, nulls last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.select(key.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return whole_numbers(np.array([r["v"] for r in first], float).reshape(-1, size), scale)


def fit(rows: DataFrame, k: int, rounds: int, seed: int, size: int, scale: int) -> np.ndarray:
    """Centroids after ``rounds`` rounds; they end early once a round changes nothing, as all later ones would."""
    centers = seed_centroids(rows, k, seed, size, scale)
    for _ in range(rounds if len(centers) else 0):
        new = centers.copy()
        for c, (n, total) in _sums(rows, centers, size, scale).items():
            new[c] = [t // n for t in total]
        if (new == centers).all():
            break
        centers = new
    return centers


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8,
                    rounds: int = 10, seed: int = 3, size: int = 64, scale: int = 1024) -> DataFrame:
    """``id_col``, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector.

    Usable vectors have ``size`` components (a power of two), none null or non-finite; the others give no row. A
    component x counts as floor(scale * x). Centroids start as the k vectors with the least sha256 of ``seed:id``;
    a null id is the last, equal hashes go by the vector, and fewer than k vectors give as many centroids. Each
    round assigns vectors to the nearest centroid (ties: the smaller number), then a centroid becomes the floor of
    its vectors' mean; empty ones stay. Repeated rows count each. An empty table gives no rows. Distances are exact;
    one that doesn't fit a long fails the query. Other columns aren't read.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    v = F.col(vector_col)
    rows = vectors.where(usable(v, size)).select(F.col(id_col).alias("id"), v.cast("array<double>").alias("v"))
    centers = fit(rows, k, rounds, seed, size, scale)

    def assign(batches):
        for b in batches:
            label, distance = nearest(_matrix(b.column(1), size, scale), centers)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(label.astype(np.int32)), pa.array([int(x) for x in distance], pa.int64())],
                names=["id", "cluster", "distance"])
    assigned = cut_lineage(rows.mapInArrow(assign, f"id {kind}, cluster int, distance long"))
    # k rows: each cluster's sum, the sum of all, the centroid's hash
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    known = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centers[c].tolist())).encode()).hexdigest())
             for c, s in inertia.items()]
    summary = vectors.sparkSession.createDataFrame(
        known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(summary), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
