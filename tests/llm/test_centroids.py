import hashlib
import random

import numpy as np
import pytest

from servops.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v string, cluster string, distance string, inertia string, h string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "x", "x", "x", "x", "x") for i, v in rows], SCHEMA)


def brute(rows, k, rounds, size, scale=1024, seed=3):
    """Plain k-means in Python's integers."""
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [v for _, v in first[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds if kept else 0):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centers = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centers)]
    got = [(i, *near(v)) for i, v in kept]
    each = {j: sum(d for _, d, c in got if c == j) for _, _, j in got}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, j, d, each[j], sum(each.values()), sha[j]) for i, d, j in got), key=str)


def found(df, **kw):
    return sorted((tuple(r) for r in centroids.cluster_vectors(df, **kw).collect()), key=str)


def test_transform_keeps_distances_and_orders_by_sequency():
    rng = np.random.default_rng(1)
    x, y = rng.integers(-5000, 5000, (2, 40, 64))
    a, b = centroids.transform(x), centroids.transform(y)
    assert (((a - b) ** 2).sum(1) == 64 * ((x - y) ** 2).sum(1)).all()
    basis = centroids.transform(np.eye(64, dtype=np.int64))
    assert [int((basis[1:, c] != basis[:-1, c]).sum()) for c in range(64)] == list(range(64))


@pytest.mark.parametrize("top", [3, 5000, 1 << 23, 1 << 28])
def test_nearest_is_exact_with_ties(top):
    rng = np.random.default_rng(top)
    x = rng.integers(-top, top + 1, (300, 16))
    c = np.concatenate([rng.integers(-top, top + 1, (5, 16)), x[:2], x[:1]])
    label, distance = centroids.nearest(x, c)
    plain = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)), j) for j, w in enumerate(c)) for v in x]
    assert [(int(d), int(j)) for d, j in zip(distance, label)] == plain
    assert label[0] == 5  # equal to centroids 5 and 7: the smaller number


def test_against_plain_k_means(spark):
    random.seed(3)
    rows = [(i, [random.gauss(i % 5, 1) for _ in range(16)]) for i in range(400)]
    assert found(frame(spark, rows), size=16) == brute(rows, 8, 10, 16)
    assert found(frame(spark, rows), size=16, k=3, rounds=1) == brute(rows, 3, 1, 16)


def test_large_and_tiny_components(spark):
    rows = [(i, [20000.0 * (i % 3), -1e-9, 0.0, float(i)]) for i in range(30)]
    assert found(frame(spark, rows), size=4, k=4) == brute(rows, 4, 10, 4)
    with pytest.raises(Exception, match="too large"):
        found(frame(spark, [(1, [1e300, 0.0, 0.0, 0.0]), (2, [0.0] * 4)]), size=4)


def test_edges(spark):
    one = [0.5, -0.25, 0.0, 1.0]
    bad = [(1, None), (2, []), (3, [1.0] * 3), (4, [1.0, None, 1.0, 1.0]), (5, [1.0, float("nan"), 0.0, 0.0]), (6, [float("inf")] + one[1:])]
    rows = bad + [(7, one), (7, one), (8, one), (None, [9.0] * 4), (9, [2.0] * 4)]
    assert found(frame(spark, rows), size=4, k=3) == brute(rows, 3, 10, 4)
    # fewer vectors than centroids, repeated rows, a null id
    assert found(frame(spark, rows), size=4) == brute(rows, 8, 10, 4)
    assert found(frame(spark, bad), size=4) == []
    assert found(frame(spark, []), size=4) == []
