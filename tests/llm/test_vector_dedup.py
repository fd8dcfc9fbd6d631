import math
import random

import numpy as np
import pytest

from servops.llm import vector_dedup

SCHEMA = "vec_id long, embedding array<double>, label int, id string, node string, one string, v string, leaf string, d string, weight string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y) + ("x",) * 7 for i, v, y in rows], SCHEMA)


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def cos(x, y):
    big = max(map(abs, x)), max(map(abs, y))
    x, y = [a / big[0] for a in x], [a / big[1] for a in y]
    return math.fsum(a * b for a, b in zip(x, y)) / math.sqrt(math.fsum(a * a for a in x) * math.fsum(b * b for b in y))


def brute(rows, threshold=0.98):
    linked = [[j for j, s in enumerate(rows) if j != i and r[2] is not None and r[2] == s[2] and good(r[1]) and good(s[1])
               and len(r[1]) == len(s[1]) and (r[1] == s[1] or cos(r[1], s[1]) >= threshold)] for i, r in enumerate(rows)]
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((r[0], len(linked[i]), least, least == r[0]))
    return sorted(out, key=str)


def found(df, **kw):
    return sorted((tuple(r) for r in vector_dedup.near_vectors(df, **kw).collect()), key=str)


def vectors(seed, n, dims, labels=3, spread=0.05):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    rows = []
    for i in range(n):
        c = rng.choice(centers)
        s = rng.choice([spread, spread * 3, 0.0])
        rows.append((i, [x + rng.gauss(0, s) for x in c], rng.randrange(labels)))
    return rows


@pytest.mark.parametrize("dims", [2, 8, 9, 64])
def test_against_all_pairs(spark, dims):
    rows = vectors(dims, 300, dims)
    want = brute(rows)
    assert 0 < sum(r[1] for r in want) and {r[3] for r in want} == {True, False}
    assert found(frame(spark, rows)) == want


def test_many_leaves_and_tiles(spark, monkeypatch):
    """Small leaves and tiles: pairs across leaves are met once, leaves far apart not at all."""
    monkeypatch.setattr(vector_dedup, "LEAF", 16 * 20)
    monkeypatch.setattr(vector_dedup, "TILE", 7)
    rows = vectors(4, 400, 16, labels=2, spread=0.1)
    assert found(frame(spark, rows)) == brute(rows)


def test_leaves_are_bounded_and_far_ones_never_meet(spark):
    rows = [(k, 0, 4, [0.1] * (vector_dedup.AXES + 1)) for k in range(100)] \
        + [(1000 + k, 1, 4, [k / 100] + [0.0] * vector_dedup.AXES) for k in range(100)]
    placed = vector_dedup.leaves(spark.createDataFrame(rows, "node long, label int, d int, c array<double>"), 4 * 10).collect()
    size = {}
    for r in placed:
        size[r["label"], r["leaf"]] = size.get((r["label"], r["leaf"]), 0) + 1
    assert len(placed) == 200 and max(size.values()) <= 10  # equal coordinates are halved by hash
    frame_ = spark.createDataFrame(placed)
    met = vector_dedup.meeting_leaves(frame_, 0.98).where("label = 1").count()
    n = sum(1 for key in size if key[0] == 1)
    assert n <= met < n * (n + 1) // 2


def test_chain_and_threshold(spark):
    turn = math.acos(0.981)
    rows = [(i, [math.cos(i * turn), math.sin(i * turn)], 5) for i in range(20)]
    got = found(frame(spark, rows))
    assert got == brute(rows) and all(r[2] == 0 for r in got) and max(r[1] for r in got) == 2
    turn = math.acos(0.9799)
    rows = [(i, [math.cos(i * turn), math.sin(i * turn)], 5) for i in range(10)]
    assert all(r[1] == 0 and r[3] for r in found(frame(spark, rows)))


def test_tile_stops_early_and_keeps_all():
    rng = np.random.default_rng(2)
    x = vector_dedup.units(rng.normal(size=(200, 40)) + rng.normal(size=(200, 1)) * 3)
    rest = np.stack([np.sqrt((x[:, end:] ** 2).sum(1)) for end in range(8, 48, 8)], 1)
    for t in (0.5, 0.9, 0.99):
        rows, cols, product = vector_dedup.linked_in_tile(x, x, rest, rest, t)
        plain = x @ x.T
        assert set(zip(*np.nonzero(plain >= t))) <= set(zip(rows.tolist(), cols.tolist()))
        assert np.allclose(product, plain[rows, cols]) and (product >= t - 1e-8).all()


def test_edges(spark):
    v = [0.5, 0.25, -1.0]
    rows = [(1, v, 1), (1, v, 1), (2, v, 1), (3, v, None), (4, v, 2), (None, v, 1), (5, None, 1), (5, None, 1), (6, [], 1), (7, [0.0] * 3, 1),
            (8, [0.0] * 3, 1), (9, [1.0, None, 2.0], 1), (10, [1.0, float("nan"), 2.0], 1), (11, [1.0, float("inf"), 2.0], 1),
            (12, v + [0.0], 1), (13, [1e200 * x for x in v], 1), (14, [1e-200 * x for x in v], 1), (15, [-x for x in v], 1),
            (None, None, None), (None, [1.0], 9), (0, [2.0], 9)]
    assert found(frame(spark, rows)) == brute(rows)
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(1, None, None)])) == [(1, 0, 1, True)]
