import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

from servops.llm import sharding
from . import common


def check(rows, got, shards):
    """Every row once, slots gapless, sizes and checksums of the whole texts."""
    assert len(got) == len(rows)
    key = lambda x: (x[0] is not None, x)
    want = sorted(((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=lambda x: (x[0] is not None, x[0] or 0, x[1:])) == want
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and key
    return Counter({k: sum(r["size"] for r in got if r["shard"] == k) for k in range(shards)})


def test_balance_with_a_hot_group(spark):
    rows = [(i, f"text number {i} " * (1 + i * 31 % 40), None, None, None) for i in range(1500)] + \
           [(2000 + i, "the same text again " * 12, None, None, None) for i in range(900)] + \
           [(4000 + i, f"pair {i // 2} " * 30, None, None, None) for i in range(200)]
    got = sharding.assign_shards(common.docs(spark, rows), 8).collect()
    sizes = check(rows, got, 8)
    assert max(sizes.values()) <= 1.03 * sum(sizes.values()) / 8
    count = Counter(r["shard"] for r in got)
    assert max(count.values()) <= 1.35 * len(rows) / 8
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
    assert [k for k, v in where.items() if len(v) > 1] == [zlib.crc32(("the same text again " * 12).encode())]  # larger than a shard


def test_dot_product_with_residual_capacity():
    v = np.array([[4.0, 0], [0, 4.0], [4.0, 0], [0, 4.0]])
    assert sharding.pack(v, 2, np.ones(2)).tolist() == [0, 0, 1, 1]
    assert sharding.pack(np.zeros((3, 2)), 2, np.ones(2)).tolist() == [0, 0, 0]
    assert sharding.pack(np.zeros((0, 3)), 4, np.ones(3)).tolist() == []


def slow_shards(rows, shards, fine):
    """Shard of each row (id, text, hash of the text, hash for its piece), in loops and with exact fractions."""
    sizes = [(len((text or "").encode()) + 8, len((text or "").split()), 1) for _, text, *_ in rows]
    total = [max(sum(s[k] for s in sizes), 1) for k in range(3)]
    groups = defaultdict(lambda: [0, 0, 0])
    for (_, _, grp, _), s in zip(rows, sizes):
        groups[grp] = [a + b for a, b in zip(groups[grp], s)]
    share = {g: max(Fraction(a * shards, t) for a, t in zip(v, total)) for g, v in groups.items()}
    items, vectors = [], defaultdict(lambda: [0, 0, 0])
    for (_, _, grp, piece), s in zip(rows, sizes):
        if share[grp] <= Fraction(1, fine):
            item = False, grp % (shards * fine), 0
        else:
            item = True, grp, piece % math.ceil(2 * share[grp]) if share[grp] > 1 else 0
        items.append(item)
        vectors[item] = [a + b for a, b in zip(vectors[item], s)]
    part = {i: [Fraction(a * shards, t) for a, t in zip(v, total)] for i, v in vectors.items()}
    left = [[Fraction(1)] * 3 for _ in range(shards)]
    where = {}
    for item in sorted(part, key=lambda i: (-max(part[i]), i)):
        v = part[item]
        gain = [int(sharding.BYTES_WEIGHT) * v[0] * r[0] + v[1] * r[1] + v[2] * r[2] for r in left]
        where[item] = gain.index(max(gain))
        left[where[item]] = [a - b for a, b in zip(left[where[item]], v)]
    return [where[i] for i in items], items


def test_against_a_plain_version(spark):
    rng = random.Random(11)
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 60))), None, None, None) for i in range(500)]
    rows += [(1000 + i, "copies of one text " * 9, None, None, None) for i in range(260)]
    rows += [(2000 + i, rng.choice([None, "", "a copy " * 40]), None, None, None) for i in range(60)]
    df = common.docs(spark, rows)
    hashed = {r["doc_id"]: r for r in df.selectExpr("doc_id", "text", "xxhash64(text) g", "xxhash64(doc_id, 17) p").collect()}
    plain = [(i, text, hashed[i]["g"], hashed[i]["p"]) for i, text, *_ in rows]
    for shards, fine in ((6, 256), (6, 8), (1, 4), (24, 2)):
        got = sharding.assign_shards(df, shards, fine=fine).collect()
        check(rows, got, shards)
        want, items = slow_shards(plain, shards, fine)
        assert {r["doc_id"]: r["shard"] for r in got} == {p[0]: w for p, w in zip(plain, want)}, (shards, fine)
        if (shards, fine) == (6, 8):
            assert {alone for alone, *_ in items} == {False, True} and len({p for alone, _, p in items if alone}) > 1


def test_edges(spark):
    check(common.ROWS, sharding.assign_shards(common.docs(spark), 3).collect(), 3)
    check(common.ROWS, sharding.assign_shards(common.docs(spark), 24).collect(), 24)
    assert sharding.assign_shards(common.empty(spark), 24).count() == 0
    again = [sorted((str(r) for r in sharding.assign_shards(common.docs(spark).repartition(n), 5).collect())) for n in (1, 6)]
    assert again[0] == again[1]
