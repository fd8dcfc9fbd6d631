import random
import re

import numpy as np
import pyarrow as pa

from servops.llm import linking, near_dedup, textarrays
from servops.llm.components import connected_components
from . import common

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_set(text, width):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w)} if 0 < len(w) < width else set(zip(*(w[k:] for k in range(width))))


def brute(rows, width, percent):
    sets = [brute_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows) if d is not None)


def found(df, **kw):
    got = near_dedup.near_duplicates(df, **kw).collect()
    return got, sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None)


def copies(seed, n_bases, n_copies, words, edits):
    random.seed(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n_bases):
        base = [random.choice(vocab) for _ in range(words)]
        for _ in range(n_copies):
            c = list(base)
            for _ in range(random.randint(0, edits)):
                c[random.randrange(words)] = random.choice(vocab)
            rows.append((len(rows), " ".join(c)))
    return rows


def test_word_hashes_over_piece_ends(monkeypatch):
    texts = ["", "a bb  ccc", "x" * 50, "é ñ\t漢字", "A a", " ", "a " * 40]
    data, off = textarrays.byte_view(pa.array(texts))
    whole = textarrays.word_hashes(data, off, textarrays.NOT_SPACE)
    for piece in (1, 3, 7, 16):
        monkeypatch.setattr(textarrays, "PIECE", piece)
        cut = textarrays.word_hashes(data, off, textarrays.NOT_SPACE)
        for a, b in zip(whole, cut):
            assert (a == b).all()
    h, s, e, first = whole
    words = [bytes(data[a:b]).lower() for a, b in zip(s, e)]
    assert words == [w.lower() for t in texts for w in WORD.findall(t.encode())]
    assert len({x for x in h.tolist()}) == len(set(words))
    assert np.diff(first).tolist() == [len(WORD.findall(t.encode())) for t in texts]


def test_circulant_signature_is_a_shifted_permutation():
    s = np.arange(1, 60, dtype=np.uint64) * np.uint64(0x1234567890ABCDEF)
    once = near_dedup.permute_once(s).astype(object)
    m32 = (1 << 32) - 1

    def second(x):
        w = x * 0x85EBCA6B & m32
        return (w ^ w >> 15) * 0xC2B2AE35 & m32
    got = near_dedup.circulant_signatures([s, s[:1]], 9)
    for k in range(9):
        assert got[0, k] == min(second((x - k) & m32) for x in once)
        assert got[1, k] == second((once[0] - k) & m32)


def test_against_all_pairs(spark):
    rows = copies(1, 30, 6, 60, 8) + [(900, None), (901, ""), (902, "one"), (903, "ONE"), (904, " "), (905, "a b")]
    df = common.docs(spark, [(d, t, None, None, None) for d, t in rows])
    for width, percent in ((2, 80), (5, 80), (1, 90)):
        assert found(df, width=width, percent=percent)[1] == brute(rows, width, percent)


def test_sketch_bytes_tell_coordinates_apart(spark):
    """Unlike documents agree in few sketch bytes, so that few of their pairs are confirmed."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(300)), None, None, None) for i in range(20)]
    got = near_dedup.sign(common.docs(spark, rows), "doc_id", "text", 2, 36, 5).select("sig").collect()
    sigs = np.array([np.frombuffer(r["sig"], np.uint8) for r in got])
    assert max((sigs[i] == sigs[j]).mean() for i in range(20) for j in range(i)) < 0.1


def test_large_buckets_by_blocks(spark, monkeypatch):
    """Copies near the threshold: many pairs of a bucket are no links, classes come from chains."""
    monkeypatch.setattr(linking, "BLOCK", 8)
    rows = copies(4, 2, 70, 80, 14)
    df = common.docs(spark, [(d, t, None, None, None) for d, t in rows], clash=False)
    assert found(df, width=2)[1] == brute(rows, 2, 80)


def test_edges(spark):
    got, three = found(common.docs(spark), width=2)
    assert len(got) == len(common.ROWS)
    assert three == brute([r[:2] for r in common.ROWS], 2, 80)
    kept = {(r["doc_id"], r["n_shingles"]): r["kept"] for r in got}
    assert kept[1, 15] and not kept[2, 15] and not kept[None, 12] and kept[10, 12] and kept[3, 0] and kept[4, 0] and kept[None, 0]
    assert near_dedup.near_duplicates(common.empty(spark)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 90), (90, 95), (7, None), (None, 3)], "x int, y int")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 90, 90: 90, 95: 90}
