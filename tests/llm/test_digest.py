import hashlib

import numpy as np

from servops.llm import digest
from . import common


def plain_counts(raw):
    out = [0] * digest.BUCKETS
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        out[int(digest._T0[a]) ^ int(digest._T1[b]) ^ int(digest._T2[c])] += 1
    return out


def test_buckets_quartiles_and_text_form():
    raw = "the quick brown fox, äöü 漢字".encode() * 7
    counts = plain_counts(raw)
    assert digest.bucket_counts(np.frombuffer(raw, np.uint8)).tolist() == counts
    codes = digest.codes_of(raw)
    ranked = sorted(counts)
    assert codes[:256].tolist() == [sum(c > ranked[k * 64 - 1] for k in (1, 2, 3)) for c in counts]
    assert (digest.digest_codes(digest.digest_text(codes)) == codes).all()
    big = bytes(range(256)) * 9000  # over several pieces
    assert digest.bucket_counts(np.frombuffer(big, np.uint8)).sum() == len(big) - 2


def test_likeness_is_bounded_and_falls_with_edits():
    a = digest.codes_of(common.LONG.encode())
    b = digest.codes_of(common.LONG[:150_000].encode())
    c = digest.codes_of(("xyz%" * 9000).encode())
    assert digest.likeness(a, a) == 1.0
    assert 0 <= digest.likeness(a, c) < digest.likeness(a, b) <= 1
    empty = digest.codes_of(b"")
    assert digest.likeness(empty, empty) == 1.0 and digest.length_code(0) == 0 and digest.length_code(10 ** 12) == 255


def brute(rows):
    """rows (id, text, tie) in the operator's order -> its result."""
    out = []
    for k, (i, text, _) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(text)
        e = text[:n - n // 3] + following[:n // 3]
        f, g, h = (digest.codes_of(t.encode()) for t in (text, e, following))
        out.append((i, n, hashlib.sha256(e.encode()).hexdigest(), digest.digest_text(f), digest.digest_text(g),
                    digest.likeness(f, g), digest.likeness(f, h)))
    return out


def test_next_document_over_many_ranges(spark):
    rows = [(i, f"text {i * 7919 % 101} " * (i % 13), None, None, None) for i in range(300)]
    df = common.docs(spark, rows, clash=False).repartition(7)
    want = brute([(r[0], r[1], 0) for r in sorted(rows, reverse=True)])
    got = [tuple(r) for r in digest.compare_with_next(df).collect()]
    assert sorted(got) == sorted(want)


def test_edges(spark):
    df = common.docs(spark)
    ties = {(r[0], r[1]): r[2] for r in df.selectExpr("doc_id", "text", "xxhash64(text)").collect()}
    rows = sorted([(r[0], r[1] or "", ties[r[0], r[1]]) for r in common.ROWS],
                  key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted([tuple(r) for r in digest.compare_with_next(df).collect()], key=key) == sorted(brute(rows), key=key)
    one = digest.compare_with_next(df.where("doc_id = 9").limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert digest.compare_with_next(common.empty(spark)).count() == 0
    prints = {r["text"]: r["fingerprint"] for r in digest.fingerprint(df).collect()}
    assert prints[None] == prints[""] and len(prints[""]) == 130
