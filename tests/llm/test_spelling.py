import random
import re
import zlib
from collections import Counter

import pytest

from servops.llm import spelling
from . import common


def edits(a, b):
    """Whether one inserted, deleted or replaced code point makes one word the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows, least=5, usual=3, slips=97):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            count[run[:h % len(run)] + run[h % len(run) + 1:] if h % slips == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least and n >= usual}
    near = {w: [v for v in words if v != w and edits(v, w)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else 0) for w, n in words.items())


def found(df, **kw):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0)
                  for r in spelling.spelling_variants(df, **kw).collect())


def texts(seed, n, alphabet="abcé", size=(4, 9)):
    """Texts whose words are close to each other, with very unequal counts."""
    random.seed(seed)
    base = ["".join(random.choice(alphabet) for _ in range(random.randint(*size))) for _ in range(60)]
    rows = []
    for d in range(n):
        words = []
        for _ in range(60):
            w = base[min(int(random.expovariate(0.08)), 59)]
            if random.random() < 0.2:
                k = random.randrange(len(w))
                w = random.choice([w[:k] + w[k + 1:], w[:k] + random.choice(alphabet) + w[k:], w[:k] + random.choice(alphabet) + w[k + 1:]])
            words.append(w.upper() if random.random() < 0.1 else w)
        rows.append((d, random.choice([" ", ", ", "1", "\n"]).join(words)))
    return rows


def frame(spark, rows, clash=False):
    return common.docs(spark, [(d, t, None, None, None) for d, t in rows], clash)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = texts(seed, 60)
    want = brute(rows)
    assert sum(1 for w in want if w[1]) > 20
    assert found(frame(spark, rows)) == want
    assert found(frame(spark, rows), least=1, common=1, slips=7) == brute(rows, 1, 1, 7)


def test_small_cells_and_tiles(spark, monkeypatch):
    """Halves of many words are cut into cells, cells into tiles; every pair is still met once."""
    monkeypatch.setattr(spelling, "BLOCK", 64 * 5)
    monkeypatch.setattr(spelling, "TILE", 3)
    rows = texts(5, 40, alphabet="ab")
    assert found(frame(spark, rows)) == brute(rows)


def test_long_words_and_ties(spark):
    long = "xyz" * 3000
    rows = [(i, f"{long} {long[:-1]} {long}q aaaab aaaac aaaab aaaac aaaad") for i in range(4)] + [(9, f"{long} " * 20)]
    got = found(frame(spark, rows))
    assert got == brute(rows)
    forms = {w: f for w, f, *_ in got}
    assert forms["aaaad"] == "aaaab" and forms[long + "q"] == long  # equal n: the least word


def test_chain_of_forms(spark):
    rows = [(1, " ".join(["words"] * 40 + ["wordt"] * 20 + ["worrt"] * 10 + ["worrtt"] * 5))]
    got = {w: (f, r) for w, f, r, *_ in found(frame(spark, rows), slips=1 << 40)}
    assert got == {"words": ("", "words"), "wordt": ("words", "words"), "worrt": ("wordt", "words"), "worrtt": ("worrt", "words")}


def test_edges(spark):
    rows = [r[:2] for r in common.ROWS]
    assert found(common.docs(spark)) == brute(rows)
    assert found(common.docs(spark), common=1) == brute(rows, usual=1)
    assert found(common.empty(spark)) == []
    # letters outside the class end a run; upper-case letters above ASCII stay as they are
    odd = [(1, "straßeŁabcde ÉCOLEs école×÷ 漢字abcdef"), (None, "ÉCOLEs ÉCOLEs abcde abcde abcdef")]
    assert found(frame(spark, odd, clash=True), common=1) == brute(odd, usual=1)
