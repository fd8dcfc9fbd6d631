import datetime as dt
import random
import re

import pytest

from servops.functions import patterns as P
from servops.operators import errors as E
from servops.operators import literals, ordering
from tests.test_errors import CAT, SENT, T0, _brute_hits, _catalog, _lines


def test_required_literals():
    assert P.required_literals(r"abc\d+def") == ["abc", "def"]
    assert P.required_literals(r"a(?P<n>bc)d(?:x|y)e") == ["abcd", "e"]
    assert P.required_literals(re.escape("worker (1) died: 50%")) == ["worker (1) died: 50%"]
    assert P.required_literals(r"(?:abc)*x?") == [] and P.required_literals(r"ab\b(?=c)cd") == ["abcd"]


def test_line_reach():
    for p, n in ((r"died\nValue", 1), (r"a\s+b", P.UNBOUNDED), (r"a\sb\sc", 2), (r"a(?:\nx|b){1,3}", 3), (r"(a\n)\1", 2), ("a[^b]c", 1),
                 (r"^a\nb", P.UNBOUNDED), (r"(?s)a..b", 2), (r"(?s:a.)b.", 1), (r"a\nb$", P.UNBOUNDED), (r"a(?=\n)", P.UNBOUNDED), (r"a\D{4}", 4)):
        assert P.line_reach(p) == n, p


def test_windows_stay_inside_their_text():
    texts = ["abcdefg", "", "abc", "xabcdef", "ABCdefG", "abcdéfgh", "abcdefgabcdefg", "KKeyword", "kkeywor"]
    owner, gram = literals.window_hashes(texts)
    got = {}
    for o, g in zip(owner.tolist(), gram.tolist()):
        got.setdefault(o, []).append(g)
    want = {i: {f[k:k + 6] for k in range(len(f) - 5) if f[k:k + 6].isascii()} for i, f in enumerate(map(literals.folded, texts))}
    assert {i: len(g) for i, g in got.items()} == {i: len(w) for i, w in want.items() if w}
    for i, ws in want.items():
        assert len(set(got.get(i, []))) == len(ws)
    assert set(got[0]) == set(got[4]) and set(got[0]) <= set(got[6]) and set(got[8]) <= set(got[7])


def test_patterns_by_their_literals(spark):
    """Many patterns against lines that hold some of them, in any case, with characters that fold to ASCII letters."""
    rng = random.Random(5)
    words = ["worker", "Kernel", "shard", "timeout", "größe", "sſl", "token", "x"]
    lines = [" ".join(rng.choice(words) for _ in range(6)) + f" error {i % 70}" for i in range(300)]
    lines += [l.upper() for l in lines[:40]] + ["Kernel panic error", "ſhard worker error"]
    patterns = [re.escape(l[:40]) for l in lines[::3]] + ["kernel panic", "shard worker", r"w\w+r \w+t", "error 6[0-9]", "x x x", "(?i:TIMEOUT) (shard|token) worker"]
    table = spark.createDataFrame(list(enumerate(patterns)), "id long, pattern string")
    kept = literals.with_window(table)
    with_one = {r["id"] for r in kept.collect()}
    got = {(r["line"], r["error_id"]) for r in literals.lines_with(spark.createDataFrame([(l,) for l in lines], "line string"), kept).collect()}
    assert got == {(l, i) for l in lines for i, p in enumerate(patterns) if i in with_one and re.search(p, l, re.IGNORECASE)}
    assert set(range(len(patterns))) - with_one == {patterns.index(r"w\w+r \w+t"), patterns.index("x x x")}


def test_neighbouring_lines_in_blocks(spark, monkeypatch):
    """One run with most lines, cut into small blocks: hits over line ends are those of the whole buffers."""
    monkeypatch.setattr(ordering.with_neighbour, "__defaults__", (True, None, 8))
    rng = random.Random(2)
    rows = [(1, n, rng.choice(["Error: a", "Exception: b", "info", "Error: c c", "Error x"])) for n in range(0, 600, 2)]
    rows += [(1, n, SENT) for n in range(301, 600, 100)] + [(2, 1, "Error: a"), (2, 50, "Exception: b"), (3, 4, "Error: a"), (3, 9, SENT)]
    cat = [(1, r"a\nException: b\nError: c"), (2, r"c c\nError x\n(?:Error: a|Exception: b)\nError x"), (3, r"a\nException: b"), (4, r"b\n$"),
           (5, r"x[^z]E"), (6, r"terminated unexpectedly\nError"), (7, "a\n" * 17)]
    def no_buffers(*a, **k):
        raise AssertionError("buffers were built")
    got = E.match_known_errors(_lines(spark, rows), _catalog(spark, *cat))
    assert sorted((r.run_id, r.line_no, r.error_id, r.at_end) for r in got.collect()) == _brute_hits(rows, cat)
    monkeypatch.setattr(E, "_buffers", no_buffers)
    cat = [c for c in cat if c[0] not in (4, 7)]
    got = E.match_known_errors(_lines(spark, rows), _catalog(spark, *cat))
    assert sorted((r.run_id, r.line_no, r.error_id, r.at_end) for r in got.collect()) == _brute_hits(rows, cat)


@pytest.mark.parametrize("name", ["known_error_match", "new_error_mining", "error_occurrences", "error_ranking"])
def test_registered_queries_build_no_buffers(spark, monkeypatch, name):
    from servops.plans.queries import QUERIES

    def no_buffers(*a, **k):
        raise AssertionError("buffers were built")
    monkeypatch.setattr(E, "_buffers", no_buffers)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_empty_catalog_and_empty_log(spark):
    none = spark.createDataFrame([], CAT)
    log = spark.createDataFrame([(1, 1, T0 + dt.timedelta(seconds=1), "Error: x")], "run_id long, line_no long, ts timestamp_ntz, line string")
    assert E.match_known_errors(log, none).count() == 0
    assert E.match_known_errors(log.limit(0), _catalog(spark, (1, "Error: x\n"), (2, "Error: xyz"))).count() == 0
