import datetime as dt
import re

import pytest

from servops.functions import patterns as P
from servops.operators import errors as E

LINES = "run_id long, line_no long, ts timestamp_ntz, line string"
CAT = "id int, error_pattern string, error_message string, solution string, initial_count long, first_seen timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)
SENT = "RuntimeError: Server process terminated unexpectedly"


def _lines(spark, rows):
    return spark.createDataFrame([(r, n, T0 + dt.timedelta(seconds=n), l) for r, n, l in rows], LINES)


def _catalog(spark, *patterns):
    return spark.createDataFrame([(i, p, f"m{i}", "s", 0, T0) for i, p in patterns], CAT)


def _brute_buffers(rows):
    """(run, line, buffer, at_end): every crash's lines so far, and all lines of runs without a crash."""
    out, buf, crashed, last = [], {}, set(), {}
    for r, n, l in sorted(rows, key=lambda x: (x[0], x[1])):
        low = l.lower()
        if "error" in low or "exception" in low or "terminated" in low:
            buf[r] = buf.get(r, "") + l + "\n"
            last[r] = n
            if SENT in l:
                out.append((r, n, buf[r], False))
                crashed.add(r)
    return sorted(out + [(r, last[r], b, True) for r, b in buf.items() if r not in crashed])


def _brute_hits(rows, patterns):
    out = []
    for r, n, b, end in _brute_buffers(rows):
        for i, p in patterns:
            try:
                if re.search(p, b, re.IGNORECASE):
                    out.append((r, n, i, end))
            except re.error:
                pass
    return sorted(out)


def test_buffer_is_cumulative(spark):
    rows = [(1, 1, "CUDA error (code 2)"), (1, 2, "info"), (1, 3, SENT + " 1"), (1, 4, "Exception: late"),
            (1, 5, SENT + " 2"), (2, 6, SENT + " 3"), (2, 7, "trailing Error: x")]
    got = sorted((r.run_id, r.line_no, r.buffer, False) for r in E.crash_buffers(_lines(spark, rows)).collect())
    assert got == _brute_buffers(rows)
    c = {r.line_no: (r.crash_no, r.n_lines) for r in E.crash_buffers(_lines(spark, rows)).collect()}
    assert c == {3: (1, 2), 5: (2, 4), 6: (1, 1)}


def test_buffers_match_brute_force_on_fixture(spark):
    from servops.sources import fixtures as fx
    lines = fx.log_lines(spark, "/root/testdata/sf0.001")
    rows = [(r.run_id, r.line_no, r.line) for r in lines.collect()]
    got = sorted((r.run_id, r.line_no, r.buffer, False) for r in E.crash_buffers(lines).collect())
    assert got == [b for b in _brute_buffers(rows) if not b[3]]


def test_which_patterns_stay_inside_a_line():
    for p in ("abc", r"a.*b", r"(?P<n>x)\w+ (?P=n)", r"\bx\b", "a|b", "[a-z0-9]+?", r"\S+", re.escape("a b (c) [d] 1.5"), "(?:ab){2,3}"):
        assert P.line_local(p), p
    for p in ("^a", "a$", r"a\sb", "a[^b]c", r"a\nb", r"\D", r"\W", "(?s)a.b", "(?m)^a", "(?=a)b", r"a\Z", "[\\x00-z]", r"\B", "(?s:a.)"):
        assert not P.line_local(p), p
    assert P.compiled("a(b") is None and P.compiled(r"\p{L}+") is None and P.compiled(None) is None


PATTERNS = [(1, r"cuda error \(code [0-3]\)"), (2, "RUNTIMEERROR"), (3, "worker 9"), (4, "(?P<n>worker) 1"), (5, "a(b"),
            (6, r"^\w+ kaputt error"), (7, r"died\nRuntime"), (8, r"\Aexception"), (9, r"größe \w+ten"), (11, None)]


def test_hits_are_those_of_python(spark):
    rows = [(1, 1, "RuntimeError: CUDA ERROR (code 1): oom"), (1, 2, SENT + " with code 9"),
            (2, 3, "Exception: worker 1 died"), (2, 4, SENT + " (x) [y] 1.5"), (2, 5, "Über kaputt error"), (2, 6, SENT),
            (3, 7, SENT + " (x) [y] 1.5"), (4, 8, "Über kaputt error"), (4, 9, "Error: Größe überschritten"), (5, 10, "all fine")]
    got = E.match_known_errors(_lines(spark, rows), _catalog(spark, *PATTERNS)).collect()
    want = _brute_hits(rows, [p for p in PATTERNS if p[1]])
    assert sorted((r.run_id, r.line_no, r.error_id, r.at_end) for r in got) == want
    assert (4, 9, 9, True) in want and (4, 9, 6, True) in want  # a run without a crash is matched at its end
    assert {r.error_message for r in got if r.error_id == 4} == {"m4"}


def test_hits_on_fixture(spark):
    from servops.sources import fixtures as fx
    lines = fx.log_lines(spark, "/root/testdata/sf0.001")
    cat = fx.error_catalog(spark)
    rows = [(r.run_id, r.line_no, r.line) for r in lines.collect()]
    got = sorted((r.run_id, r.line_no, r.error_id, r.at_end) for r in E.match_known_errors(lines, cat).collect())
    assert got == _brute_hits(rows, [(r.id, r.error_pattern) for r in cat.collect()])


def test_a_run_with_most_lines(spark):
    rows = [(1, n, f"Error: value {n % 50}" if n % 97 else SENT) for n in range(3000)] + [(2, 5000, "Error: value 3")]
    patterns = [(1, "value 7$"), (2, "value 4[0-3]"), (3, "value 99"), (4, r"value 9\nError: value 10")]
    got = E.match_known_errors(_lines(spark, rows), _catalog(spark, *patterns)).collect()
    assert sorted((r.run_id, r.line_no, r.error_id, r.at_end) for r in got) == _brute_hits(rows, patterns)


def test_mining_by_time_with_ids_after_the_whole_catalog(spark):
    rows = [(1, 50, "Exception: worker 1 died"), (1, 51, SENT + " (x) [y] 1.5"), (2, 3, SENT + " (x) [y] 1.5"), (3, 1, "Error: a")]
    lines = spark.createDataFrame([(r, n, T0 + dt.timedelta(days=-r, seconds=n), l) for r, n, l in rows], LINES)
    job = E.ErrorJob(lines, _catalog(spark, (3, "nothing"), (9, "a(b")))
    mined = job.mined.collect()
    msg = "Server process terminated unexpectedly (x) [y] 1.5"
    assert [(m.id, m.error_pattern, m.first_run_id, m.first_line_no, m.n_crashes) for m in mined] == [(10, re.escape(msg), 2, 3, 2)]
    assert mined[0].first_seen == T0 + dt.timedelta(days=-2, seconds=3)
    # known errors only at the end of a run without a crash: nothing is mined from run 3
    none = E.ErrorJob(lines, _catalog(spark, (1, "terminated")))
    assert none.mined.count() == 0


def test_message_is_the_first_capture_so_far(spark):
    rows = [(1, 1, "ValueError: first"), (1, 2, SENT + " one"), (1, 3, "RuntimeError: later"), (1, 4, SENT + " two"),
            (2, 5, "RuntimeError: earlier"), (2, 6, SENT)]
    job = E.ErrorJob(_lines(spark, rows), _catalog(spark))
    got = {m.error_message: m.n_crashes for m in job.mined.collect()}
    assert got == {"Server process terminated unexpectedly one": 2, "earlier": 1}
    by_text = E.messages_of_buffers(E.crash_buffers(_lines(spark, rows))).collect()
    by_line = E.messages_of_segments(job.segments, job.unmatched).collect()
    assert sorted(map(tuple, by_text)) == sorted(map(tuple, by_line))


def test_occurrences(spark):
    rows = [(1, 1, "CUDA error (code 1)"), (1, 2, SENT), (2, 3, SENT), (3, 4, "boom Error: zzz"), (3, 5, SENT), (4, 6, "cuda error (code 2)")]
    cat = spark.createDataFrame([(1, r"cuda error \(code [0-3]\)", "cuda", "s", 5, T0), (2, "a(b", "bad", "s", 7, T0),
                                 (4, "never", "n", "s", 0, T0)], CAT)
    occ = {r.id: r for r in E.ErrorJob(_lines(spark, rows), cat).occurrences().collect()}
    # one crash and one end of a run on top of the stored count
    assert occ[1].occurrence_count == 7 and occ[1].last_seen == T0 + dt.timedelta(seconds=6)
    # entries that Python refuses or that never match stay in the list
    assert (occ[2].occurrence_count, occ[2].last_seen) == (7, None) and occ[4].occurrence_count == 0
    # the mined entry counts the crashes that matched nothing known (runs 2 and 3), not run 1's
    assert [(r.error_pattern, r.occurrence_count) for r in occ.values() if r.id > 4] == \
        [(re.escape("Server process terminated unexpectedly"), 2)]
    ranked = [r.id for r in E.error_ranking(E.ErrorJob(_lines(spark, rows), cat).occurrences()).collect()]
    assert ranked == [1, 2, 5, 4]


@pytest.mark.parametrize("most", [1, 3])
def test_catalog_in_slices(spark, monkeypatch, most):
    rows = [(1, 1, "Error: value 7 here"), (1, 2, SENT), (2, 3, SENT)]
    patterns = [(i, f"value {i}\\b") for i in range(9)] + [(20, "a(b"), (21, r"here\nRuntime")]
    monkeypatch.setattr(E, "MAX_PATTERNS", most)
    got = E.match_known_errors(_lines(spark, rows), _catalog(spark, *patterns)).collect()
    assert sorted((r.run_id, r.line_no, r.error_id, r.at_end) for r in got) == _brute_hits(rows, patterns)
