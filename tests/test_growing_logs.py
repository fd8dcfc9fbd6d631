import datetime as dt
import os
import random
import tempfile

import pytest

from servops.operators import captures as C
from servops.operators import errors as E
from servops.sources import log_tail
from servops.streaming import capture_stream, crash_stream

SENT = "RuntimeError: Server process terminated unexpectedly"
T0 = dt.datetime(2024, 3, 15, 10)


def _scratch():
    return tempfile.mkdtemp(prefix="servops-test-")


def _log(seed, n):
    rng = random.Random(seed)
    what = ["INFO ok é", "Error: x漢", "", "Exception: y", "loading █", "no time here"]
    return [f"INFO 2024-03-15 10:{i // 60 % 60:02d}:{i % 60:02d} {rng.choice(what)} {i}" if rng.random() < 0.9 or not i else SENT + f" {i}" for i in range(n)]


def _drain(df, out, ck):
    (df.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ck)
       .trigger(availableNow=True).start().awaitTermination())


def test_chunked_appends_give_the_crashes_of_the_batch(spark, monkeypatch):
    monkeypatch.setattr(log_tail, "PIECE", 300)
    monkeypatch.setattr(log_tail, "AT_ONCE", 70)
    d = _scratch()
    logs, lines, crashes = (os.path.join(d, x) for x in ("logs", "lines", "crashes"))
    os.makedirs(logs)
    rng = random.Random(7)
    whole = {"a.log": ("\n".join(_log(1, 90)) + "\n").encode(), "b.log": ("\r\n".join(_log(2, 40)) + "\r\nhalf a line").encode()}
    sent = dict.fromkeys(whole, 0)
    for step in range(4):
        for name, text in whole.items():
            # ends anywhere, also inside a character
            more = len(text) if step == 3 else min(len(text), sent[name] + rng.randrange(0, len(text) // 2))
            with open(os.path.join(logs, name), "ab") as f:
                f.write(text[sent[name]:more])
            sent[name] = more
        if step == 1:
            open(os.path.join(logs, "empty.log"), "w").close()
        source = log_tail.stream_growing_logs(spark, logs)
        _drain(source, lines, os.path.join(d, "ck1"))
        _drain(crash_stream.live_crashes(source, 60 * 24), crashes, os.path.join(d, "ck2"))
    got = {}
    for r in spark.read.parquet(lines).collect():
        got.setdefault(os.path.basename(r.run_id), []).append((r.line_no, r.line))
    for name, text in whole.items():
        want, at = [], 0
        for line in text.split(b"\n")[:-1]:
            want.append((at, line.removesuffix(b"\r").decode()))
            at += len(line) + 1
        assert sorted(got[name]) == want
    batch = E.crash_buffers(spark.read.parquet(lines)).collect()
    live = crash_stream.final_crashes(spark.read.parquet(crashes)).where("not at_end").collect()
    assert sorted((r.run_id, r.line_no, r.crash_no, r.buffer) for r in live) == sorted((r.run_id, r.line_no, r.crash_no, r.buffer) for r in batch)
    assert len(batch) > 5


def test_offsets_hold_back_a_line_that_is_being_written():
    d = _scratch()
    path = os.path.join(d, "a.log")
    with open(path, "wb") as f:
        f.write(b"one\ntwo\nthr")
    reader = log_tail._TailReader(d)
    first = reader.latestOffset()
    assert first["files"].endswith(': 8}')
    assert [(at, x) for p in reader.partitions(reader.initialOffset(), first)
            for b in reader.read(p) for at, x in zip(b.column(1).to_pylist(), b.column(4).to_pylist())] == [(0, "one"), (4, "two")]
    assert reader.latestOffset() == first and reader.partitions(first, first) == []
    with open(path, "ab") as f:
        f.write(b"ee\n")
    again = log_tail._TailReader(d)  # as after a restart
    second = again.latestOffset()
    assert [x for p in again.partitions(first, second) for b in again.read(p) for x in b.column(4).to_pylist()] == ["three"]
    with open(path, "wb") as f:
        f.write(b"new\n")
    with pytest.raises(ValueError, match="shorter"):
        again.partitions(second, again.latestOffset())
    assert log_tail._TailReader(os.path.join(d, "none")).latestOffset() == {"files": "{}"}


def test_new_lines_of_captures():
    new = C.new_lines
    assert new([], ["a", "b"]) == ["a", "b"] and new(["a", "b"], ["a", "b"]) == [] and new(["a"], []) == []
    assert new(["a", "b", "c"], ["b", "c", "d"]) == ["d"] and new(["a", "b"], ["x", "y"]) == ["x", "y"]
    assert new(["a", "b", "10%"], ["a", "b", "20%"]) == ["20%"]  # a line on the screen has changed
    assert new(["x", "x"], ["x", "x", "x"]) == ["x"]  # the longest overlap: the fewest new lines
    assert C.complete_lines(None) == [] and C.complete_lines("a\nb") == ["a"]


def _captures(seed, n, window):
    """Captures of a screen of ``window`` lines at random moments, some of them inside a line; and the lines."""
    rng = random.Random(seed)
    lines = _log(seed, n)
    text = "\n".join(lines) + "\n"
    cuts = sorted(rng.sample(range(1, len(text)), 25)) + [len(text)]
    shots = ["\n".join(text[:c].split("\n")[-window - 1:]) for c in cuts]
    return [(seed, k * 3, T0 + dt.timedelta(minutes=k), s) for k, s in enumerate(shots)], lines


CAPTURES = "run_id int, seq long, ts timestamp_ntz, content string"


def test_captures_give_the_lines_and_crashes_of_the_log(spark):
    shots, logs = [], {}
    for seed, window in ((1, 1000), (2, 40), (3, 30)):
        rows, logs[seed] = _captures(seed, 150, window)
        shots += rows
    shots.append((4, 1, T0, None))
    df = spark.createDataFrame(shots, CAPTURES)
    batch = C.capture_lines(df, block=16)
    got = {}
    for r in batch.collect():
        got.setdefault(r.run_id, []).append((r.line_no, r.line))
    assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == logs
    assert all([n for n, _ in sorted(v)] == list(range(len(v))) for v in got.values())
    plain = spark.createDataFrame([(k, n, T0, x) for k, v in logs.items() for n, x in enumerate(v)],
                                  "run_id int, line_no long, ts timestamp_ntz, line string")
    crashes = sorted((r.run_id, r.line_no, r.buffer) for r in E.crash_buffers(plain).collect())
    assert sorted((r.run_id, r.line_no, r.buffer) for r in E.crash_buffers(batch).collect()) == crashes and len(crashes) > 10
    # as a stream, in two parts
    d = _scratch()
    src = spark.readStream.schema(CAPTURES).parquet(os.path.join(d, "in", "*"))
    for k, part in enumerate((df.where("seq < 30"), df.where("seq >= 27"))):  # some come twice
        part.coalesce(1).write.parquet(os.path.join(d, "in", f"p{k}"))
        _drain(capture_stream.stream_capture_lines(src), os.path.join(d, "out"), os.path.join(d, "ck"))
    live = {(r.run_id, r.line_no): r.line for r in spark.read.parquet(os.path.join(d, "out")).collect()}
    assert live == {(k, n): x for k, v in logs.items() for n, x in enumerate(v)}
    assert C.capture_lines(df.limit(0)).count() == 0
