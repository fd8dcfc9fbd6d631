import datetime as dt

from servops.operators import logs as L

LINES = "run_id long, line_no long, ts timestamp_ntz, line string"
T0 = dt.datetime(2024, 1, 1)


def _lines(spark, rows):
    return spark.createDataFrame([(r, n, T0 + dt.timedelta(seconds=s), l) for r, n, s, l in rows], LINES)


def test_classes_drop_blank(spark):
    df = _lines(spark, [(1, 1, 0, "  \t"), (1, 2, 1, "Loading: 50%|██|"),
                        (1, 3, 2, "RuntimeError: Server process terminated unexpectedly"),
                        (1, 4, 3, "vLLM server exited with code 0"), (1, 5, 4, "some Exception here"),
                        (1, 6, 5, "hello")])
    got = {r.line_no: r.line_class for r in L.classify_lines(df).collect()}
    assert got == {2: "progress", 3: "crash", 4: "exit", 5: "error", 6: "output"}


def test_progress_collapse_keeps_last_of_each_run(spark):
    df = _lines(spark, [(1, 1, 0, "a"), (1, 2, 1, "10%|█|"), (1, 3, 2, "   "), (1, 4, 3, "20%|██|"),
                        (1, 5, 4, "b"), (1, 6, 5, "x|▌"), (2, 7, 6, "50%|▏|")])
    got = sorted(r.line_no for r in L.progress_collapse(df).collect())
    assert got == [1, 4, 5, 6, 7]


def test_progress_collapse_spans_blocks(spark):
    # many lines: the block-parallel numbering must chain across blocks
    rows = [(1, i, i, "p%|█" if i % 3 else "text") for i in range(1, 300)]
    df = _lines(spark, rows)
    got = sorted(r.line_no for r in L.progress_collapse(df).collect())
    exp = [n for (_, n, _, l), nxt in zip(rows, rows[1:] + [None])
           if not ("|" in l and "█" in l and nxt is not None and "|" in nxt[3] and "█" in nxt[3])]
    assert got == exp


def test_state_timeline_stop_wins(spark):
    df = _lines(spark, [(1, 1, 0, "Server is running"), (1, 2, 1, "Server is running"),
                        (1, 3, 2, "Server started successfully but Server stopped"), (1, 4, 3, "nothing")])
    got = [(r.line_no, r.state, r.changed) for r in L.server_state_timeline(df).orderBy("line_no").collect()]
    assert got == [(1, "running", True), (2, "running", False), (3, "stopped", True)]


def test_live_state_timeline_last_writer_wins(spark):
    rows = [(1, 1, '{"type": "output", "data": "Server is running"}'), (1, 2, '{"type": "status", "data": {"running": true}}'),
            (1, 3, '{"type": "status", "data": {"running": false}}'), (1, 4, '{"type": "progress", "data": "Server is running"}'),
            (1, 5, "Server is running"), (1, 6, '{"type": "output", "data": "Server started successfully"}'),
            (1, 7, '{"type": "status", "data": {}}'), (1, 8, '{"type": "error", "data": {"message": "Server is running"}}'),
            (2, 9, '{"type": "pong"}'), (2, 10, '{"type": "status", "data": {"running": 0}}'), (2, 11, None),
            (1, 1 << 20, '{"type": "output", "data": "Server is running but Server stopped"}')]
    msgs = spark.createDataFrame(rows, "run_id long, msg_id long, message string")
    got = sorted((r.run_id, r.msg_id, r.source, r.state, r.changed) for r in L.live_state_timeline(msgs).collect())
    assert got == [(1, 1, "output", "running", True), (1, 2, "status", "running", False), (1, 3, "status", "stopped", True),
                   (1, 6, "output", "running", True), (1, 7, "status", "stopped", True), (1, 1 << 20, "output", "stopped", False),
                   (2, 10, "status", "stopped", True)]


def test_concurrency_truncates_and_last_wins(spark):
    df = _lines(spark, [(1, 1, 0, "INFO x Maximum concurrency for 4096 tokens per request: 17.93x"),
                        (1, 2, 1, "INFO x Maximum concurrency for 4096 tokens per request: 3.2x"),
                        (2, 3, 2, "INFO x Maximum concurrency for 2048 tokens per request: 9.99x")])
    runs = spark.createDataFrame([(1, 100), (2, 200)], "run_id long, model_id int")
    models = spark.createDataFrame([(100, "a", None), (200, "b", 4)], "id int, model_name string, max_batch_size int")
    got = {r.id: (r.parsed_concurrency, r.max_batch_size) for r in L.max_batch_backfill(df, runs, models).collect()}
    assert got == {100: (3, 3), 200: (9, 4)}


def test_concurrency_of_several_runs(spark):
    line = "INFO x Maximum concurrency for 4096 tokens per request: "
    df = _lines(spark, [(1, 50, 10, line + "4.0x"), (1, 60, 20, line + "5.0x"), (2, 1, 86400, line + "9.0x"),
                        (3, 1, 5, line + "99999999999999.0x"), (3, 2, 6, line + "1.2.3x")])
    runs = spark.createDataFrame([(1, 100), (2, 100), (3, 100)], "run_id long, model_id int")
    models = spark.createDataFrame([(100, "a", None)], "id int, model_name string, max_batch_size int")
    # the earliest run with a value decides, its last line wins, whatever the line numbers of other runs
    assert [r.max_batch_size for r in L.max_batch_backfill(df, runs, models).collect()] == [5]


def test_run_health_precedence_and_tail(spark):
    df = _lines(spark, [(1, 1, 0, "CUDA error old"), (1, 2, 1, "ok"), (1, 3, 2, "ok"),
                        (2, 4, 0, "Press Enter to close this session"), (2, 5, 1, "RuntimeError: x"),
                        (3, 6, 0, "Press Enter to close this session"), (4, 7, 0, "fine")])
    got = {r.run_id: (r.status, r.errors_found) for r in L.run_health(df, tail=2).collect()}
    assert got[1] == ("running", "")        # the CUDA line fell out of the tail
    assert got[2] == ("error", "RuntimeError, Error:")  # substring test: "Error:" fires inside "RuntimeError:"
    assert got[3] == ("waiting", "") and got[4] == ("running", "")


def test_run_duration_text(spark):
    df = _lines(spark, [(1, 1, 0, "a"), (1, 2, 3725, "b"), (2, 3, 0, "a"), (2, 4, 59, "b"), (3, 5, 0, "a"),
                        (3, 6, 3600, "b")])
    got = {r.run_id: r.uptime for r in L.run_duration(df).collect()}
    assert got == {1: "1h 2m 5s", 2: "59s", 3: "1h 0s"}


def test_log_tail_newest_and_zero(spark):
    df = _lines(spark, [(1, i, i, f"l{i}") for i in range(10)] + [(2, 100 + i, i, f"m{i}") for i in range(5)])
    assert [r.line_no for r in L.log_tail(df, 3).collect()] == [102, 103, 104]
    assert L.log_tail(df, 0).count() == 0


def test_message_routes(spark):
    msgs = spark.createDataFrame([(1, '{"type": "pong"}'), (2, '{"type": "output", "data": "hi"}'),
                                  (3, "bare text"), (4, '{"type": "progress", "data": "5%|█|"}'),
                                  (5, '{"type": "error", "data": {"known": true, "message": "boom"}}'),
                                  (6, '{"type": "other"}'), (7, "123"), (8, "[1]"), (9, '"x"'), (10, "null"),
                                  (11, "{broken")], "msg_id long, message string")
    got = {r.msg_id: (r.route, r.body) for r in L.message_routes(msgs).collect()}
    assert got == {2: ("output", "hi"), 3: ("text", "bare text"), 4: ("progress", "5%|█|"),
                   5: ("error", "boom"), 6: ("ignored", None), 7: ("ignored", None), 8: ("ignored", None),
                   9: ("ignored", None), 10: ("ignored", None), 11: ("text", "{broken")}


def test_unescape_keeps_every_line(spark):
    df = _lines(spark, [(1, 1, 0, "plain"), (1, 2, 1, "a \\u2588 b"), (1, 3, 2, "")])
    assert {r.line_no: r.text for r in L.log_unescape(df).collect()} == {1: "plain", 2: "a █ b", 3: ""}


def test_run_health_over_block_ends(spark):
    rows = [(1, n, n, "CUDA error") for n in range(65_530, 65_536)] + [(1, n, n, "fine") for n in range(65_536, 65_540)]
    df = _lines(spark, rows)
    assert [(r.status, r.n_lines) for r in L.run_health(df, tail=4).collect()] == [("running", 4)]
    assert [(r.status, r.n_lines) for r in L.run_health(df, tail=5).collect()] == [("error", 5)]
