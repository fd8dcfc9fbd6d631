import datetime as dt
import os
import tempfile

from servops.operators import errors as E
from servops.operators.gpu import latest_per_gpu, parse_gpu_samples
from servops.operators.usage import usage_rollup
from servops.sources import fixtures as fx
from servops.streaming import crash_stream, gpu_stream, usage_stream

SF = "/root/testdata/sf0.001"


def _scratch():
    return tempfile.mkdtemp(prefix="servops-test-")


def test_live_usage_equals_batch(spark):
    d = _scratch()
    gens = fx.generations(spark, SF).select("model_id", "tokens_generated", "time_taken", "generated_at")
    a, b = gens.randomSplit([0.5, 0.5], seed=3)
    a.write.parquet(os.path.join(d, "src", "p1"))
    df = usage_stream.live_usage(spark, os.path.join(d, "src", "*"))
    out, ck = os.path.join(d, "out"), os.path.join(d, "ck")
    usage_stream.start_to_parquet(df, out, ck, {"availableNow": True}).awaitTermination()
    first = usage_stream.current_totals(spark, out).count()
    b.write.parquet(os.path.join(d, "src", "p2"))
    usage_stream.start_to_parquet(df, out, ck, {"availableNow": True}).awaitTermination()
    assert first > 0
    last = {r.model_id: r for r in usage_stream.current_totals(spark, out).collect()}
    exp = {r.model_id: r for r in usage_rollup(gens).collect()}
    assert set(last) == set(exp)
    for k, r in exp.items():
        assert last[k].generations_count == r.generations_count
        assert last[k].tokens_generated_count == r.tokens_generated_count
        assert abs(last[k].avg_tokens_per_second - r.avg_tokens_per_second) < 1e-9


def test_live_crashes_equal_batch(spark):
    d = _scratch()
    lines = fx.log_lines(spark, SF)
    early, late = lines.where("line_no < 500"), lines.where("line_no >= 500")
    early.write.parquet(os.path.join(d, "logs", "p1"))
    schema = "run_id long, line_no long, ts timestamp_ntz, line string"
    src = spark.readStream.schema(schema).parquet(os.path.join(d, "logs", "*"))
    # fixture runs log a line every few days: keep runs open across the 30-day span
    live = crash_stream.live_crashes(src, idle_minutes=45 * 24 * 60)

    out = os.path.join(d, "out")

    def run():
        q = (live.writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
        q.awaitTermination()
    run()
    late.write.parquet(os.path.join(d, "logs", "p2"))
    run()
    rows = crash_stream.final_crashes(spark.read.parquet(out))
    got = sorted((r.run_id, r.line_no, r.crash_no, r.buffer) for r in rows.collect() if not r.at_end)
    exp = sorted((r.run_id, r.line_no, r.crash_no, r.buffer) for r in E.crash_buffers(lines).collect())
    assert got == exp and len(got) > 0


def _days(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(r, n, t0 + dt.timedelta(minutes=m), l) for r, n, m, l in rows],
                                 "run_id long, line_no long, ts timestamp_ntz, line string")


def test_late_lines_and_runs_that_end_without_a_crash(spark):
    d = _scratch()
    sent = "RuntimeError: Server process terminated unexpectedly"
    parts = [[(1, 2, 2, "Error: b"), (1, 4, 4, sent), (2, 1, 1, "Error: only")],
             [(1, 1, 1, "Error: a"), (1, 3, 3, "Exception: late"), (1, 6, 6, sent)],  # out of order, inside the watermark
             [(3, 1, 500, "Error: much later")], [(3, 2, 501, "Error: x")], [(3, 3, 2000, "Error: y")], [(3, 4, 2001, "Error: z")]]
    src = spark.readStream.schema("run_id long, line_no long, ts timestamp_ntz, line string").parquet(os.path.join(d, "logs", "*"))
    live = crash_stream.live_crashes(src, idle_minutes=30)
    out = os.path.join(d, "out")
    for k, rows in enumerate(parts):
        _days(spark, rows).coalesce(1).write.parquet(os.path.join(d, "logs", f"p{k}"))
        (live.writeStream.outputMode("append").format("parquet").option("path", out)
             .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start().awaitTermination())
    lines = _days(spark, [r for p in parts for r in p if r[0] < 3])
    got = crash_stream.final_crashes(spark.read.parquet(out)).where("run_id < 3").collect()
    exp = sorted((r.run_id, r.line_no, r.crash_no, r.buffer) for r in E.crash_buffers(lines).collect())
    assert sorted((r.run_id, r.line_no, r.crash_no, r.buffer) for r in got if not r.at_end) == exp and len(exp) == 2
    assert [(r.run_id, r.line_no, r.buffer) for r in got if r.at_end] == [(2, 1, "Error: only\n")]


def test_log_files_as_a_stream(spark):
    d = _scratch()
    os.makedirs(os.path.join(d, "logs"))
    with open(os.path.join(d, "logs", "a.log"), "w") as f:
        f.write("INFO 03-15 10:00:00 ok\nERROR 2024-03-15 10:00:05 Error: x\nRuntimeError: Server process terminated unexpectedly\n")
    df = crash_stream.stream_engine_logs(spark, os.path.join(d, "logs"))
    out = os.path.join(d, "out")
    (crash_stream.live_crashes(df, 30).writeStream.outputMode("append").format("parquet").option("path", out)
     .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start().awaitTermination())
    got = spark.read.parquet(out).collect()
    assert [(r.line_no, r.buffer) for r in got] == [
        (2, "ERROR 2024-03-15 10:00:05 Error: x\nRuntimeError: Server process terminated unexpectedly\n")]


def test_live_gpu_latest(spark):
    d = _scratch()
    src = os.path.join(d, "csv")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("".join(f"0, NVIDIA A0, 40, {u}, 100, 200, 50, 300\n" for u in (55, 90, 70, 10)) +
                "1, NVIDIA A1, 40, 1, 100, 200, 50, 300\n1, NVIDIA A1, 40, 20, 100, 200, 50, 300\n")
    df = gpu_stream.live_gpu_latest(spark, src)
    q = (df.writeStream.outputMode("update").format("memory").queryName("gpus")
         .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.gpu_index: r.utilization for r in spark.sql("select * from gpus").collect()}
    assert got == {0: 10.0, 1: 20.0}


def test_crash_alerts_mine_once_across_epochs(spark):
    d = _scratch()
    lines = fx.log_lines(spark, SF)
    lines.where("line_no < 500").write.parquet(os.path.join(d, "logs", "p1"))
    schema = "run_id long, line_no long, ts timestamp_ntz, line string"
    src = spark.readStream.schema(schema).parquet(os.path.join(d, "logs", "*"))
    live = crash_stream.live_crashes(src, idle_minutes=45 * 24 * 60)
    hits, mined = os.path.join(d, "hits"), os.path.join(d, "mined")
    handler = crash_stream.alert_batch(fx.error_catalog(spark), hits, mined)

    def run():
        (live.writeStream.foreachBatch(handler).option("checkpointLocation", os.path.join(d, "ck"))
             .trigger(availableNow=True).start().awaitTermination())
    run()
    lines.where("line_no >= 500").write.parquet(os.path.join(d, "logs", "p2"))
    run()
    m = spark.read.parquet(mined).collect()
    h = spark.read.parquet(hits).collect()
    assert len({r.epoch for r in m} | {r.epoch for r in h}) >= 2
    # each pattern mined once, ids unique and after the catalog's
    pats = [r.error_pattern.lower() for r in m]
    assert len(pats) == len(set(pats)) and len(pats) > 0
    ids = [r.id for r in m]
    assert len(ids) == len(set(ids)) and min(ids) > 3
    # every crash is either a hit or was the source of a mined entry, across both epochs
    all_crashes = {(r.run_id, r.line_no) for r in E.crash_buffers(lines).collect()}
    covered = {(r.run_id, r.line_no) for r in h}
    assert covered <= all_crashes
    # batch set form: crashes matching nothing known become hits of mined entries later or mined themselves
    first = {(r.first_run_id, r.first_line_no) for r in m}
    assert all_crashes <= covered | first | _unmatched_same_batch(spark, lines, m, covered)


def _unmatched_same_batch(spark, lines, mined_rows, covered):
    # crashes deduplicated into a pattern mined in the same epoch are neither hits nor the first source
    crashes = E.crash_buffers(lines).collect()
    import re as _re
    out = set()
    for c in crashes:
        if (c.run_id, c.line_no) in covered:
            continue
        if any(_re.search(r.error_pattern, c.buffer, _re.IGNORECASE) for r in mined_rows):
            out.add((c.run_id, c.line_no))
    return out


def test_late_lines_change_hits_and_withdraw_mined_errors(spark):
    d = _scratch()
    sent = "RuntimeError: Server process terminated unexpectedly"
    parts = [[(1, 4, 4, sent), (2, 1, 1, "Error: known one"), (2, 5, 5, sent), (3, 9, 6, sent + " new")],
             [(1, 1, 1, "Error: known one"), (2, 2, 2, "Exception: second known"), (2, 8, 8, sent)]]  # late lines
    catalog = spark.createDataFrame([(1, "known one", "m1", "s"), (2, "second known", "m2", "s")],
                                    "id int, error_pattern string, error_message string, solution string")
    src = spark.readStream.schema("run_id long, line_no long, ts timestamp_ntz, line string").parquet(os.path.join(d, "logs", "*"))
    hits, mined = os.path.join(d, "hits"), os.path.join(d, "mined")
    handler = crash_stream.alert_batch(catalog, hits, mined)
    for k, rows in enumerate(parts):
        _days(spark, rows).coalesce(1).write.parquet(os.path.join(d, "logs", f"p{k}"))
        (crash_stream.live_crashes(src, 30).writeStream.foreachBatch(handler).option("checkpointLocation", os.path.join(d, "ck"))
             .trigger(availableNow=True).start().awaitTermination())
    lines = _days(spark, [r for p in parts for r in p])
    now = sorted((r.run_id, r.line_no, r.error_id) for r in crash_stream.current_hits(spark, hits).collect() if r.error_id <= 2)
    assert now == sorted((r.run_id, r.line_no, r.error_id) for r in E.match_known_errors(lines, catalog).collect())
    assert now == [(1, 4, 1), (2, 5, 1), (2, 5, 2), (2, 8, 1), (2, 8, 2)]
    everything = {r.error_message for r in spark.read.parquet(mined).collect()}
    left = {r.error_message for r in crash_stream.current_new_errors(spark, catalog, hits, mined).collect()}
    assert len(everything) == 2 and left == {m for m in everything if m.endswith("new")}


def test_live_processes_replace_the_list(spark):
    d = _scratch()
    polls = [("a", "0, 11, python, 100\n0, 12, x/y, 5\n1, 13, z, 7\n"), ("b", "0, 21, q, 1\nbad line\n"),
             ("a", "0, 12, x/y, 6\n\n1, 14, w, nan-ish\n"), ("b", "\n"), ("a", "0, 12, x/y, 8\n")]
    want = [[("a", 0, 11, 100.0), ("a", 0, 12, 5.0), ("a", 1, 13, 7.0)], [("b", 0, 21, 1.0)],
            [("a", 0, 12, 6.0), ("a", 1, 14, None)], [], [("a", 0, 12, 8.0)]]
    src = os.path.join(d, "polls")
    for h in "ab":
        os.makedirs(os.path.join(src, h))
    live = gpu_stream.live_gpu_processes(spark, os.path.join(src, "*"))
    now = {}
    for k, (host, text) in enumerate(polls):
        file = os.path.join(src, host, f"{k}.csv")
        with open(file, "w") as f:
            f.write(text)
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))
        live.writeStream.outputMode("complete").format("memory").queryName("procs").option(
            "checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start().awaitTermination()
        now[host] = want[k]
        from servops.operators.gpu import latest_processes
        batch = latest_processes(gpu_stream.process_polls(spark.read, os.path.join(src, "*")))
        for df in (spark.table("procs"), batch):
            got = sorted((r.host[-1], r.gpu_id, r.pid, r.memory_usage) for r in df.collect())
            assert got == sorted(x for rows in now.values() for x in rows), k


def test_totals_are_read_from_a_bounded_number_of_files(spark):
    d = _scratch()
    src, out = os.path.join(d, "src"), os.path.join(d, "out")
    read = {}
    for k in range(8):
        rows = [(k % 3, 10 * k + 1, 1.0, None), (7, 1, 0.5, None)]
        spark.createDataFrame(rows, usage_stream.GENERATION_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        usage_stream.start_to_parquet(usage_stream.live_usage(spark, src), out, os.path.join(d, "ck"), {"availableNow": True},
                                      every=2).awaitTermination()
        now = usage_stream.current_totals(spark, out)
        want = usage_stream.usage_rollup(spark.read.schema(usage_stream.GENERATION_SCHEMA).parquet(src))
        assert sorted(map(tuple, now.select(*want.columns).collect())) == sorted(map(tuple, want.collect())), k
        read[k] = {f.split("/out/")[1].rsplit("/", 1)[0] for f in now.inputFiles()}
    assert max(len(x) for k, x in read.items() if k > 3) <= 3
