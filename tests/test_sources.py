import datetime as dt
import os
import tempfile

from servops.sources.engine_logs import read_engine_logs


def test_engine_log_order_across_splits_and_packed_files(spark):
    d = tempfile.mkdtemp(prefix="servops-logs-")
    expected = {}
    for f, n in [("a.log", 400), ("b.log", 7), ("c.log", 250)]:
        lines = [f"{f} line {i:05d}" + "x" * (i % 13) for i in range(n)]
        with open(os.path.join(d, f), "w") as h:
            h.write("\n".join(lines) + "\n")
        expected[f] = lines
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # many splits, small files packed together
    try:
        df = read_engine_logs(spark, d)
        assert df.rdd.getNumPartitions() > 3
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {}
    for r in sorted(rows, key=lambda r: (r.run_id, r.line_no)):
        got.setdefault(os.path.basename(r.run_id), []).append(r.line)
    assert got == expected
    for name, lines in expected.items():  # numbered from 0 without gaps
        assert sorted(r.line_no for r in rows if r.run_id.endswith(name)) == list(range(len(lines)))


def test_line_times_give_a_run_its_duration(spark):
    from servops.operators.logs import run_duration
    d = tempfile.mkdtemp(prefix="servops-logs-")
    with open(os.path.join(d, "a.log"), "w") as h:
        h.write("INFO 2024-03-15 10:00:00 start\nINFO 2024-03-15 11:02:03 end\n")
    assert [r.uptime for r in run_duration(read_engine_logs(spark, d)).collect()] == ["1h 2m 3s"]


def test_api_log_files_and_sinks(spark):
    from pyspark.sql import functions as F

    from servops.sources import api_log, sinks
    d = tempfile.mkdtemp(prefix="servops-api-")
    with open(os.path.join(d, "api_20240101.log"), "w") as h:
        h.write("2024-01-01 10:00:00,123 - api - INFO - Request: GET http://h:8000/api/models?x=1\n"
                "2024-01-01 10:00:00,200 - api - INFO - Response: 200\n"
                "not a log line\n"
                "2024-01-01 10:00:01,000 - api - ERROR - Response: 500\n")
    parsed = api_log.parse_lines(api_log.read_api_log(spark, os.path.join(d, "*.log")))
    got = {(r.kind, r.method, r.path, r.status): r.n_lines for r in api_log.summarize(parsed).collect()}
    assert got == {("request", "GET", "/api/models", None): 1, ("response", None, None, 200): 1,
                   ("response", None, None, 500): 1, ("unparsed", None, None, None): 1}


def test_appended_tables_read_back_and_retries_add_nothing(spark):
    from pyspark.sql import functions as F

    from servops.sources import sinks, tables
    d = tempfile.mkdtemp(prefix="servops-sinks-")
    gens = spark.createDataFrame([(1, 5, 0.5, "2024-01-01 10:00:00"), (2, 3, 0.0, "2024-01-02 09:00:00")],
                                 "model_id int, tokens_generated int, time_taken double, generated_at string") \
        .withColumn("generated_at", F.to_timestamp_ntz("generated_at"))
    out = os.path.join(d, "gens")
    for batch in ("a", "b", "b", "a"):
        sinks.append_generations(gens, out, batch, ["generated_at", "model_id"])
    back = tables.read_generations(spark, out)
    rows = back.collect()
    assert len(rows) == 4 and len({r.id for r in rows}) == 4
    assert sorted(str(r.gen_date) for r in rows) == ["2024-01-01"] * 2 + ["2024-01-02"] * 2
    assert back.where("gen_date = '2024-01-02'").count() == 2 and "batch" not in back.columns
    models = spark.createDataFrame([(1, "m", "/p", 1)], "id int, model_name string, model_path string, max_model_len int")
    errors = spark.createDataFrame([(1, "p", "m", "s", None)], "id int, error_pattern string, error_message string, solution string, first_seen timestamp_ntz")
    for batch in ("x", "x", "y"):
        sinks.append_models(models, os.path.join(d, "models"), batch)
        sinks.append_errors(errors, os.path.join(d, "errors"), batch)
    assert [(r.id, r.model_path, r.max_batch_size) for r in tables.read_models(spark, os.path.join(d, "models")).collect()] == [(1, "/p", None)] * 2
    assert [r.initial_count for r in tables.read_errors(spark, os.path.join(d, "errors")).collect()] == [0, 0]
    sinks.write_json(sinks.to_json_lines(models), os.path.join(d, "json"))
    assert spark.read.json(os.path.join(d, "json")).count() == 1


def test_lines_without_a_time_have_that_of_the_line_before(spark):
    d = tempfile.mkdtemp(prefix="servops-logs-")
    want = {}
    for f, n in [("a.log", 300), ("b.log", 5), ("c.log", 200)]:
        last, lines = None, []
        for i in range(n):
            if i % 41 == 3:
                last = dt.datetime(2024, 3, 15, 10, i // 60, i % 60)
                lines.append((f"ERROR 2024-03-15 10:{i // 60:02d}:{i % 60:02d} {f} {i}", last))
            else:
                lines.append((f"  File {f}, line {i}" + "x" * (i % 9), last))
        with open(os.path.join(d, f), "w") as h:
            h.write("".join(x + "\n" for x, _ in lines))
        want[f] = lines
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = read_engine_logs(spark, d).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for f, lines in want.items():
        got = sorted((r.line_no, r.line, r.ts) for r in rows if r.run_id.endswith(f))
        changed = got[0][2]
        assert [(x, t) for _, x, t in got] == [(x, t or changed) for x, t in lines] and changed.year > 2024


def test_tail_reads_only_the_newest_log(spark, tmp_path):
    from servops.sources.engine_logs import tail_newest_log
    for day, n in (("20240314", 50), ("20240316", 7), ("20240315", 60)):
        (tmp_path / f"server_{day}.log").write_text("".join(f"{day} line {k}\n" for k in range(n)))
    got = tail_newest_log(spark, str(tmp_path), 5)
    assert [r.line for r in got.collect()] == [f"20240316 line {k}" for k in range(2, 7)]
    assert [f.rsplit("_", 1)[1] for f in got.inputFiles()] == ["20240316.log"]
    assert tail_newest_log(spark, str(tmp_path), 0).count() == 0
    (tmp_path / "none").mkdir()
    assert tail_newest_log(spark, str(tmp_path / "none")).count() == 0
