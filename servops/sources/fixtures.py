"""Adapters from the driver's test tables to the serving-operations inputs.

Each adapter is a plain projection (no global ordering, no driver round trip),
so its cost grows linearly with the input and parallelises with the scan.
``plans/oracle.py`` holds the same adapters in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


def _as_table(df: DataFrame) -> DataFrame:
    """Give a derived table the boundary of a stored one.

    Rows pass through a one-element ``inline``; filters of later operators
    then apply to the finished rows instead of being pushed into (and
    repeating) the expressions that build them.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def models(spark: SparkSession, d: str) -> DataFrame:
    """Model configurations (one row per configuration) from ``part``."""
    p = read_table(spark, d, "part")
    pk = F.col("p_partkey")
    return p.select(
        pk.cast("int").alias("id"),
        F.col("p_brand").alias("model_name"),
        F.concat(F.lit("/models/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"),
                 pk.cast("string")).alias("model_path"),
        (F.lit(1) + pk % 4).cast("int").alias("tensor_parallel_size"),
        (F.lit(2048) * (F.lit(1) + F.col("p_size") % 8)).cast("int").alias("max_model_len"),
        F.when(pk % 5 == 0, F.lit(None).cast("double")).otherwise(F.lit(0.9))
         .alias("gpu_memory_utilization"),
        (F.col("p_size") % 2 == 0).alias("enforce_eager"),
        F.when(pk % 3 == 0, F.lit(None).cast("string")).when(pk % 7 == 0, F.lit(""))
         .otherwise(F.lit("chatml")).alias("chat_template"),
        (F.col("p_type") == "ECONOMY").alias("speculative_decoding"),
        F.when(pk % 3 == 1, F.lit(None).cast("int")).otherwise(F.col("p_size").cast("int"))
         .alias("max_batch_size"),
    )


# Columns of lineitem that order generations when timestamps tie.
GENERATION_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                    "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def generations(spark: SparkSession, d: str) -> DataFrame:
    """Generation log from ``lineitem``; zero times and null timestamps included."""
    li = read_table(spark, d, "lineitem")
    return li.select(
        F.col("l_partkey").cast("int").alias("model_id"),
        F.col("l_quantity").cast("int").alias("tokens_generated"),
        F.col("l_discount").alias("time_taken"),
        F.when(F.col("l_orderkey") % 500 == 0, F.lit(None).cast("timestamp_ntz"))
         .otherwise(F.col("l_shipdate")).alias("generated_at"),
        *GENERATION_ORDER,
    )


def start_requests(spark: SparkSession, d: str) -> DataFrame:
    """Server start requests (model, optional length, speculative flag)."""
    e = read_table(spark, d, "events")
    eid = F.col("event_id")
    return e.select(
        eid.alias("request_id"),
        F.concat(F.lit("Brand#"), (F.col("user_id") % 30).cast("int").cast("string")).alias("model_name"),
        F.when(eid % 4 == 0, F.lit(None).cast("int"))
         .otherwise((F.lit(2048) * (F.lit(1) + eid % 10)).cast("int")).alias("max_model_len"),
        (eid % 3 == 0).alias("speculative_decoding"),
    )


def model_id_lookups(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.select(F.col("event_id").alias("request_id"),
                    F.floor(F.col("value") * 10).cast("int").alias("model_id"))


def model_path_lookups(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part")
    pk = F.col("p_partkey")
    return p.select(
        pk.alias("lookup_id"),
        F.concat(F.lit("/models/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"),
                 (pk + pk % 2).cast("string")).alias("model_path"))


def log_times(spark: SparkSession, d: str) -> DataFrame:
    """Engine log lines without their text, for jobs that only need run and time."""
    return read_table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"), "ts")


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Engine log lines: one run per user, events in id order are the lines."""
    e = read_table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value",
                                              _k().alias("k"))
    k = F.col("k")
    et = F.col("event_type")
    line = (
        F.when((et == "error") & (k >= 90),
               F.concat(F.lit("RuntimeError: Server process terminated unexpectedly with exit code "),
                        k.cast("string")))
        .when((et == "error") & (k >= 60),
              F.concat(F.lit("RuntimeError: CUDA error (code "), (k % 7).cast("string"),
                       F.lit("): out of memory")))
        .when((et == "error") & (k >= 30),
              F.concat(F.lit("ValueError: No base configuration found for model m"),
                       (k % 5).cast("string")))
        .when((et == "error") & (k < 4),
              F.concat(F.lit("ValueError: Größe überschritten in shard "), k.cast("string")))
        .when(et == "error", F.concat(F.lit("Exception: worker "), (k % 3).cast("string"), F.lit(" died")))
        .when(et == "view",
              F.concat(F.lit("Loading shards: "), k.cast("string"), F.lit("%|"),
                       F.repeat(F.lit("█"), F.floor(k / 10).cast("int")), F.lit("|")))
        .when(et == "signup",
              F.concat(F.lit("INFO 03-15 core.py: Maximum concurrency for 4096 tokens per request: "),
                       F.col("value").cast("decimal(18,2)").cast("string"), F.lit("x")))
        .when((et == "click") & (k < 10), F.lit("   "))
        .when((et == "click") & (k >= 95), F.lit("Press Enter to close this session"))
        .when((et == "click") & (k >= 90),
              F.concat(F.lit("vLLM server exited with code "), (k % 2).cast("string")))
        .when((et == "purchase") & (k >= 90), F.lit("INFO: Server started successfully"))
        .when((et == "purchase") & (k < 5), F.lit("INFO: Server stopped"))
        .when((et == "purchase") & (k < 10), F.lit("Traceback (most recent call last):"))
        .when((et == "purchase") & (k < 20),
              F.concat(F.lit("Downloading \\u2588\\u2588 "), k.cast("string"), F.lit("%")))
        .otherwise(F.concat(F.lit("INFO request "), F.col("event_id").cast("string")))
    )
    return _as_table(e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"),
                              "ts", line.alias("line")))


def run_models(spark: SparkSession, d: str) -> DataFrame:
    """Which model configuration each log run served (run r served model id r % 40: several runs a model)."""
    e = read_table(spark, d, "events")
    return e.select(F.col("user_id").alias("run_id")).distinct() \
        .withColumn("model_id", (F.col("run_id") % 40).cast("int"))


def error_catalog(spark: SparkSession) -> DataFrame:
    """Known-error catalog (a small curated table, as the reference keeps it)."""
    rows = [
        (1, r"cuda error \(code [0-3]\)", "CUDA out of memory on a low device code",
         "Lower gpu_memory_utilization or max_model_len", 5, "2024-01-01 00:00:00"),
        (2, r"no base configuration found for model m[12]", "Missing base configuration",
         "Register a base configuration for the model", 2, "2024-01-01 00:00:00"),
        (3, r"worker 9 died", "Worker nine died", "Restart the worker pool", 0, "2024-01-01 00:00:00"),
        (4, r"(?P<who>worker) (?P<no>0) died", "Worker zero died", "Restart the worker pool", 1, "2024-01-01 00:00:00"),
        (5, r"gr\w{2}e \w+schritten in shard [01]\b", "Shard too large", "Split the shard", 0, "2024-01-01 00:00:00"),
        (6, r"worker (1 died", "Not a pattern", "", 7, "2024-01-01 00:00:00"),
        (7, r"worker 2 died\nValueError", "Worker two died, then a value error", "", 0, "2024-01-01 00:00:00"),
        (9, r"\p{L}+ died", "Not a Python pattern", "", 0, "2024-01-01 00:00:00"),
    ]
    return spark.createDataFrame(
        rows, "id int, error_pattern string, error_message string, solution string, "
              "initial_count long, first_seen string") \
        .withColumn("first_seen", F.to_timestamp_ntz("first_seen"))


def gpu_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    """nvidia-smi style CSV text (no header, no units) with blank, short and [N/A] rows."""
    e = read_table(spark, d, "events").select("event_id", "ts", "user_id", "value", _k().alias("k"))
    k = F.col("k")
    eid = F.col("event_id")
    idx = (F.col("user_id") % 8).cast("int").cast("string")
    fields = [
        idx,
        F.concat(F.lit("NVIDIA RTX A"), idx),
        (F.lit(30) + k % 50).cast("string"),
        k.cast("string"),
        (F.col("value") * 40).cast("decimal(18,2)").cast("string"),
        F.when(eid % 97 == 0, F.lit("0")).otherwise(F.lit("24576")),
        F.when(eid % 13 == 0, F.lit("[N/A]")).otherwise(F.col("value").cast("decimal(18,2)").cast("string")),
        F.lit("300.00"),
    ]
    line = (F.when(eid % 53 == 0, F.lit(""))
            .when(eid % 61 == 0, F.concat_ws(", ", *fields[:5]))
            .otherwise(F.concat_ws(", ", *fields)))
    return _as_table(e.select(eid.alias("sample_id"), "ts", line.alias("line")))


def gpu_process_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("event_id", "user_id", "value", _k().alias("k"))
    k = F.col("k")
    eid = F.col("event_id")
    name = (F.when(k % 3 == 0, F.lit("/usr/bin/python3"))
            .when(k % 3 == 1, F.lit("VLLM::EngineCore_worker_process"))
            .otherwise(F.lit("python -m vllm.entrypoints.openai.api_server")))
    fields = [(F.col("user_id") % 8).cast("int").cast("string"), (eid + 1000).cast("string"), name,
              (F.col("value") * 10).cast("decimal(18,2)").cast("string")]
    line = F.when(eid % 59 == 0, F.concat_ws(", ", *fields[:3])).otherwise(F.concat_ws(", ", *fields))
    return _as_table(e.select(eid.alias("sample_id"), line.alias("line")))


def api_log_lines(spark: SparkSession, d: str) -> DataFrame:
    """API access log lines ``asctime - name - level - message``."""
    e = read_table(spark, d, "events").select("event_id", "ts", "event_type", _k().alias("k"))
    k = F.col("k")
    eid = F.col("event_id")
    et = F.col("event_type")
    method = F.when(et.isin("purchase", "signup"), F.lit("POST")).otherwise(F.lit("GET"))
    msg = (F.when(eid % 10 == 9, F.concat(F.lit("Found loaded model: m"), (k % 5).cast("string")))
           .when(eid % 2 == 0, F.concat(F.lit("Request: "), method, F.lit(" http://localhost:8000/api/"),
                                         et, F.lit("?k="), k.cast("string")))
           .otherwise(F.concat(F.lit("Response: "),
                               F.when(et == "error", F.lit("500")).when(k >= 95, F.lit("404"))
                               .otherwise(F.lit("200")))))
    line = F.when(eid % 37 == 0, F.lit("  File \"server.py\", line 1 - in main")).otherwise(
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" - vllm-api - INFO - "), msg))
    return _as_table(e.select(eid.alias("line_no"), line.alias("value")))


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Live-channel messages: JSON ``{type, data}`` or bare text."""
    return channel_messages(spark, d).select("msg_id", "message")


def channel_messages(spark: SparkSession, d: str) -> DataFrame:
    """The same with the run whose channel they came by."""
    lines = log_lines(spark, d)
    k_line = F.col("line")
    ln = F.col("line_no")

    def js(t, data):
        return F.concat(F.lit('{"type": "' + t + '", "data": '), data, F.lit("}"))

    def q(c):
        return F.concat(F.lit('"'), c, F.lit('"'))

    msg = (F.when(F.trim(k_line) == "", F.lit('{"type": "pong"}'))
           .when(k_line.contains("%|"), js("progress", q(k_line)))
           .when(k_line.contains("RuntimeError"),
                 js("error", F.concat(F.lit('{"known": false, "message": '), q(k_line), F.lit("}"))))
           .when(k_line.contains("Maximum concurrency"), js("status", F.lit('{"running": true}')))
           .when(ln % 5 == 0, k_line)
           .when(ln % 7 == 0, F.concat(F.lit("["), ln.cast("string"), F.lit("]")))
           .when(ln % 11 == 0, F.lit('"x"'))
           .when(ln % 13 == 0, ln.cast("string"))
           .otherwise(js("output", q(k_line))))
    return _as_table(lines.select("run_id", ln.alias("msg_id"), msg.alias("message")))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompt table: every user turn is a prompt of its conversation's request."""
    c = read_table(spark, d, "conversations").where(F.col("role") == "user")
    cid = F.col("conv_id")
    overrides = (F.when(cid % 4 == 0, F.create_map(F.lit("temperature"), F.lit("0.2")))
                 .when(cid % 4 == 1, F.create_map(F.lit("max_tokens"), F.lit("256"),
                                                  F.lit("stop"), F.lit('"END"')))
                 .otherwise(F.lit(None).cast("map<string,string>")))
    return c.select(
        cid.alias("request_id"), F.col("turn").alias("prompt_no"), F.col("text").alias("prompt"),
        F.when(cid % 2 == 0, F.lit("chat")).otherwise(F.lit("completion")).alias("mode"),
        F.concat(F.lit("Brand#"), (cid % 28).cast("int").cast("string")).alias("model_name"),
        F.when(cid % 3 == 0, F.lit(None).cast("int")).otherwise((cid % 5 - 1).cast("int")).alias("batch_size"),
        overrides.alias("params"),
    )


def answers(spark: SparkSession, d: str) -> DataFrame:
    """The answer that followed each user turn (when one did), with a usage count.

    Turns are numbered densely from 0, so "the next turn" is an equi-join on
    ``turn + 1`` (hash-partitioned on both keys; a long conversation is not
    one task as it would be under a per-conversation window).
    """
    c = read_table(spark, d, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn")
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("nxt"))
    t = u.join(a, ["conv_id", "turn"], "inner")
    return t.select(
        F.col("conv_id").alias("request_id"), F.col("turn").alias("prompt_no"),
        F.col("nxt").alias("answer"),
        F.when(F.col("turn") % 4 == 0, F.length("nxt").cast("int")).otherwise(F.lit(0)).alias("usage_tokens"),
    )


def chat_responses(spark: SparkSession, d: str) -> DataFrame:
    """Chat-completions responses (padded content so that strip matters) and latency."""
    a = answers(spark, d)
    body = F.to_json(F.named_struct(
        F.lit("choices"), F.array(F.named_struct(
            F.lit("message"), F.named_struct(F.lit("content"), F.concat(F.lit("\n "), F.col("answer"), F.lit(" "))))),
        F.lit("usage"), F.named_struct(F.lit("completion_tokens"), F.col("usage_tokens"))))
    return a.select("request_id", "prompt_no", body.alias("response"),
                    ((F.col("prompt_no") % 7 + 1) * 0.25).alias("latency"))


def completion_responses(spark: SparkSession, d: str, batches: DataFrame, plan: DataFrame) -> DataFrame:
    """Completions responses for the batched completion calls: one choice per answered
    prompt of the batch, in prompt order (an unanswered prompt shifts the later choices)."""
    comp = plan.where((F.col("status") == "ok") & (F.col("mode") == "completion")).select("request_id")
    b = batches.join(comp, "request_id", "left_semi")
    n = b.groupBy("request_id", "batch_no").agg(F.count(F.lit(1)).cast("int").alias("n_prompts"))
    a = b.join(answers(spark, d), ["request_id", "prompt_no"], "inner")
    g = a.groupBy("request_id", "batch_no").agg(
        F.sort_array(F.collect_list(F.struct("prompt_no", "answer", "usage_tokens"))).alias("_a"))
    choices = F.transform("_a", lambda x: F.named_struct(
        F.lit("text"), F.concat(F.lit("\n "), x["answer"], F.lit(" ")),
        F.lit("usage"), F.named_struct(F.lit("completion_tokens"), x["usage_tokens"])))
    body = F.to_json(F.named_struct(F.lit("choices"), choices))
    return n.join(g, ["request_id", "batch_no"], "left").select(
        "request_id", "batch_no", F.lit(0).alias("call_no"), F.lit("completions").alias("endpoint"), "n_prompts",
        F.coalesce(body, F.lit('{"choices":[]}')).alias("response"),
        ((F.col("batch_no") + 1) * 0.3).alias("latency"))
