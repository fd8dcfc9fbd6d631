"""Batched distributed inference: plan -> batches -> requests -> model -> parsed generations."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.params import default_params, merge_params, params_json
from ..functions.text import py_strip, py_word_count
from ..session import cut_lineage
from .catalog import default_config
from .ordering import ordered_index

COMPLETIONS = "completions"
CHAT = "chat/completions"


def request_plan(prompts: DataFrame, models: DataFrame) -> DataFrame:
    """Per request: default config of the model, merged params, effective batch size and mode.

    Unknown model names get status ``unknown_model`` and no plan.
    """
    req = prompts.groupBy("request_id").agg(
        F.first("model_name").alias("model_name"), F.first("mode").alias("mode"),
        F.first("batch_size").alias("batch_size"), F.first("params").alias("params"))
    d = default_config(models).select("model_name", F.col("id").alias("model_id"), "model_path",
                                      "max_batch_size", "chat_template")
    j = req.join(d, "model_name", "left")
    ok = F.col("model_id").isNotNull()
    eff = F.greatest(F.lit(1), F.least(F.col("batch_size"), F.coalesce(F.col("max_batch_size"), F.lit(1))))
    mode = F.when((F.col("mode") == "chat") & (F.coalesce(F.col("chat_template"), F.lit("")) != ""),
                  F.lit("chat")).otherwise(F.lit("completion"))
    merged = merge_params(default_params(), F.col("params"))
    return j.select(
        "request_id", "model_name",
        F.when(ok, F.lit("ok")).otherwise(F.lit("unknown_model")).alias("status"),
        "model_id", "model_path",
        F.when(ok, mode).alias("mode"), F.when(ok, eff).cast("int").alias("batch_size"),
        F.when(ok, params_json(merged)).alias("params_json"))


def prompt_batches(prompts: DataFrame, plan: DataFrame) -> DataFrame:
    """Batch number = position in the request // effective batch size (order kept)."""
    p = prompts.select("request_id", "prompt_no").join(
        plan.where(F.col("status") == "ok").select("request_id", "batch_size"), "request_id")
    i = ordered_index(p, ["request_id"], "prompt_no", "_i")
    return i.select("request_id", "prompt_no", F.floor(F.col("_i") / F.col("batch_size")).cast("long").alias("batch_no"),
                    (F.col("_i") % F.col("batch_size")).cast("int").alias("pos"))


def _with_params(obj_json: Column, pj: Column) -> Column:
    """Splice the ``{...}`` params object into a JSON object (``{**payload, **params}``)."""
    inner = F.regexp_replace(pj, r"^\{|\}$", "")
    body = F.substring(obj_json, F.lit(1), F.length(obj_json) - 1)
    return F.concat(body, F.when(inner != "", F.concat(F.lit(","), inner)).otherwise(F.lit("")), F.lit("}"))


def request_calls(prompts: DataFrame, plan: DataFrame, batches: DataFrame) -> DataFrame:
    """One row per server call: a completion call per batch, a chat call per prompt.

    Groups are batches, bounded by the effective batch size.
    """
    b = batches.join(prompts.select("request_id", "prompt_no", "prompt"), ["request_id", "prompt_no"]) \
        .join(plan.select("request_id", "mode", "model_path", "params_json", "model_id"), "request_id")
    comp = b.where(F.col("mode") == "completion").groupBy("request_id", "batch_no").agg(
        F.sort_array(F.collect_list(F.struct("pos", "prompt_no", "prompt"))).alias("_ps"),
        F.first("model_path").alias("model_path"), F.first("params_json").alias("params_json"),
        F.first("model_id").alias("model_id"))
    comp = comp.select("request_id", "batch_no", F.lit(0).alias("call_no"), F.lit(COMPLETIONS).alias("endpoint"),
                       "model_id", "model_path", "params_json",
                       F.col("_ps.prompt").alias("prompts"), F.col("_ps.prompt_no").alias("prompt_nos"))
    chat = b.where(F.col("mode") == "chat").select(
        "request_id", "batch_no", F.col("pos").alias("call_no"), F.lit(CHAT).alias("endpoint"),
        "model_id", "model_path", "params_json", F.array("prompt").alias("prompts"),
        F.array("prompt_no").alias("prompt_nos"))
    return comp.unionByName(chat)


def request_payloads(calls: DataFrame) -> DataFrame:
    """JSON body of every call (model path, prompts or messages, then the params)."""
    comp = F.to_json(F.named_struct(F.lit("prompt"), F.col("prompts"), F.lit("model"), F.col("model_path")))
    chat = F.to_json(F.named_struct(
        F.lit("model"), F.col("model_path"),
        F.lit("messages"), F.transform("prompts", lambda p: F.named_struct(F.lit("role"), F.lit("user"),
                                                                             F.lit("content"), p))))
    obj = F.when(F.col("endpoint") == COMPLETIONS, comp).otherwise(chat)
    return calls.select("request_id", "batch_no", "call_no", "endpoint", F.size("prompts").alias("n_prompts"),
                        _with_params(obj, F.col("params_json")).alias("payload"))


ModelFn = Callable[[list, dict], list]


def echo_model(prompts: list, params: dict) -> list:
    """Deterministic stand-in model: answers with the prompt's words reversed."""
    return [" ".join(reversed(p.split())) for p in prompts]


def _call_with_retry(fn: ModelFn, prompts, params, attempts: int, wait_min: float, wait_max: float):
    for i in range(attempts):
        try:
            return fn(prompts, params)
        except Exception:
            if i == attempts - 1:
                raise
            time.sleep(min(wait_max, max(wait_min, 2 ** i)))


RESPONSE_SCHEMA = ("request_id long, batch_no long, call_no int, endpoint string, n_prompts int, "
                   "response string, latency double, status string, error string")


def wall_time(call: Callable[[], list], prompts: list) -> tuple[list, float]:
    """A call's result and the seconds it took."""
    t0 = time.monotonic()
    return call(), time.monotonic() - t0


def fixed_time(call: Callable[[], list], prompts: list) -> tuple[list, float]:
    """A quarter of a second a prompt, for results that can be compared."""
    return call(), 0.25 * len(prompts)


def generate(calls: DataFrame, fn: ModelFn = echo_model, attempts: int = 3, wait_min: float = 4.0, wait_max: float = 10.0,
             partitions: int | None = None, in_flight: int = 4, timer=wall_time, materialize: bool = True) -> DataFrame:
    """Run the model over every call, one row a call.

    Calls are dealt evenly into ``partitions`` tasks (default: the shuffle partitions), each with at most
    ``in_flight`` calls at a time. A call that still fails after ``attempts`` gives a row with
    status ``failed``, the error and no response; the others are kept. With ``materialize`` (default) the
    responses are written once to the checkpoint folder, so downstream branches (completion and chat parsing,
    counts) read them instead of calling the model again.
    """
    n = partitions or int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def one(r):
        params = json.loads(r.params_json) if r.params_json else {}
        prompts = list(r.prompts)
        head = (r.request_id, r.batch_no, r.call_no, r.endpoint, len(prompts))
        try:
            texts, seconds = timer(lambda: _call_with_retry(fn, prompts, params, attempts, wait_min, wait_max), prompts)
            if r.endpoint == COMPLETIONS:
                body = {"choices": [{"index": i, "text": t} for i, t in enumerate(texts)]}
            else:
                body = {"choices": [{"message": {"role": "assistant", "content": texts[0]}}]}
            return (*head, json.dumps(body), seconds, "ok", None)
        except Exception as e:  # the call's own failure, reported in its row
            return (*head, None, None, "failed", f"{type(e).__name__}: {e}")

    def run(it):
        with ThreadPoolExecutor(in_flight) as pool:
            for pdf in it:
                out = list(pool.map(one, pdf.itertuples(index=False)))
                yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in RESPONSE_SCHEMA.split(",")])
    out = calls.select("request_id", "batch_no", "call_no", "endpoint", "prompts", "params_json") \
        .repartition(n, "request_id", "batch_no", "call_no").mapInPandas(run, RESPONSE_SCHEMA)
    return cut_lineage(out) if materialize else out


def failed_calls(responses: DataFrame) -> DataFrame:
    """Calls without a usable reply: the call failed, or its reply isn't JSON with choices."""
    reply = F.from_json("response", "choices array<struct<text: string>>")
    reason = (F.when(F.col("status") == "failed", F.col("error"))
              .when(reply["choices"].isNull(), F.lit("unparsable reply")))
    return responses.select("request_id", "batch_no", "call_no", "endpoint", reason.alias("reason")).where(F.col("reason").isNotNull())


def answers(responses: DataFrame) -> DataFrame:
    """The answer texts of every call, one a line, beside its status and latency."""
    comp = F.transform(F.from_json("response", COMPLETION_SCHEMA)["choices"], lambda c: c["text"])
    chat = F.transform(F.from_json("response", CHAT_SCHEMA)["choices"], lambda c: c["message"]["content"])
    text = F.array_join(F.when(F.col("endpoint") == COMPLETIONS, comp).otherwise(chat), "\n")
    return responses.select("request_id", "batch_no", "call_no", "endpoint", "n_prompts", "status", text.alias("answers"), "latency")


CHAT_SCHEMA = "choices array<struct<message: struct<content: string>>>, usage struct<completion_tokens: int>"
COMPLETION_SCHEMA = "choices array<struct<text: string, usage: struct<completion_tokens: int>>>"


def parse_chat(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Chat reply: stripped content; tokens from usage unless 0/absent, else word count."""
    p = F.from_json("response", CHAT_SCHEMA)
    t = responses.withColumn("_p", p)
    text = py_strip(F.col("_p.choices")[0]["message"]["content"])
    usage = F.nullif(F.col("_p.usage.completion_tokens"), F.lit(0))
    return t.select(*keys, text.alias("output_text"),
                    F.coalesce(usage, py_word_count(text)).cast("int").alias("tokens_generated"),
                    F.col("latency").alias("time_taken"))


def parse_completions(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Completion reply: one row per choice; usage looked up per choice; latency shared."""
    t = responses.withColumn("_p", F.from_json("response", COMPLETION_SCHEMA))
    e = t.select(*keys, "latency", "n_prompts", F.posexplode("_p.choices").alias("pos", "_c"))
    usage = F.nullif(F.col("_c.usage.completion_tokens"), F.lit(0))
    return e.select(*keys, "pos", py_strip(F.col("_c.text")).alias("output_text"),
                    F.coalesce(usage, py_word_count(F.col("_c.text"))).cast("int").alias("tokens_generated"),
                    (F.col("latency") / F.col("n_prompts")).alias("time_taken"))


def align_completions(parsed: DataFrame, batches: DataFrame) -> DataFrame:
    """Choice i of a batch answers the batch's i-th prompt."""
    return parsed.join(batches, ["request_id", "batch_no", "pos"], "inner").select(
        "request_id", "batch_no", "pos", "prompt_no", "output_text", "tokens_generated", "time_taken")


def batch_mismatch(batches: DataFrame, parsed: DataFrame) -> DataFrame:
    """Batches whose number of answers differs from their number of prompts."""
    n_p = batches.groupBy("request_id", "batch_no").agg(F.count(F.lit(1)).alias("n_prompts"))
    n_r = parsed.groupBy("request_id", "batch_no").agg(F.count(F.lit(1)).alias("n_responses"))
    j = n_p.join(n_r, ["request_id", "batch_no"], "left") \
        .withColumn("n_responses", F.coalesce("n_responses", F.lit(0)))
    return j.where(F.col("n_prompts") != F.col("n_responses")) \
        .select("request_id", "batch_no", "n_prompts", F.col("n_responses").cast("long"))


def generation_rows(prompts: DataFrame, plan: DataFrame, batches: DataFrame, responses: DataFrame,
                    generated_at: Column | None = None) -> DataFrame:
    """Generation log rows for every answered prompt (completion and chat)."""
    comp = align_completions(parse_completions(responses.where(F.col("endpoint") == COMPLETIONS),
                                               ["request_id", "batch_no"]), batches)
    chat = parse_chat(responses.where(F.col("endpoint") == CHAT), ["request_id", "batch_no", "call_no"]) \
        .withColumnRenamed("call_no", "pos").join(batches, ["request_id", "batch_no", "pos"])
    cols = ["request_id", "prompt_no", "output_text", "tokens_generated", "time_taken"]
    both = comp.select(*cols).unionByName(chat.select(*cols))
    ts = generated_at if generated_at is not None else F.localtimestamp()
    return both.join(prompts.select("request_id", "prompt_no", F.col("prompt").alias("input_text")),
                     ["request_id", "prompt_no"]) \
        .join(plan.select("request_id", "model_id", F.col("params_json").alias("parameters")), "request_id") \
        .select("request_id", "prompt_no", "input_text", "output_text", "model_id", "tokens_generated",
                "time_taken", "parameters", ts.cast("timestamp_ntz").alias("generated_at"))
