import json

from pyspark.sql import functions as F

from servops.operators import inference as I

MODELS = ("id int, model_name string, model_path string, tensor_parallel_size int, max_model_len int, "
          "gpu_memory_utilization double, enforce_eager boolean, chat_template string, "
          "speculative_decoding boolean, max_batch_size int")
PROMPTS = ("request_id long, prompt_no long, prompt string, mode string, model_name string, batch_size int, "
           "params map<string,string>")


def _setup(spark):
    models = spark.createDataFrame([(1, "m", "/p/m", 1, 2048, 0.9, False, "tpl", False, 2)], MODELS)
    prompts = spark.createDataFrame(
        [(1, i, f"prompt number {i}", "completion", "m", None, {"temperature": "0.1"}) for i in range(5)] +
        [(2, i, f"chat {i}  words", "chat", "m", 3, None) for i in range(3)], PROMPTS)
    return models, prompts


def test_batches_payloads_and_round_trip(spark):
    models, prompts = _setup(spark)
    plan = I.request_plan(prompts, models)
    batches = I.prompt_batches(prompts, plan)
    b = sorted((r.request_id, r.prompt_no, r.batch_no, r.pos) for r in batches.collect())
    assert b[:5] == [(1, 0, 0, 0), (1, 1, 0, 1), (1, 2, 1, 0), (1, 3, 1, 1), (1, 4, 2, 0)]
    calls = I.request_calls(prompts, plan, batches)
    pay = {(r.request_id, r.batch_no, r.call_no): json.loads(r.payload)
           for r in I.request_payloads(calls).collect()}
    assert pay[(1, 0, 0)] == {"prompt": ["prompt number 0", "prompt number 1"], "model": "/p/m",
                              "temperature": 0.1, "max_tokens": 1024, "top_p": 0.95}
    assert pay[(2, 0, 1)]["messages"] == [{"role": "user", "content": "chat 1  words"}]
    resp = I.generate(calls, I.echo_model, wait_min=0, wait_max=0)
    gens = I.generation_rows(prompts, plan, batches, resp, F.lit("2024-01-01"))
    g = {(r.request_id, r.prompt_no): r for r in gens.collect()}
    assert len(g) == 8
    assert g[(1, 3)].output_text == "3 number prompt" and g[(1, 3)].tokens_generated == 3
    assert g[(2, 2)].output_text == "words 2 chat"


def test_parse_usage_fallback_and_latency_share(spark):
    chat = spark.createDataFrame([
        (1, 0, json.dumps({"choices": [{"message": {"content": " a b\x1cc "}}], "usage": {"completion_tokens": 0}}), 2.0),
        (1, 1, json.dumps({"choices": [{"message": {"content": "x"}}], "usage": {"completion_tokens": 9}}), 1.0),
        (1, 2, json.dumps({"choices": [{"message": {"content": "y z"}}], "usage": None}), 1.0),
    ], "request_id long, prompt_no long, response string, latency double")
    r = {x.prompt_no: x for x in I.parse_chat(chat, ["request_id", "prompt_no"]).collect()}
    assert r[0].output_text == "a b\x1cc" and r[0].tokens_generated == 3 and r[0].time_taken == 2.0
    assert r[1].tokens_generated == 9 and r[2].tokens_generated == 2
    comp = spark.createDataFrame([
        (1, 0, 0, "completions", 3, json.dumps({"choices": [{"text": " one two "}, {"text": "three",
                                                           "usage": {"completion_tokens": 4}}]}), 3.0)],
        "request_id long, batch_no long, call_no int, endpoint string, n_prompts int, response string, latency double")
    p = {x.pos: x for x in I.parse_completions(comp, ["request_id", "batch_no"]).collect()}
    assert p[0].output_text == "one two" and p[0].tokens_generated == 2 and p[0].time_taken == 1.0
    assert p[1].tokens_generated == 4
    batches = spark.createDataFrame([(1, 0, 0, 10), (1, 0, 1, 11), (1, 0, 2, 12)],
                                    "request_id long, batch_no long, pos int, prompt_no long")
    mm = I.batch_mismatch(batches, I.parse_completions(comp, ["request_id", "batch_no"])).collect()
    assert [(x.n_prompts, x.n_responses) for x in mm] == [(3, 2)]
    al = I.align_completions(I.parse_completions(comp, ["request_id", "batch_no"]), batches).collect()
    assert sorted(x.prompt_no for x in al) == [10, 11]


def test_retry(spark):
    calls = {"n": 0}

    def flaky(prompts, params):
        calls["n"] += 1
        if calls["n"] < 3:
            raise RuntimeError("try again")
        return ["ok"] * len(prompts)
    assert I._call_with_retry(flaky, ["a"], {}, 3, 0, 0) == ["ok"]


def test_calls_spread_and_a_failing_call_is_one_row(spark):
    calls = spark.createDataFrame([(i, 0, 0, "completions", [f"p {i}"], None) for i in range(64)],
                                  "request_id long, batch_no long, call_no int, endpoint string, prompts array<string>, params_json string")

    def model(prompts, params):
        if prompts == ["p 7"]:
            raise ValueError("no")
        return [p.upper() for p in prompts]
    out = I.generate(calls, model, attempts=2, wait_min=0, wait_max=0, partitions=8, timer=I.fixed_time, materialize=False)
    assert len({r[0] for r in out.select(F.spark_partition_id()).collect()}) >= 6
    rows = {r.request_id: r for r in out.collect()}
    assert len(rows) == 64 and [i for i, r in rows.items() if r.status == "failed"] == [7]
    assert rows[7].response is None and rows[7].error == "ValueError: no" and rows[3].latency == 0.25
    broken = out.where("request_id < 3").withColumn("response", F.when(F.col("request_id") == 1, F.lit("{oops")).otherwise(F.col("response")))
    assert [(r.request_id, r.reason) for r in I.failed_calls(broken).collect()] == [(1, "unparsable reply")]
    assert [(r.request_id, r.reason) for r in I.failed_calls(out).collect()] == [(7, "ValueError: no")]
    assert {r.request_id: r.answers for r in I.answers(out).collect()}[5] == "P 5"
