from pyspark.sql import functions as F

from servops.operators.catalog import (default_config, model_group_summary, register_models, resolve_configs,
                                       start_config)
from servops.operators.inference import request_plan

MODELS = ("id int, model_name string, model_path string, tensor_parallel_size int, max_model_len int, "
          "gpu_memory_utilization double, enforce_eager boolean, chat_template string, "
          "speculative_decoding boolean, max_batch_size int")
REQ = "request_id long, model_name string, max_model_len int, speculative_decoding boolean"


def _models(spark):
    return spark.createDataFrame([
        (3, "m", "/p/m3", 1, 2048, 0.9, False, "t", False, None),
        (1, "m", "/p/m1", 2, 2048, 0.8, True, "t", False, 8),
        (2, "m", "/p/m2", 1, 4096, None, False, "", True, 4),
        (10, "n", "/p/n", 1, 1024, 0.9, False, None, False, None),
    ], MODELS)


def test_default_is_lowest_id(spark):
    r = {x.model_name: x.id for x in default_config(_models(spark)).collect()}
    assert r == {"m": 1, "n": 10}


def test_start_config_optional_length(spark):
    req = spark.createDataFrame([(1, "m", None, False), (2, "m", 4096, False), (3, "m", 999, False),
                                 (4, "zz", None, False), (5, "m", 0, False)], REQ)
    r = {x.request_id: x.config_id for x in start_config(_models(spark), req).collect()}
    assert r == {1: 1, 2: 2, 3: None, 4: None, 5: 1}


def test_resolve_or_derive(spark):
    models = _models(spark)
    req = spark.createDataFrame([
        (1, "m", None, False),    # default
        (2, "m", 4096, True),     # exact match
        (3, "m", 8192, False),    # derive
        (4, "m", 8192, False),    # matches the row request 3 derived
        (5, "m", None, True),     # custom without length: its own derived row (NULL never matches)
        (6, "m", None, True),     # ... and again
        (7, "zz", 1024, False),   # no base -> error
        (8, "zz", None, False),   # no default -> error
        (9, "m", 2048, False),    # two matches -> lowest id
        (10, "m", 0, False),      # 0 is not a length -> default
    ], REQ)
    res, new = resolve_configs(models, req)
    got = {x.request_id: (x.status, x.config_id) for x in res.collect()}
    assert got == {1: ("default", 1), 2: ("match", 2), 3: ("derived", 11), 4: ("match", 11),
                   5: ("derived", 12), 6: ("derived", 13), 7: ("error", None), 8: ("error", None),
                   9: ("match", 1), 10: ("default", 1)}
    rows = {x.id: x for x in new.collect()}
    assert sorted(rows) == [11, 12, 13]
    assert rows[11].max_model_len == 8192 and rows[11].model_path == "/p/m1" and rows[11].max_batch_size is None
    assert rows[12].max_model_len == 2048 and rows[12].speculative_decoding is True
    reg = register_models(new, F.lit("2024-01-01").cast("timestamp_ntz")).collect()
    assert all(r.generations_count == 0 and r.avg_tokens_per_second == 0.0 for r in reg)
    # idempotence: once appended, the same request matches instead of deriving again
    res2, new2 = resolve_configs(models.unionByName(new), req.where("request_id = 3"))
    assert [(x.status, x.config_id) for x in res2.collect()] == [("match", 11)]
    assert new2.count() == 0


def test_group_summary_base_is_shortest_then_lowest_id(spark):
    r = {x.model_name: x for x in model_group_summary(_models(spark)).collect()}
    assert r["m"].n_configs == 3 and r["m"].lengths == "2048,4096" and r["m"].base_id == 1
    assert r["m"].any_speculative is True and r["n"].any_speculative is False


def test_request_plan_batch_size_and_mode(spark):
    prompts = spark.createDataFrame([
        (1, 0, "p", "chat", "m", None, None),      # model max 8, chat template set
        (2, 0, "p", "chat", "n", 5, None),         # template NULL -> completion; max NULL -> 1
        (3, 0, "p", "completion", "m", 0, None),   # 0 -> 1
        (4, 0, "p", "completion", "m", -1, None),  # -1 -> 1
        (5, 0, "p", "completion", "m", 100, None), # capped to 8
        (6, 0, "p", "completion", "zz", 2, None),  # unknown model
    ], "request_id long, prompt_no long, prompt string, mode string, model_name string, batch_size int, "
       "params map<string,string>")
    r = {x.request_id: x for x in request_plan(prompts, _models(spark)).collect()}
    assert (r[1].mode, r[1].batch_size) == ("chat", 8)
    assert (r[2].mode, r[2].batch_size) == ("completion", 1)
    assert r[3].batch_size == 1 and r[4].batch_size == 1 and r[5].batch_size == 8
    assert r[6].status == "unknown_model" and r[6].batch_size is None
