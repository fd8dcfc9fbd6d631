import datetime as dt

from servops.operators.usage import latest_model, model_stats, usage_rollup

MODELS = "id int, model_name string, max_model_len int"
GENS = "gid long, model_id int, tokens_generated int, time_taken double, generated_at timestamp_ntz"


def test_ratio_of_sums_zero_time_and_no_generations(spark):
    models = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], MODELS)
    gens = spark.createDataFrame([
        (1, 1, 10, 1.0, None), (2, 1, 30, 3.0, None),   # ratio of sums = 40/4 = 10
        (3, 2, 5, 0.0, None), (4, 2, 7, 0.0, None),      # 0 total time -> 0
    ], GENS)
    r = {x.id: x for x in model_stats(models, gens).collect()}
    assert (r[1].generations_count, r[1].tokens_generated_count, r[1].avg_tokens_per_second) == (2, 40, 10.0)
    assert (r[2].generations_count, r[2].tokens_generated_count, r[2].avg_tokens_per_second) == (2, 12, 0.0)
    assert (r[3].generations_count, r[3].tokens_generated_count, r[3].avg_tokens_per_second) == (0, 0, 0.0)
    assert usage_rollup(gens).count() == 2


def test_latest_model_nulls_first(spark):
    models = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], MODELS)
    t = dt.datetime(2024, 1, 1)
    gens = spark.createDataFrame([(1, 1, 1, 1.0, t), (2, 2, 1, 1.0, None), (3, 3, 1, 1.0, None)], GENS)
    r = latest_model(gens, models, ["gid"]).collect()
    assert [x.model_name for x in r] == ["b"]  # NULL sorts first under DESC, tie -> lowest gid
