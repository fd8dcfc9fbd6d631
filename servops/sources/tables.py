"""Scans of the parquet tables (column pruning and filters reach the scan)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: columns of the serving tables
MODELS = ("id int, model_name string, model_path string, tensor_parallel_size int, max_model_len int, "
          "gpu_memory_utilization double, enforce_eager boolean, chat_template string, speculative_decoding boolean, "
          "max_batch_size int, created_at timestamp_ntz")
GENERATIONS = ("id long, request_id long, prompt_no long, input_text string, output_text string, model_id int, "
               "tokens_generated int, time_taken double, parameters string, generated_at timestamp_ntz, gen_date date")
ERRORS = ("id int, error_pattern string, error_message string, solution string, initial_count long, "
          "first_seen timestamp_ntz")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table written by the sinks; columns it lacks are null, its batch is left out."""
    t = spark.read.schema(schema).parquet(path)
    return t.select(*[c for c in t.columns if c != "batch"])


def read_models(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, MODELS)


def read_generations(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, GENERATIONS)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, ERRORS)
