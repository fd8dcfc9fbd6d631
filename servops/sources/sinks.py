"""Sinks: append-only tables (models, generations, error catalog) and JSON output.

An append names its batch, and the batch is a partition of the table: repeating it replaces its rows, so a retry
adds nothing twice. Readers of these tables are in ``tables``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ids import assign_dense_ids


def to_json_lines(df: DataFrame) -> DataFrame:
    """Each row as one JSON object with all its fields (what the HTTP endpoints returned)."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def _append(df: DataFrame, path: str, batch: str, by: list[str] = ()) -> None:
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(*by, "batch").parquet(path)


def append_models(new_models: DataFrame, path: str, batch: str) -> None:
    _append(new_models, path, batch)


def append_generations(gens: DataFrame, path: str, batch: str, order: list[str]) -> None:
    """Generation log, partitioned by day so that roll-ups can prune old days.

    Rows get ids in ``order`` after the largest id of the other batches. ``order`` must be a total order.
    """
    spark = gens.sparkSession
    try:
        last = spark.read.parquet(path).where(F.col("batch") != batch).agg(F.max("id")).first()[0] or 0
    except AnalysisException:  # nothing written yet
        last = 0
    rows = assign_dense_ids(gens.drop("id"), order, "id", start=int(last))
    _append(rows.withColumn("gen_date", F.to_date("generated_at")), path, batch, ["gen_date"])


def append_errors(mined: DataFrame, path: str, batch: str) -> None:
    _append(mined.select("id", "error_pattern", "error_message", "solution",
                         F.lit(0).cast("long").alias("initial_count"), "first_seen"), path, batch)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
