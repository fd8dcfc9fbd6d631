"""Usage roll-up: generation log -> per-model counts, tokens and tokens per second."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAT_COLUMNS = ["generations_count", "tokens_generated_count", "avg_tokens_per_second"]
# Times are summed as exact decimals so that the result does not depend on
# the order partial sums are combined in (doubles would).
TIME_SUM_TYPE = "decimal(38,9)"


def usage_rollup(generations: DataFrame) -> DataFrame:
    """One aggregate per model: count, token sum, ratio of sums (0 when no time).

    Partial aggregation runs before the shuffle, so a model holding a third
    of all generations still ships one row per map task.
    """
    tok = F.sum("tokens_generated")
    secs = F.sum(F.col("time_taken").cast(TIME_SUM_TYPE)).cast("double")
    return generations.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("generations_count"),
        F.coalesce(tok, F.lit(0)).cast("long").alias("tokens_generated_count"),
        F.coalesce(F.try_divide(tok.cast("double"), F.nullif(secs, F.lit(0.0))), F.lit(0.0))
         .alias("avg_tokens_per_second"),
    )


def model_stats(models: DataFrame, generations: DataFrame) -> DataFrame:
    """Models with their usage statistics; a model without generations keeps 0/0/0.0."""
    r = usage_rollup(generations).withColumnRenamed("model_id", "id")
    j = models.join(r, "id", "left")
    return j.select(
        *[c for c in models.columns],
        F.coalesce("generations_count", F.lit(0)).cast("long").alias("generations_count"),
        F.coalesce("tokens_generated_count", F.lit(0)).cast("long").alias("tokens_generated_count"),
        F.coalesce("avg_tokens_per_second", F.lit(0.0)).alias("avg_tokens_per_second"),
    )


def latest_model(generations: DataFrame, models: DataFrame, tie_break: list[str]) -> DataFrame:
    """Model of the most recent generation (NULL timestamps sort first, as in DESC).

    The top-1 is taken on generations alone (a partial top-1 per task, then
    one merge); the single surviving row is then joined to the models, so no
    full generations x models join runs. Every generation references an
    existing model (foreign key), so this equals join-then-sort.
    """
    order = [F.col("generated_at").desc_nulls_first()] + [F.col(c).asc_nulls_last() for c in tie_break]
    top = generations.orderBy(*order).limit(1).select("model_id", "generated_at")
    # one row: a broadcast of proven size
    return F.broadcast(top).join(models, F.col("model_id") == models["id"], "inner") \
        .select("model_id", "model_name", "generated_at")
