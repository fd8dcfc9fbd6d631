"""R1: live usage roll-up over an append-only generation log.

State is one row per model (bounded by the model catalog), so no watermark
is needed; update mode emits only the models whose totals changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.usage import usage_rollup

GENERATION_SCHEMA = ("model_id int, tokens_generated int, time_taken double, generated_at timestamp_ntz")


def live_usage(spark: SparkSession, path: str, schema: str = GENERATION_SCHEMA,
               max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return usage_rollup(r.parquet(path))


def start(df: DataFrame, checkpoint: str, sink: str = "memory", query_name: str = "live_usage",
          trigger: dict | None = None, path: str | None = None):
    w = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).format(sink)
    if sink == "memory":
        w = w.queryName(query_name)
    if path:
        w = w.option("path", path)
    w = w.trigger(**(trigger or {"processingTime": "5 seconds"}))
    return w.start()


#: epochs after which the totals are written anew
EPOCHS_A_TABLE = 50


def start_to_parquet(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, every: int = EPOCHS_A_TABLE):
    """Write every micro-batch of changed totals as its epoch's folder, and every ``every`` epochs the totals so far (restartable).

    A replayed epoch replaces its rows and the totals written with it. Readers (``current_totals``) need the last totals and the
    epochs since, so what they read doesn't grow with the age of the stream. ``every`` must stay the same for a ``path``.
    """
    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/epochs/group={epoch_id // every}/epoch={epoch_id}")
        if epoch_id % every == 0:
            before = _latest(_since(spark, path, epoch_id - every, every)) if epoch_id else \
                batch.withColumn("epoch", F.lit(0).cast("long")).limit(0)
            before.withColumn("every", F.lit(every)).write.mode("overwrite").parquet(f"{path}/totals/upto={epoch_id}")
    return (df.writeStream.outputMode("update").foreachBatch(write)
              .option("checkpointLocation", checkpoint)
              .trigger(**(trigger or {"processingTime": "5 seconds"})).start())


def _since(spark: SparkSession, path: str, upto: int, every: int) -> DataFrame:
    """The totals of the epochs before ``upto`` and the rows of the ``every`` epochs from there on."""
    group = spark.read.option("basePath", f"{path}/epochs").parquet(f"{path}/epochs/group={upto // every}")
    totals = spark.read.parquet(f"{path}/totals/upto={upto}").drop("every")
    return group.drop("group").withColumn("epoch", F.col("epoch").cast("long")).unionByName(totals)


def _latest(rows: DataFrame) -> DataFrame:
    cols = [c for c in rows.columns if c != "model_id"]
    return rows.groupBy("model_id").agg(F.max_by(F.struct(*cols), "epoch").alias("_t")).select("model_id", "_t.*")


def current_totals(spark: SparkSession, path: str) -> DataFrame:
    """Latest totals of each model: the last table of totals and at most as many epochs as lie between two of them."""
    last = spark.read.parquet(f"{path}/totals").agg(F.max(F.struct("upto", "every"))).first()[0]
    # the first table, and any of a stream without rows until then, has none
    upto, every = (last["upto"], last["every"]) if last else (0, None)
    if every is None:
        return _latest(spark.read.parquet(f"{path}/epochs").drop("group").withColumn("epoch", F.col("epoch").cast("long"))).drop("epoch")
    return _latest(_since(spark, path, upto, every)).drop("epoch")
