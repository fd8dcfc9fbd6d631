"""Spark session helpers.

Queries never build their own session: they receive one. ``build_session`` is
for tests, the bench and local runs.
"""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Python workers stay alive between tasks (inference batches, stateful streams).
    "spark.python.worker.reuse": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "servops", extra: dict | None = None) -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in spark.checkpoint.dir.

    Without that setting, a folder beside the tables of the warehouse, which executors share too.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    sc.setCheckpointDir(configured)
    return configured


def table_path(spark: SparkSession) -> str:
    """A new folder for a table in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, path: str | None = None, compression: str = "snappy") -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder.

    Survives executor loss (never a local checkpoint). Unlike an eager
    ``Dataset.checkpoint``, which computes its input twice (once to count,
    once to write), the input is computed once, and later scans of the
    table get column pruning and pushed-down filters.

    ``path``: from ``table_path``, for a table that parts are added to one after another (all so far are returned), or that
    is emptied later.
    """
    spark = df.sparkSession
    path = path or table_path(spark)
    df.write.mode("append").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def empty_table(table: DataFrame, path: str) -> None:
    """Takes the rows of a table that ``cut_lineage`` wrote at ``path`` from the disks, once nothing reads them any more."""
    table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Inside, what a job shuffled goes from the disks as soon as it has ended, not when the driver collects its garbage.

    For work in steps that each write a table: a frame whose job is run again makes its shuffles again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
