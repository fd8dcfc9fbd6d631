"""Dense id assignment without a global window (which would run in one task)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def assign_dense_ids(df: DataFrame, order_cols: list, id_col: str = "id", start=0) -> DataFrame:
    """Number rows 1..n in ``order_cols`` order and add ``start`` (an int or a Column).

    The sort is a distributed range sort. Row positions inside each sorted
    partition come from ``monotonically_increasing_id`` (partition id in the
    upper 31 bits, row index in the lower 33); per-partition counts give the
    offsets. The offsets table has one row per partition, so broadcasting it
    is bounded by the partition count. ``order_cols`` must be a total order.
    """
    s = (df.sort(*order_cols)
           .withColumn("_pid", F.spark_partition_id())
           .withColumn("_mid", F.monotonically_increasing_id()))
    s = cut_lineage(s)  # fixes the partition layout both branches below see
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    start_col = start if not isinstance(start, (int, float)) else F.lit(start)
    return (s.join(F.broadcast(offsets), "_pid")
             .withColumn(id_col, (start_col + F.col("_off") + local + 1).cast("long"))
             .drop("_pid", "_mid", "_off"))
