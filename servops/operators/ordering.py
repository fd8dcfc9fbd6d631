"""Positions inside ordered groups, computed without putting a whole group in one task.

A group (a log run, a request) may hold a third of all rows. A window
partitioned by the group key alone would process it in one task; here the
group is cut into fixed-width blocks of the order column, each block is
numbered by its own window, and block offsets come from a per-block count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 1 << 16


def prefix_sum(df: DataFrame, keys: list[str], order_col: str, value, out: str,
               inclusive: bool = True, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Running sum of ``value`` inside each group in ``order_col`` order.

    ``(keys, order_col)`` must be unique and ``order_col`` integral. Work per
    task is bounded by the block width, not by the group size.
    """
    v = value if not isinstance(value, str) else F.col(value)
    blk = F.floor(F.col(order_col) / F.lit(block)).cast("long")
    b = df.withColumn("_blk", blk).withColumn("_v", v.cast("long"))
    sums = b.groupBy(*keys, "_blk").agg(F.sum("_v").alias("_bs"))
    wo = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_blk", F.coalesce(F.sum("_bs").over(wo), F.lit(0)).alias("_boff"))
    end = Window.currentRow if inclusive else -1
    wl = Window.partitionBy(*keys, "_blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, end)
    return (b.withColumn("_lsum", F.coalesce(F.sum("_v").over(wl), F.lit(0)))
             .join(offsets, [*keys, "_blk"])
             .withColumn(out, (F.col("_boff") + F.col("_lsum")).cast("long"))
             .drop("_blk", "_v", "_lsum", "_boff"))


def ordered_index(df: DataFrame, keys: list[str], order_col: str, out: str = "idx",
                  block: int = DEFAULT_BLOCK) -> DataFrame:
    """Add ``out`` = 0-based position of the row in its group ordered by ``order_col``."""
    return prefix_sum(df, keys, order_col, F.lit(1), out, inclusive=False, block=block)


def with_neighbour(df: DataFrame, keys: list[str], order_col: str, cols: list[str], following: bool = True,
                   prefix: str | None = None, block: int = DEFAULT_BLOCK) -> DataFrame:
    """Attach ``cols`` of the next (``following``) or previous row of the group in ``order_col`` order.

    Same result as ``lead``/``lag`` over a per-group window, without putting
    a whole group in one task: rows are windowed inside (group, block of
    ``order_col``) partitions, and a row at a block edge takes its neighbour
    from a per-block edge table (first/last row of each block, one row per
    block, partially aggregated before its shuffle). The data itself is
    shuffled once; the left join to the edge table keeps that partitioning.
    ``(keys, order_col)`` must be unique and ``order_col`` integral.
    """
    prefix = prefix if prefix is not None else ("next_" if following else "prev_")
    b = df.withColumn("_blk", F.floor(F.col(order_col) / F.lit(block)).cast("long"))
    w = Window.partitionBy(*keys, "_blk").orderBy(order_col)
    shift = F.lead if following else F.lag
    inner = b.withColumn("_in", shift(F.struct(*cols)).over(w)) \
             .withColumn("_has", shift(F.lit(True)).over(w).isNotNull())
    edge = F.min_by if following else F.max_by
    edges = b.groupBy(*keys, "_blk").agg(edge(F.struct(*cols), F.col(order_col)).alias("_e"))
    wb = Window.partitionBy(*keys).orderBy("_blk")
    nb = edges.select(*keys, "_blk", shift("_e").over(wb).alias("_nb"))
    j = inner.join(nb, [*keys, "_blk"], "left")
    return j.select(*df.columns, *[F.when(F.col("_has"), F.col("_in")[c]).otherwise(F.col("_nb")[c])
                                   .alias(prefix + c) for c in cols])
