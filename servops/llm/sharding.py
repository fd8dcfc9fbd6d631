"""Sharding by vector bin packing (operator 1).

Groups of rows with equal texts are vectors of bytes, tokens and rows. They are placed, the largest first,
where the dot product of the vector with the shard's residual capacity is highest. So a shard that lacks
tokens more than rows draws groups rich in tokens, and the three quantities stay balanced together.

Groups above a set part of a shard's capacity are placed one by one. There can only be so many of them,
whatever the size of the corpus. The others meet in a fixed number of bundles by the hash of their text,
and a bundle is placed as a whole. A group that is larger than a shard is split into pieces by the hash of the id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: bundles of small groups a shard; a group above 1 / FINE of a shard in any quantity is placed alone
FINE = 256
#: rows that are numbered in one task, about, and the least number of such tasks a shard
ROWS_A_CELL, CELLS = 50_000, 64
#: how much more a quantity counts than the others
BYTES_WEIGHT = 4.0


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) and 8 for the row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def words_in(text: Column) -> Column:
    """Default number of tokens: places where a word begins."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def pack(vectors: np.ndarray, shards: int, weights: np.ndarray) -> np.ndarray:
    """Shard of each vector (rows of ``vectors``, in the order given): the highest dot product with residual capacity.

    Ties go to the lowest shard. Residual capacity may go below zero at the end.
    """
    total = np.maximum(vectors.sum(0, dtype=np.float64), 1.0)
    share = vectors / total * shards  # in shards
    left = np.ones((shards, vectors.shape[1]))
    out = np.empty(len(vectors), np.int64)
    for i, v in enumerate(share):
        k = int((left @ (v * weights)).argmax())
        left[k] -= v
        out[i] = k
    return out


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
                  tokens: Column | None = None, fine: int = FINE) -> DataFrame:
    """Where every row goes: ``id_col``, size, text_crc32, shard (from 0), slot (gapless from 0 in its shard).

    Law: the shards' sizes are nearly equal (tokens and rows too, as far as the groups allow). Rows with
    equal texts share a shard unless they are more than a shard holds. A null text is a group with the
    empty one's size. Rows with the same id and text stay together even when their group is split. The
    slots follow the hash of the id. No rows give no rows. Other columns aren't read.

    What comes to the driver is bounded by ``shards`` and ``fine``: a vector for each bundle, and the groups
    above 1 / ``fine`` of a shard (at most 3 * shards * fine).
    """
    text = F.col(text_col)
    count = tokens if tokens is not None else words_in(text)
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("id"), size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.xxhash64(text).alias("grp"), count.cast("long").alias("tok")))
    groups = rows.groupBy("grp").agg(F.sum("size").alias("b"), F.sum("tok").alias("t"), F.count(F.lit(1)).alias("r"))
    groups = cut_lineage(groups)
    total = groups.agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("r").alias("r")).first()
    dims = {k: max(total[k] or 0, 1) for k in "btr"}
    share = F.greatest(*[F.col(k) * F.lit(shards / v) for k, v in dims.items()])  # of a shard
    sized = groups.withColumn("share", share)
    alone = sized.where(F.col("share") > 1 / fine) \
        .withColumn("pieces", F.when(F.col("share") > 1, F.ceil(2 * F.col("share"))).otherwise(1).cast("int"))
    alone = cut_lineage(alone.select("grp", "pieces"))
    bundle = F.pmod("grp", F.lit(shards * fine))
    piece = F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("id", F.lit(17)), F.col("pieces"))).otherwise(0)
    # alone has at most 3 * shards * fine rows
    item = F.when(F.col("pieces").isNull(), F.struct(F.lit(False).alias("alone"), bundle.cast("long").alias("key"), F.lit(0).cast("long").alias("piece"))) \
        .otherwise(F.struct(F.lit(True).alias("alone"), F.col("grp").alias("key"), piece.cast("long").alias("piece")))
    marked = rows.join(F.broadcast(alone), "grp", "left").select("id", "size", "crc", "tok", item.alias("item"))
    vectors = marked.groupBy("item").agg(F.sum("size").alias("b"), F.sum("tok").alias("t"), F.count(F.lit(1)).alias("r")) \
        .select("item.*", "b", "t", "r").toPandas()

    v = vectors[["b", "t", "r"]].to_numpy(np.float64)
    rank = (v / np.array([dims[k] for k in "btr"])).max(1) if len(v) else np.zeros(0)
    order = np.lexsort((vectors["piece"], vectors["key"], vectors["alone"], -rank))
    vectors = vectors.iloc[order].reset_index(drop=True)
    vectors["shard"] = pack(vectors[["b", "t", "r"]].to_numpy(np.float64), shards, np.array([BYTES_WEIGHT, 1.0, 1.0]))
    placed = docs.sparkSession.createDataFrame(
        [(bool(a), int(k), int(p), int(s)) for a, k, p, s in zip(vectors["alone"], vectors["key"], vectors["piece"], vectors["shard"])],
        "alone boolean, key long, piece long, shard int")
    # as many rows as vectors: bounded
    out = marked.select("id", "size", "crc", "item.*").join(F.broadcast(placed), ["alone", "key", "piece"])

    # slots: rows are numbered in cells of a shard, after the counts of the cells before
    cells = max(CELLS, -(-(total["r"] or 0) // (shards * ROWS_A_CELL)))
    out = cut_lineage(out.select("id", "size", "crc", "shard", F.pmod(F.xxhash64("id", "crc"), F.lit(cells)).alias("cell")))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    start = out.groupBy("shard", "cell").count().select(
        F.col("shard").alias("s"), F.col("cell").alias("c"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "cell").orderBy("id", "crc")
    numbered = out.withColumn("n", F.row_number().over(inside) - 1)
    return numbered.join(start, (F.col("shard") == F.col("s")) & (F.col("cell") == F.col("c"))).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("n")).alias("slot"))
