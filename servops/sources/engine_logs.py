"""Engine log files (``vllm_YYYYMMDD.log``) and GPU CSV files as line tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.logs import log_tail

#: ``03-15 10:20:30`` or ``2024-03-15 10:20:30`` in a line
LINE_TIME = r"(?:(\d{4})-)?(\d{2}-\d{2} \d{2}:\d{2}:\d{2})"


def line_time(line: Column, changed: Column, or_changed: bool = True) -> Column:
    """The time written in a line, its year from ``changed`` if the line has none; without a time ``changed``, or null."""
    year = F.coalesce(F.nullif(F.regexp_extract(line, LINE_TIME, 1), F.lit("")), F.date_format(changed, "yyyy"))
    stamp = F.nullif(F.regexp_extract(line, LINE_TIME, 2), F.lit(""))
    when = F.try_to_timestamp(F.concat_ws("-", year, stamp), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return F.coalesce(F.when(stamp.isNotNull(), when), changed) if or_changed else F.when(stamp.isNotNull(), when)


def read_engine_logs(spark: SparkSession, path: str) -> DataFrame:
    """``(run_id, line_no, ts, line)`` where a run is a file and lines are numbered from 0.

    A text split carries no line number. Rows of one split are contiguous in one scan partition, in file order,
    so a row's place in its split comes from its place in the partition; the lines of the splits before it
    are counted in a scan of their own (one row a split comes out of it). Files may be of any size.

    ``ts`` is the last time written in the line or before it (the year, if it has none, is that of the file's
    modification), so a traceback's lines have that of the line that began it; a line before any time has the file's
    modification time.
    """
    t = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("run_id"), F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("_changed"),
        F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    t = t.withColumn("ts", line_time(F.col("line"), F.col("_changed"), or_changed=False))
    splits = t.groupBy("run_id", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"),
                                               F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("_row"))).alias("_last"))
    before = Window.partitionBy("run_id").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("run_id", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                           F.last("_last", ignorenulls=True).over(before).alias("_begin"))
    return t.mapInArrow(_filled, t.schema).join(splits, ["run_id", "_start"]).select(
        "run_id", (F.col("_row") + F.col("_shift")).alias("line_no"), F.coalesce("ts", "_begin", "_changed").alias("ts"), "line")


def tail_newest_log(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    """Last ``n`` lines of the newest log under ``path`` (largest file name, which holds the date); no other file is read.

    The newest one is told from the listing. No file under ``path`` gives no lines.
    """
    newest = spark.read.format("binaryFile").load(path).agg(F.max("path")).first()[0]
    lines = read_engine_logs(spark, newest if newest else path)
    return log_tail(lines, n)


def _filled(batches):
    """Rows of a scan partition with a null ``ts`` replaced by the last one before it in the split."""
    split, known = None, pa.scalar(None, pa.timestamp("us"))
    for b in batches:
        if not b.num_rows:
            continue
        run, start, ts = b.column(0).dictionary_encode().indices.to_numpy(), b.column(1).to_numpy(), b.column(5)
        begin = np.r_[True, (run[1:] != run[:-1]) | (start[1:] != start[:-1])]
        first = (b.column(0)[0].as_py(), start[0])
        carried = first == split
        # the row that each row takes its time from: the last one with a time, no earlier than its split's first
        at = np.arange(b.num_rows)
        has = np.maximum.accumulate(np.where(ts.is_valid().to_numpy(zero_copy_only=False), at, -1))
        low = np.maximum.accumulate(np.where(begin, at, 0))
        filled = ts.take(pa.array(np.where(has >= low, has, 0), mask=has < low))
        if carried:
            filled = pc.if_else(pa.array((low == 0) & (has < 0)), known, filled)
        split, known = (b.column(0)[b.num_rows - 1].as_py(), start[-1]), filled[b.num_rows - 1]
        yield b.set_column(5, "ts", filled)


def read_csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """nvidia-smi CSV output files as raw lines (field counting needs the raw text)."""
    return spark.read.text(path).select(
        F.monotonically_increasing_id().alias("sample_id"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("ts"),
        F.col("value").alias("line"))
