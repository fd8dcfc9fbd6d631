"""GPU telemetry: CSV samples -> typed rows -> display metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gpu as G
from ..functions.text import py_is_blank, py_strip

SAMPLE_FIELDS = [("gpu_index", "int"), ("name", "string"), ("temperature", "double"),
                 ("utilization", "double"), ("mem_used", "double"), ("mem_total", "double"),
                 ("power_draw", "double"), ("power_limit", "double")]
PROCESS_FIELDS = [("gpu_id", "int"), ("pid", "int"), ("name", "string"), ("memory_usage", "double")]


def _parse_csv(lines: DataFrame, fields, keep: list[str]) -> DataFrame:
    """Split on commas, strip every part, skip blank lines and rows that are too short.

    Numbers that do not parse become null (a deliberate difference: the
    reference fails the whole poll on one bad cell).
    """
    parts = F.split("line", ",")  # stripping never changes the field count
    t = lines.where(~py_is_blank("line") & (F.size(parts) >= len(fields)))
    cols = []
    for i, (name, typ) in enumerate(fields):
        v = py_strip(F.element_at(parts, i + 1))
        cols.append((v if typ == "string" else (v).try_cast(typ)).alias(name))
    return t.select(*keep, *cols)


def parse_gpu_samples(lines: DataFrame, keep=("sample_id", "ts")) -> DataFrame:
    return _parse_csv(lines, SAMPLE_FIELDS, list(keep))


def parse_gpu_processes(lines: DataFrame, keep=("sample_id",)) -> DataFrame:
    p = _parse_csv(lines, PROCESS_FIELDS, list(keep))
    return p.withColumn("type", F.lit(G.PROCESS_TYPE_COMPUTE))


def gpu_metrics(samples: DataFrame) -> DataFrame:
    """Memory percent (null when total is 0), GB values, bands, short name. Raw doubles."""
    pct = G.memory_pct("mem_used", "mem_total")
    return samples.select(
        "sample_id", "gpu_index", G.short_name("name").alias("short_name"),
        "utilization", G.band("utilization").alias("utilization_band"),
        pct.alias("memory_pct"), G.band(pct).alias("memory_band"),
        G.mb_to_gb("mem_used").alias("mem_used_gb"), G.mb_to_gb("mem_total").alias("mem_total_gb"))


def gpu_process_view(procs: DataFrame) -> DataFrame:
    return procs.select("sample_id", "gpu_id", "pid", G.short_process_name("name").alias("display_name"),
                        "memory_usage", G.mb_to_gb("memory_usage").alias("memory_gb"), "type")


def poll_processes(text) -> Column:
    """Array of the processes that one poll's whole text lists; blank and short lines are skipped."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~py_is_blank(x) & (F.size(F.split(x, ",")) >= len(PROCESS_FIELDS)))

    def row(line):
        cells = [py_strip(F.get(F.split(line, ","), F.lit(i))) for i in range(len(PROCESS_FIELDS))]
        return F.struct(*[(c if typ == "string" else c.try_cast(typ)).alias(name) for c, (name, typ) in zip(cells, PROCESS_FIELDS)])
    return F.transform(lines, row)


def latest_processes(polls: DataFrame) -> DataFrame:
    """Processes of each host's latest poll, from ``(host, ts, poll, text)``, one row a poll.

    A poll replaces the host's whole list, so a process that it doesn't list has ended, and a poll without
    processes empties the list. Partial ``max_by``: one poll a host and task is shuffled.
    """
    last = polls.groupBy("host").agg(F.max_by(F.struct("ts", poll_processes("text").alias("p")), F.struct("ts", "poll")).alias("_s"))
    return last.select("host", F.col("_s.ts").alias("ts"), F.inline("_s.p")).withColumn("type", F.lit(G.PROCESS_TYPE_COMPUTE))


def latest_per_gpu(samples: DataFrame) -> DataFrame:
    """Most recent sample of every device (partial max_by: one row per device per task)."""
    g = samples.groupBy("gpu_index").agg(
        F.max_by(F.struct(*[c for c in samples.columns if c != "gpu_index"]),
                 F.struct("ts", "sample_id")).alias("_s"))
    return g.select("gpu_index", "_s.*")
