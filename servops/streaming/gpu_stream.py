"""R3: latest sample of every GPU and live process list from streams of nvidia-smi CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gpu import latest_per_gpu, latest_processes, parse_gpu_samples


def live_gpu_latest(spark: SparkSession, path: str) -> DataFrame:
    """Each file is one poll, read whole: its lines keep their order, and of a GPU's lines the last one counts."""
    files = spark.readStream.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("ts"), F.col("value").alias("_whole"))
    lines = files.select("file", "ts", F.posexplode(F.split("_whole", "\n")).alias("_at", "line")) \
        .withColumn("sample_id", F.struct("file", "_at"))
    return latest_per_gpu(parse_gpu_samples(lines, keep=("sample_id", "ts"))) \
        .withColumns({"file": F.col("sample_id.file"), "line_no": F.col("sample_id._at")}).drop("sample_id")


def process_polls(reader, path: str) -> DataFrame:
    """``(host, ts, poll, text)`` of process list files, one poll a file; the folder of a file is its host.

    ``reader``: ``spark.read`` or ``spark.readStream``. A poll without processes must hold a line (a blank one, or a header of
    fewer fields): Spark lists no empty files.
    """
    file = F.col("_metadata.file_path")
    return reader.text(path, wholetext=True).select(
        F.regexp_extract(file, "^(.*)/[^/]*$", 1).alias("host"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("ts"), file.alias("poll"), F.col("value").alias("text"))


def live_gpu_processes(spark: SparkSession, path: str) -> DataFrame:
    """Processes running now, for complete output mode: each trigger gives the whole list. State is one poll a host."""
    return latest_processes(process_polls(spark.readStream, path))
