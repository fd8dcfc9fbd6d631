"""API access log (``asctime - name - level - message``): parse and summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIME_RE = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}$"
LEVEL_RE = r"^[A-Z]+$"
REQUEST_RE = r"^Request: ([A-Z]+) (\S+)$"
RESPONSE_RE = r"^Response: (\d{3})$"
PATH_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def read_api_log(spark: SparkSession, path: str) -> DataFrame:
    """Log files as lines (``api_YYYYMMDD.log``), with the file they came from."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def parse_lines(lines: DataFrame) -> DataFrame:
    """One row per line. A line without the ``asctime - name - level - `` head is kept as ``unparsed``
    (a message of several lines continues on such lines)."""
    parts = F.split("value", " - ", 4)
    t = lines.select(parts.alias("p"))
    ok = (F.size("p") == 4) & F.col("p")[0].rlike(TIME_RE) & F.get("p", 2).rlike(LEVEL_RE)
    t = t.select(F.when(ok, F.struct(F.get("p", 0).alias("asctime"), F.get("p", 1).alias("logger"), F.get("p", 2).alias("level"),
                                     F.get("p", 3).alias("message"))).alias("h"))
    m = F.col("h.message")
    words = F.split(m, " ")
    is_request, is_response = m.rlike(REQUEST_RE), m.rlike(RESPONSE_RE)
    kind = (F.when(F.col("h").isNull(), F.lit("unparsed")).when(is_request, F.lit("request"))
            .when(is_response, F.lit("response")).otherwise(F.lit("other")))
    return t.select(
        "h.asctime", "h.logger", "h.level", kind.alias("kind"),
        F.when(is_request, F.get(words, 1)).alias("method"),
        F.when(is_request, F.regexp_extract(F.get(words, 2), PATH_RE, 1)).alias("path"),
        F.when(is_response, F.get(words, 1).cast("int")).alias("status"))


def summarize(parsed: DataFrame) -> DataFrame:
    """Requests by method and path, responses by status, other lines by level, and how many lines didn't parse."""
    return parsed.groupBy("kind", "level", "method", "path", "status").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("asctime").alias("first_seen"),
        F.max("asctime").alias("last_seen"))
