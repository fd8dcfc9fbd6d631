"""GPU telemetry expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_

# Utilisation bands (percent) used for colouring.
BAND_LOW_BELOW = 30
BAND_MID_BELOW = 70
MB_PER_GB = 1024
PROCESS_NAME_MAX = 20
PROCESS_NAME_KEEP = 18
PROCESS_TYPE_COMPUTE = "C"


def band(pct) -> Column:
    p = col_(pct)
    return (F.when(p < BAND_LOW_BELOW, "low")
            .when(p < BAND_MID_BELOW, "mid")
            .when(p.isNotNull(), "high"))


def memory_pct(used, total) -> Column:
    """used/total*100; a zero total gives null instead of Infinity/NaN."""
    return F.try_divide(col_(used), col_(total)) * 100


def mb_to_gb(mb) -> Column:
    return col_(mb) / MB_PER_GB


def short_name(name) -> Column:
    return F.element_at(F.split(col_(name), " "), -1)


def short_process_name(name) -> Column:
    n = col_(name)
    return F.when(F.char_length(n) > PROCESS_NAME_MAX,
                  F.concat(F.substring(n, 1, PROCESS_NAME_KEEP), F.lit("..."))).otherwise(n)
