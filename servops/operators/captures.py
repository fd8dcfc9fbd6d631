"""Terminal captures as log lines: what is new in each capture of a screen that scrolls.

A capture holds the last lines of a run, at most so many as the terminal keeps. The next one begins with the same
lines, or further down if the window has slid; its new lines are those behind the overlap.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import prefix_sum, with_neighbour


def complete_lines(content: str | None) -> list[str]:
    """The capture's lines that have ended; the last one, still being written, is held back."""
    return (content or "").split("\n")[:-1]


def _agreement(a: list[str], b: list[str]) -> list[int]:
    """For each place of ``b``, how many lines from there on are those that ``a`` begins with."""
    both = a + [None] + b
    z = [0] * len(both)
    low = high = 0
    for i in range(1, len(both)):
        k = min(high - i, z[i - low]) if i < high else 0
        while i + k < len(both) and both[k] is not None and both[k] == both[i + k]:
            k += 1
        z[i] = k
        if i + k > high:
            low, high = i, i + k
    return z[len(a) + 1:]


def new_lines(before: list[str], now: list[str]) -> list[str]:
    """The lines of ``now`` behind its overlap with ``before``.

    The overlap is the longest end of ``before`` that ``now`` begins with. Where there is none (a line that was on the
    screen has changed), it is the longest stretch of ``before`` that ``now`` begins with, the first of them; all lines are
    new if that is none as well.
    """
    same = _agreement(now, before)
    for at, k in enumerate(same):
        if k == len(before) - at:
            return now[k:]
    return now[max(same, default=0):]


def capture_lines(captures: DataFrame, block: int = 1 << 10) -> DataFrame:
    """(run_id, line_no, ts, line) from captures (run_id, seq, ts, content), ``seq`` integral and unique in a run.

    Each capture meets the one before it, found over blocks of ``seq``, so a run may have any number of captures; line
    numbers are running sums. A null content counts as empty.
    """
    both = with_neighbour(captures.select("run_id", "seq", "ts", "content"), ["run_id"], "seq", ["content"], following=False,
                          prefix="before_", block=block)
    kind = captures.schema["run_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [new_lines(complete_lines(before), complete_lines(content))
                     for content, before in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.list_(pa.string()))],
                                             names=["run_id", "seq", "ts", "lines"])
    new = cut_lineage(both.mapInArrow(run, f"run_id {kind}, seq long, ts timestamp_ntz, lines array<string>"))
    first = prefix_sum(new, ["run_id"], "seq", F.size("lines"), "_first", inclusive=False, block=block)
    return first.select("run_id", "_first", "ts", F.posexplode("lines").alias("_at", "line")) \
        .select("run_id", (F.col("_first") + F.col("_at")).alias("line_no"), "ts", "line")
