"""R2's other source: terminal captures that arrive as a stream, as log lines.

Of each run only its newest capture is state (at most the lines that the terminal keeps) and the number of lines so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.captures import complete_lines, new_lines
from .crash_stream import ROCKSDB


class NewestCapture(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "seq long, content string, n_lines long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, before, n = self.newest.get() if self.newest.exists() else (None, None, 0)
        captures = pd.concat(list(rows), ignore_index=True).sort_values("seq")
        for at, ts, content in zip(captures["seq"], captures["ts"], captures["content"]):
            if seq is not None and at <= seq:  # older than what is known, or given before
                continue
            new = new_lines(complete_lines(before), complete_lines(content))
            if new:
                yield pd.DataFrame({"run_id": key[0], "line_no": range(n, n + len(new)), "ts": ts, "line": new})
            seq, before, n = int(at), content, n + len(new)
        self.newest.update((seq, before, n))


def stream_capture_lines(captures: DataFrame) -> DataFrame:
    """Streaming (run_id, line_no, ts, line) from streaming captures (run_id, seq, ts, content).

    The rows are those of ``capture_lines``; a capture that arrives after a later one of its run was handled in an
    earlier batch is left out, as the later one held its lines.
    """
    kind = captures.schema["run_id"].dataType.simpleString()
    captures.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return captures.select("run_id", "seq", "ts", "content").groupBy("run_id").transformWithStateInPandas(
        NewestCapture(), f"run_id {kind}, line_no long, ts timestamp_ntz, line string", "Append", "None")
