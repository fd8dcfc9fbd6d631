"""R2: live crash detection over streaming engine-log lines.

Error-ish lines are kept per run as list state (``transformWithState``), to which a batch appends its own lines;
every crash sentinel emits the buffer so far at once. A line that arrives late, but inside the watermark, takes
its place by line number, and the crashes after it are emitted again with a higher ``turn``: of each crash
the row of the highest turn counts. A run whose log is silent for ``idle`` of *event time* is finished: if it
never crashed, its buffer is emitted once with ``at_end``, and its state is dropped. The timeout follows a
watermark on the line timestamp, so replaying old logs (or an ``availableNow`` trigger) ends, and a restarted
job times runs out exactly as the first attempt did. ``foreachBatch`` then matches each micro-batch
against the catalog (known errors) and mines the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from ..functions import logs as L
from ..operators import errors as E
from ..sources.engine_logs import line_time

OUTPUT_FIELDS = ("line_no long, ts timestamp_ntz, crash_no long, n_lines long, buffer string, at_end boolean, "
                 "turn long")
LINE_STATE = "line_no long, ts timestamp_ntz, line string, is_crash boolean"
#: emissions so far, newest event time, largest line number, line of the last crash (-1: none)
RUN_STATE = "turn long, last_ms long, last_line long, last_crash long"
_KEPT = ["line_no", "ts", "line", "is_crash"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_engine_logs(spark: SparkSession, path: str) -> DataFrame:
    """Streaming (run_id, line_no, ts, line) of log files, each a finished run read whole when it appears."""
    files = spark.readStream.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("run_id"),
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("_changed"),
        F.regexp_replace("value", r"\n$", "").alias("_whole"))
    lines = files.select("run_id", "_changed", F.posexplode(F.split("_whole", "\n")).alias("line_no", "line"))
    return lines.select("run_id", F.col("line_no").cast("long").alias("line_no"),
                        line_time(F.col("line"), F.col("_changed")).alias("ts"), "line")


class CrashBuffers(StatefulProcessor):
    """A run's error lines as list state, appended to; they are read when a crash or a late line asks for them.

    A batch without either costs its own lines, whatever the run holds already.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", LINE_STATE)
        self.run = handle.getValueState("run", RUN_STATE)

    def _all_lines(self) -> pd.DataFrame:
        lines = pd.DataFrame([tuple(x) for x in self.lines.get()], columns=_KEPT)
        return lines.drop_duplicates("line_no").sort_values("line_no", ignore_index=True)

    def _rows(self, key, lines: pd.DataFrame, at: list[int], turn: int, at_end: bool) -> pd.DataFrame:
        """An output row for each position in ``at``: the buffer holds the lines up to it."""
        crash_no = lines["is_crash"].astype(bool).cumsum()
        return pd.DataFrame([(key[0], lines["line_no"].iat[i], lines["ts"].iat[i], int(crash_no.iat[i]) + at_end, i + 1,
                              "".join(lines["line"].iloc[:i + 1] + "\n"), at_end, turn) for i in at],
                            columns=["run_id", "line_no", "ts", "crash_no", "n_lines", "buffer", "at_end", "turn"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        turn, last_ms, last_line, last_crash = self.run.get() if self.run.exists() else (0, 0, -1, -1)
        new = pd.concat(list(rows), ignore_index=True)
        fresh = new.drop_duplicates("line_no")
        if (fresh["line_no"] <= last_line).any():  # late lines, or lines that were given before
            fresh = fresh[~fresh["line_no"].isin(set(self._all_lines()["line_no"]))]
        last_ms = max(last_ms, int(new["event_ms"].max()))
        if len(fresh):
            turn += 1
            kept = fresh[_KEPT].sort_values("line_no")
            self.lines.appendList([(int(n), t, x, bool(c)) for n, t, x, c in zip(kept["line_no"], [t.to_pydatetime() for t in kept["ts"]], kept["line"], kept["is_crash"])])
            crashes = kept["line_no"][kept["is_crash"].astype(bool)]
            last_line = max(last_line, int(kept["line_no"].max()))
            last_crash = max(last_crash, int(crashes.max()) if len(crashes) else -1)
            first = int(kept["line_no"].min())
            if last_crash >= first:  # crashes at or after the first line that is new
                lines = self._all_lines()
                at = [int(i) for i in lines.index[lines["is_crash"].astype(bool) & (lines["line_no"] >= first)]]
                yield self._rows(key, lines, at, turn, False)
        self.run.update((turn, last_ms, last_line, last_crash))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(max(last_ms + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        turn, _, _, last_crash = self.run.get() if self.run.exists() else (0, 0, -1, 0)
        if last_crash < 0:
            lines = self._all_lines()
            yield self._rows(key, lines, [len(lines) - 1], turn + 1, True)
        self.lines.clear()
        self.run.clear()


def live_crashes(lines: DataFrame, idle_minutes: int = 30) -> DataFrame:
    """``lines``: streaming (run_id, line_no, ts, line). Returns rows per crash and per finished run without one.

    Lines later than the watermark (``idle_minutes`` behind the newest timestamp seen) are dropped, so they
    must arrive within that delay.
    """
    e = (lines.withColumn("event_time", F.col("ts").cast("timestamp"))
              .withWatermark("event_time", f"{idle_minutes} minutes")
              .where(L.is_errorish("line"))
              .select("run_id", "line_no", "ts", "line", L.is_crash_sentinel("line").alias("is_crash"),
                      F.unix_millis("event_time").alias("event_ms"), "event_time"))
    kind = lines.schema["run_id"].dataType.simpleString()
    # list state and timers need this state store
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return e.groupBy("run_id").transformWithStateInPandas(
        CrashBuffers(idle_minutes * 60 * 1000), f"run_id {kind}, {OUTPUT_FIELDS}", "Append", "EventTime")


def final_crashes(rows: DataFrame) -> DataFrame:
    """The row of the highest turn of each crash."""
    rest = [c for c in rows.columns if c not in ("run_id", "line_no")]
    return rows.groupBy("run_id", "line_no").agg(F.max_by(F.struct(*rest), "turn").alias("_r")) \
        .select("run_id", "line_no", "_r.*")


def _write_epoch(df: DataFrame, path: str, epoch_id: int) -> None:
    """Write a micro-batch as its own ``epoch`` folder; a replayed epoch replaces it, with no rows as well."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch_id}")


def _earlier_epochs(spark, path: str, epoch_id: int) -> DataFrame | None:
    try:
        return spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/epoch=*").where(F.col("epoch") < epoch_id)
    except AnalysisException:  # nothing written yet
        return None


def turns_path(hits_path: str) -> str:
    return f"{hits_path.rstrip('/')}_turns"


def _last_turns(spark, hits_path: str) -> DataFrame:
    turns = spark.read.option("basePath", turns_path(hits_path)).parquet(f"{turns_path(hits_path)}/epoch=*")
    return turns.groupBy("run_id", "line_no").agg(F.max("turn").alias("turn"))


def current_hits(spark: SparkSession, hits_path: str) -> DataFrame:
    """The hits of each crash's highest turn: a late line changes a crash's hits, it doesn't add to them."""
    hits = spark.read.option("basePath", hits_path).parquet(f"{hits_path.rstrip('/')}/epoch=*")
    return hits.join(_last_turns(spark, hits_path), ["run_id", "line_no", "turn"])


def current_new_errors(spark: SparkSession, catalog: DataFrame, hits_path: str, new_errors_path: str) -> DataFrame:
    """The mined errors without those that a late line has made known ones.

    An error stays while a crash that it was mined from has no later turn, or while a crash of the highest turn
    holds it and nothing of the catalog.
    """
    mined = spark.read.option("basePath", new_errors_path).parquet(f"{new_errors_path.rstrip('/')}/epoch=*")
    hits = current_hits(spark, hits_path).select("run_id", "line_no", F.col("error_id").alias("id"))
    known = hits.join(catalog.select("id"), "id").select("run_id", "line_no").distinct()
    alone = hits.join(known, ["run_id", "line_no"], "left_anti").select("id").distinct()
    source = _last_turns(spark, hits_path).withColumnsRenamed({"run_id": "first_run_id", "line_no": "first_line_no"})
    as_mined = mined.join(source, ["first_run_id", "first_line_no", "turn"]).select("id")
    several = mined.where("n_crashes > 1").select("id")
    return mined.join(as_mined.unionByName(several).unionByName(alone).distinct(), "id", "left_semi")


def alert_batch(catalog: DataFrame, hits_path: str, new_errors_path: str):
    """``foreachBatch`` handler: known-error hits and newly mined errors of a micro-batch.

    Buffers are matched once against the catalog and every error mined in earlier epochs, so a new error
    is mined once and later crashes count as its hits. Ends of runs only match. New ids continue after the
    largest id of the whole catalog and of the earlier epochs. A replayed epoch replaces its rows.

    A crash that a late line changes comes again with a higher ``turn``. Every row has its turn, and the turns of all
    crashes are written beside ``hits_path`` (``turns_path``): ``current_hits`` and ``current_new_errors`` read what holds.
    """
    cols = ["id", "error_pattern", "error_message", "solution"]

    def handle(crashes: DataFrame, epoch_id: int) -> None:
        spark = crashes.sparkSession
        crashes = crashes.persist()
        try:
            known = catalog.select(*cols)
            prior = _earlier_epochs(spark, new_errors_path, epoch_id)
            if prior is not None:
                known = known.unionByName(prior.select(*cols))
            found = E.search_buffers(crashes, known).persist()
            turns = crashes.select("run_id", "line_no", "turn")
            _write_epoch(turns, turns_path(hits_path), epoch_id)
            _write_epoch(E.with_entries(found, known).join(turns, ["run_id", "line_no"]), hits_path, epoch_id)
            first_id = known.agg(F.max("id")).first()[0] or 0
            unmatched = E.unmatched_crashes(crashes, found)
            mined = E.new_entries(E.messages_of_buffers(unmatched), int(first_id))
            source = turns.withColumnsRenamed({"run_id": "first_run_id", "line_no": "first_line_no"})
            _write_epoch(mined.join(source, ["first_run_id", "first_line_no"]), new_errors_path, epoch_id)
            found.unpersist()
        finally:
            crashes.unpersist()
    return handle
