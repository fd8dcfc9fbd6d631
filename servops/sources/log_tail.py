"""Streaming source of log files that still grow: complete lines by byte position, each once.

The offset of a stream is, for every file, the byte after its last line feed, so a line that is still being written is
held back until it ends. Only names, sizes and the last bytes of files that grew pass the driver; the lines are read
in tasks, in pieces of bounded size. Files are reached with Arrow's file systems, so the folder may be a local path
that all machines mount, or a store such as HDFS or S3.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .engine_logs import line_time

#: bytes of a piece that a task reads; bytes that are read at once
PIECE, AT_ONCE = 64 << 20, 1 << 20
SCHEMA = "run_id string, line_no long, changed timestamp_ntz, time string, line string"
_TIME = rb"(?:\d{4}-)?\d{2}-\d{2} \d{2}:\d{2}:\d{2}"


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    fs, inside = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs, inside


def after_last_line(fs: pafs.FileSystem, path: str, low: int, size: int) -> int:
    """The byte after the last line feed of the file's first ``size`` bytes, ``low`` if there is none behind it."""
    with fs.open_input_file(path) as f:
        end = size
        while end > low:
            begin = max(low, end - AT_ONCE)
            f.seek(begin)
            at = f.read(end - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return low


def time_before(fs: pafs.FileSystem, path: str, end: int) -> bytes:
    """The last time written in the file's first ``end`` bytes, which end with a line; empty if there is none."""
    with fs.open_input_file(path) as f:
        while end > 0:
            begin = after_last_line(fs, path, 0, max(0, end - AT_ONCE))  # whole lines, so no time is cut
            f.seek(begin)
            found = re.findall(_TIME, f.read(end - begin))
            if found:
                return found[-1]
            end = begin
    return b""


def lines_between(fs: pafs.FileSystem, path: str, piece: int, stop: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(byte position, line, time) of the lines that begin from ``piece`` on and before ``piece`` + ``PIECE``.

    ``stop`` is the end of a line. ``time`` is the last one written in the line or before it.
    """
    at = after_last_line(fs, path, 0, piece)
    time = time_before(fs, path, at)
    with fs.open_input_file(path) as f:
        f.seek(at)
        rest = b""
        while at < min(stop, piece + PIECE):
            got = f.read(min(AT_ONCE, stop - at - len(rest)))
            if not got:
                return
            *whole, rest = (rest + got).split(b"\n")
            for line in whole:
                if at >= piece + PIECE:
                    return
                stamp = re.search(_TIME, line)
                time = stamp.group() if stamp else time
                if at >= piece:
                    yield at, line, time
                at += len(line) + 1


class _Piece(InputPartition):
    def __init__(self, path: str, piece: int, stop: int, changed):
        self.path, self.piece, self.stop, self.changed = path, piece, stop, changed


class _TailReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path
        self.known: dict[str, tuple[int, int]] = {}  # file -> size and offset seen last, so that only grown files are opened

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        fs, folder = _folder(self.path)
        out = {}
        for info in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if info.type != pafs.FileType.File or info.base_name.startswith((".", "_")):
                continue
            size, at = self.known.get(info.path, (0, 0))
            if info.size != size:
                at = after_last_line(fs, info.path, at if info.size > size else 0, info.size)
                self.known[info.path] = (info.size, at)
            if at:
                out[info.path] = at
        return {"files": json.dumps(out, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[_Piece]:
        fs, _ = _folder(self.path)
        before, after = json.loads(start["files"]), json.loads(end["files"])
        grown = {p: (before.get(p, 0), stop) for p, stop in after.items() if stop != before.get(p, 0)}
        shrunk = sorted(p for p, (low, stop) in grown.items() if stop < low)
        if shrunk:
            raise ValueError(f"log files got shorter; a log that starts anew needs a new name: {shrunk[:5]}")
        infos = {i.path: i for i in fs.get_file_info(list(grown))} if grown else {}
        return [_Piece(p, at, stop, infos[p].mtime.replace(tzinfo=None))
                for p, (low, stop) in grown.items() for at in range(low, stop, PIECE)]

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        fs, _ = _folder(self.path)
        names = ["run_id", "line_no", "changed", "time", "line"]

        def pack(held):
            n = len(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([partition.path] * n, pa.string()), pa.array([at for at, _, _ in held], pa.int64()),
                 pa.array([partition.changed] * n, pa.timestamp("us")), pa.array([t.decode() for _, _, t in held], pa.string()),
                 pa.array([x.removesuffix(b"\r").decode("utf-8", "replace") for _, x, _ in held], pa.string())], names=names)
        held = []
        for row in lines_between(fs, partition.path, partition.piece, partition.stop):
            held.append(row)
            if len(held) == 4096:
                yield pack(held)
                held = []
        if held:
            yield pack(held)


class LogTail(DataSource):
    """``spark.readStream.format("servops_log_tail").load(folder)``: complete lines of the folder's files as they grow."""

    @classmethod
    def name(cls) -> str:
        return "servops_log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _TailReader:
        return _TailReader(self.options["path"])


def stream_growing_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming (run_id, line_no, ts, line) of the files of a folder, each a run whose log may still grow.

    A line is given once, when its line feed is there; ``line_no`` is the byte it begins at, so lines of a run are in
    order. Files whose names begin with a dot or underscore are left out; one that gets shorter fails the query.
    ``ts`` is the last time written in the line or before it, so a traceback's lines have that of the line that began it;
    a line before any time has the file's last change when the batch was planned.
    """
    spark.dataSource.register(LogTail)
    lines = spark.readStream.format("servops_log_tail").load(folder)
    return lines.select("run_id", "line_no", line_time(F.col("time"), F.col("changed")).alias("ts"), "line")
