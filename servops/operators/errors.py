"""Crash detection and the error catalog: buffers, known-error matching, mining, counts.

A run's crash buffer is every error-ish line of the run so far. It is kept as its lines, each with the
number of crashes before it (``error_segments``); a pattern that can only match inside a line hits a
crash when its first matching line of the run comes before it. So each *distinct* line meets each
pattern once, and nothing grows with the square of a run. Only patterns that can reach over line
ends are matched on the buffers' text.

Patterns are Python's: they are matched with ``re`` in Arrow batches, compiled once a task. A pattern
that Python refuses matches nothing but stays in the catalog, its counts and its ranking.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import logs as L
from ..functions.patterns import compiled, line_local, line_reach
from ..functions.text import py_strip, re_escape
from ..session import cut_lineage
from . import literals
from .ids import assign_dense_ids
from .ordering import prefix_sum, with_neighbour

# Patterns that travel to the tasks in one piece: rows, and characters in all.
MAX_PATTERNS, MAX_PATTERN_CHARS = 20_000, 4 << 20
# Line feeds up to which a match is looked for in neighbouring lines.
MAX_REACH = 16


def error_lines(lines: DataFrame) -> DataFrame:
    return lines.where(L.is_errorish("line")).select(
        "run_id", "line_no", "ts", "line", L.is_crash_sentinel("line").alias("is_crash"))


def error_segments(lines: DataFrame) -> DataFrame:
    """Error-ish lines with ``seg``, the number of crashes of the run before the line (written once)."""
    e = prefix_sum(error_lines(lines), ["run_id"], "line_no", F.col("is_crash").cast("int"), "seg", inclusive=False)
    return cut_lineage(e.select("run_id", "line_no", "ts", "line", "is_crash", "seg"))


def crash_events(segments: DataFrame) -> DataFrame:
    """One row per crash, and one per run that has error-ish lines but no crash (``at_end``).

    ``upto`` is the last segment the event's buffer holds.
    """
    crashes = segments.where("is_crash").select(
        "run_id", "line_no", "ts", F.lit(False).alias("at_end"), F.col("seg").alias("upto"))
    ends = segments.groupBy("run_id").agg(
        F.max_by(F.struct("line_no", "ts"), "line_no").alias("last"), F.bool_or("is_crash").alias("crashed")) \
        .where(~F.col("crashed")) \
        .select("run_id", "last.line_no", "last.ts", F.lit(True).alias("at_end"), F.lit(0).cast("long").alias("upto"))
    return crashes.unionByName(ends)


def crash_buffers(lines: DataFrame) -> DataFrame:
    """The buffer's text at every crash: all error-ish lines of the run so far.

    A view for display and for patterns that reach over line ends: its size is that of all buffers.
    """
    return _buffers(error_segments(lines))


def _buffers(segments: DataFrame, ends: bool = False) -> DataFrame:
    events = crash_events(segments)
    events = events if ends else events.where(~F.col("at_end"))
    seg = segments.groupBy("run_id", "seg").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_ls"), F.count(F.lit(1)).alias("_n"))
    seg = seg.withColumn("_text", F.array_join(F.transform("_ls", lambda x: F.concat(x["line"], F.lit("\n"))), ""))
    w = Window.partitionBy("run_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text = seg.select("run_id", F.col("seg").alias("upto"), F.sum("_n").over(w).alias("n_lines"),
                      F.array_join(F.collect_list("_text").over(w), "").alias("buffer"))
    return events.join(text, ["run_id", "upto"]).select(
        "run_id", "line_no", "ts", (F.col("upto") + 1).alias("crash_no"), "n_lines", "buffer", "at_end") \
        .drop(*([] if ends else ["at_end"]))


def _pattern_slices(catalog: DataFrame, size=None):
    """The catalog's (id, pattern) in pieces that fit a task, however large the catalog is; none of an empty one.

    ``size``: (patterns, characters) of the catalog where they are known.
    """
    p = catalog.select(F.col("id").cast("long").alias("id"), "error_pattern").where(F.col("error_pattern").isNotNull())
    n, chars = size or p.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("error_pattern")), F.lit(0))).first()
    slices = 1 + max(n // MAX_PATTERNS, chars // MAX_PATTERN_CHARS) if n else 0
    for k in range(slices):
        piece = p.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == k) if slices > 1 else p
        yield [(r["id"], r["error_pattern"]) for r in piece.collect()]


def _search(texts: DataFrame, keys: list[str], text_col: str, patterns: list[tuple[int, str]]) -> DataFrame:
    """(keys, error_id) for every pattern found in a text, in Arrow batches."""
    fields = {f.name: f.dataType.simpleString() for f in texts.schema}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + ", error_id long"

    def run(batches):
        search = [(i, compiled(p).search) for i, p in patterns]
        for b in batches:
            rows, ids = [], []
            for at, text in enumerate(b.column(len(keys)).to_pylist()):
                for i, found in search:
                    if found(text):
                        rows.append(at)
                        ids.append(i)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(len(keys))), pa.array(ids, pa.int64())],
                                             names=[*keys, "error_id"])
    return texts.select(*keys, text_col).mapInArrow(run, schema)


def _kinds(catalog: DataFrame) -> DataFrame:
    """(id, pattern, reach) of the patterns that Python takes; reach: line feeds a match can hold, -1 for a pattern
    that stays inside a line, null without a bound."""
    def run(batches):
        for b in batches:
            ids, patterns, reach = [], [], []
            for i, p in zip(*(c.to_pylist() for c in b.columns)):
                if compiled(p) is None:
                    continue
                r = -1 if line_local(p) else line_reach(p)
                ids.append(i)
                patterns.append(p)
                reach.append(int(r) if r <= MAX_REACH else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(patterns, pa.string()), pa.array(reach, pa.int32())],
                                             names=["id", "pattern", "reach"])
    p = catalog.select(F.col("id").cast("long").alias("id"), F.col("error_pattern").alias("pattern")).where(F.col("pattern").isNotNull())
    return cut_lineage(p.mapInArrow(run, "id long, pattern string, reach int"))


def neighbouring_lines(segments: DataFrame, reach: int) -> DataFrame:
    """(run_id, seg, text): each error-ish line of a run behind the ``reach`` before it, every line with its line feed.

    Neighbours come from (run, block) partitions and the blocks' edges, so no task holds a run.
    """
    d = segments.select("run_id", "line_no", "seg", F.concat("line", F.lit("\n")).alias("_l0"))
    for k in range(reach):
        # the line before, with what it knows of those before it
        d = with_neighbour(d, ["run_id"], "line_no", [f"_l{k}"], following=False, prefix="_p").withColumnRenamed(f"_p_l{k}", f"_l{k + 1}")
    return d.select("run_id", "seg", F.concat_ws("", *[F.col(f"_l{k}") for k in range(reach, -1, -1)]).alias("text"))


def find_hits(segments: DataFrame, events: DataFrame, catalog: DataFrame) -> DataFrame:
    """(run_id, line_no, ts, at_end, error_id): every event whose buffer a catalog pattern is found in.

    Patterns that stay inside a line meet the distinct lines, joined over a literal that they require where they
    have one; patterns that hold a bounded number of line feeds meet neighbouring lines. Only those without a bound
    (anchors, look-around, endless repeats over line ends) are searched in the buffers' text.
    """
    kinds = _kinds(catalog)
    # at most one row a number of line feeds
    sizes = {r["reach"]: (r["n"], r["chars"]) for r in kinds.groupBy("reach").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("pattern")).alias("chars")).collect()}
    kinds = kinds.withColumnRenamed("pattern", "error_pattern")
    found = [segments.select("run_id", F.lit(0).cast("long").alias("error_id"), "seg").limit(0)]
    if -1 in sizes:
        local = kinds.where("reach = -1")
        indexed = cut_lineage(literals.with_window(local.select("id", F.col("error_pattern").alias("pattern"))))
        distinct = segments.select("line").distinct()
        with_line = literals.lines_with(distinct, indexed)
        if indexed.count() < sizes[-1][0]:
            for piece in _pattern_slices(local.join(indexed.select("id"), "id", "left_anti")):
                with_line = with_line.unionByName(_search(distinct, ["line"], "line", piece))
        found.append(segments.join(with_line, "line").select("run_id", "error_id", "seg"))
    for reach in sorted(r for r in sizes if r is not None and r >= 0):
        texts = cut_lineage(neighbouring_lines(segments, reach))
        for piece in _pattern_slices(kinds.where(F.col("reach") == reach), sizes[reach]):
            hits = _search(texts.select("text").distinct(), ["text"], "text", piece)
            found.append(texts.join(hits, "text").select("run_id", "error_id", "seg"))
    first = found[0]
    for more in found[1:]:
        first = first.unionByName(more)
    first = first.groupBy("run_id", "error_id").agg(F.min("seg").alias("from_seg"))
    keys = ["run_id", "line_no", "ts", "at_end"]
    out = events.join(first, "run_id").where(F.col("from_seg") <= F.col("upto")).select(*keys, "error_id")
    for piece in _pattern_slices(kinds.where(F.col("reach").isNull()), sizes.get(None, (0, 0))):
        wanted = _buffers(segments, ends=True).join(events.select("run_id", "line_no"), ["run_id", "line_no"], "left_semi")
        out = out.unionByName(_search(wanted, keys, "buffer", piece))
    return out


def match_known_errors(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """All catalog entries found in the buffer of each crash, and at the end of each run without a crash."""
    segments = error_segments(lines)
    hits = find_hits(segments, crash_events(segments), catalog)
    return with_entries(hits, catalog)


def with_entries(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    entries = catalog.select(F.col("id").cast("long").alias("error_id"), "error_message", "solution")
    return hits.join(entries, "error_id").select(
        "run_id", "line_no", "ts", "at_end", F.col("error_id").cast("int").alias("error_id"), "error_message", "solution")


def unmatched_crashes(events: DataFrame, hits: DataFrame) -> DataFrame:
    """Crashes (not ends of runs) in which nothing known was found."""
    return events.where(~F.col("at_end")).join(hits.select("run_id", "line_no").distinct(), ["run_id", "line_no"], "left_anti")


def search_buffers(buffers: DataFrame, catalog: DataFrame) -> DataFrame:
    """(run_id, line_no, ts, at_end, error_id) for patterns found in buffers' text."""
    keys = ["run_id", "line_no", "ts", "at_end"]
    out = buffers.select(*keys, F.lit(0).cast("long").alias("error_id")).limit(0)
    for piece in _pattern_slices(catalog):
        usable = [(i, p) for i, p in piece if compiled(p) is not None]
        if usable:
            out = out.unionByName(_search(buffers, keys, "buffer", usable))
    return out


def _message(captures: list) -> Column:
    return py_strip(F.coalesce(*captures, F.lit(L.NEW_ERROR_FALLBACK)))


def messages_of_segments(segments: DataFrame, crashes: DataFrame) -> DataFrame:
    """The message of each crash: the first capture of the fixed patterns in order, over the run's lines so far."""
    firsts = [F.min_by(F.struct("seg", F.regexp_extract("line", p, 1).alias("message")),
                       F.when(F.regexp_extract("line", p, 1) != "", F.col("line_no"))).alias(f"_m{k}")
              for k, p in enumerate(L.NEW_ERROR_PATTERNS)]
    per_run = segments.groupBy("run_id").agg(*firsts)
    said = [F.when(F.col(f"_m{k}.seg") <= F.col("upto"), F.col(f"_m{k}.message")) for k in range(len(L.NEW_ERROR_PATTERNS))]
    return crashes.join(per_run, "run_id").select("run_id", "line_no", "ts", _message(said).alias("error_message"))


def messages_of_buffers(crashes: DataFrame) -> DataFrame:
    """The same from the buffers' text."""
    said = [F.nullif(F.regexp_extract("buffer", p, 1), F.lit("")) for p in L.NEW_ERROR_PATTERNS]
    return crashes.select("run_id", "line_no", "ts", _message(said).alias("error_message"))


def new_entries(messages: DataFrame, first_id: int) -> DataFrame:
    """Catalog entries of crashes that matched nothing (set form).

    The pattern is ``re.escape`` of the message's first 100 characters. Entries are deduplicated by lower-cased
    pattern; the earliest crash in time stands for an entry, and ids follow ``first_id`` in that order.
    """
    m = messages.withColumn("error_pattern", re_escape("error_message", L.NEW_PATTERN_MAX_CHARS))
    g = m.groupBy(F.lower("error_pattern").alias("_key")).agg(
        F.min_by(F.struct("error_pattern", "error_message", "run_id", "line_no", "ts"),
                 F.struct("ts", "run_id", "line_no")).alias("_f"),
        F.count(F.lit(1)).alias("n_crashes"))
    g = g.select("_f.error_pattern", "_f.error_message", F.col("_f.run_id").alias("first_run_id"),
                 F.col("_f.line_no").alias("first_line_no"), F.col("_f.ts").alias("first_seen"), "n_crashes")
    g = assign_dense_ids(g, ["first_seen", "first_run_id", "first_line_no"], "id", start=first_id)
    return g.select(F.col("id").cast("int").alias("id"), "error_pattern", "error_message",
                    F.lit(L.NEW_ERROR_SOLUTION).alias("solution"), "first_run_id", "first_line_no",
                    "first_seen", "n_crashes")


class ErrorJob:
    """The whole error job over a log: every part that others need is computed once."""

    def __init__(self, lines: DataFrame, catalog: DataFrame):
        self.catalog = cut_lineage(catalog)
        self.segments = error_segments(lines)
        self.events = cut_lineage(crash_events(self.segments))
        self.hits = cut_lineage(find_hits(self.segments, self.events, self.catalog))
        self.unmatched = unmatched_crashes(self.events, self.hits)
        # ids follow the largest of the whole catalog, entries that Python refuses included
        first_id = self.catalog.agg(F.max("id")).first()[0] or 0
        self.mined = cut_lineage(new_entries(messages_of_segments(self.segments, self.unmatched), int(first_id)))

    def occurrences(self) -> DataFrame:
        """Occurrence count and last-seen time per entry, known and mined.

        A known entry adds its hits (crashes and ends of runs) to its stored count. A mined entry counts the
        crashes that matched nothing known and hold its pattern: it came from them and didn't exist for others.
        """
        mined_hits = find_hits(self.segments, self.unmatched.select(self.events.columns),
                               self.mined.select("id", "error_pattern"))
        per = self.hits.unionByName(mined_hits).groupBy("error_id").agg(
            F.count(F.lit(1)).alias("_hits"), F.max("ts").alias("last_seen"))
        known = self.catalog.select("id", "error_pattern", "error_message", "solution",
                                    F.col("initial_count").cast("long").alias("initial_count"), "first_seen")
        new = self.mined.select("id", "error_pattern", "error_message", "solution",
                                F.lit(0).cast("long").alias("initial_count"), "first_seen")
        entries = known.unionByName(new)
        return entries.join(per, entries["id"] == per["error_id"], "left").select(
            "id", "error_pattern", "error_message", "solution",
            (F.col("initial_count") + F.coalesce("_hits", F.lit(0))).alias("occurrence_count"), "first_seen", "last_seen")


def error_ranking(occurrences: DataFrame) -> DataFrame:
    return occurrences.orderBy(F.col("occurrence_count").desc_nulls_first(), "id")
