"""Engine-log mining: classes, progress collapse, state timeline, health, tail."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import logs as L
from ..functions.text import unescape_unicode
from .ordering import DEFAULT_BLOCK, ordered_index, with_neighbour


def classify_lines(lines: DataFrame) -> DataFrame:
    """Drop blank lines; flag progress, exit marker, error-ish and crash sentinel."""
    nb = lines.where(~L.is_blank("line"))
    prog = L.is_server_progress("line")
    sent = L.is_crash_sentinel("line")
    err = L.is_errorish("line")
    ex = L.is_exit_marker("line")
    cls = (F.when(sent, F.lit("crash")).when(err, F.lit("error")).when(prog, F.lit("progress"))
           .when(ex, F.lit("exit")).otherwise(F.lit("output")))
    return nb.select("run_id", "line_no", prog.alias("is_progress"), ex.alias("is_exit"),
                     err.alias("is_errorish"), sent.alias("is_crash"), cls.alias("line_class"))


def progress_collapse(lines: DataFrame) -> DataFrame:
    """Terminal view: a progress line replaces the line before it when that one is progress too.

    So within a stretch of consecutive progress lines only the last survives.
    """
    nb = lines.where(~L.is_blank("line")).withColumn("_p", L.is_ui_progress("line"))
    j = with_neighbour(nb, ["run_id"], "line_no", ["_p"], following=True)
    keep = ~(F.col("_p") & F.coalesce(F.col("next__p"), F.lit(False)))
    return j.where(keep).select("run_id", "line_no", "line")


def server_state_timeline(lines: DataFrame) -> DataFrame:
    """Running/stopped state set by output markers (a line with both ends stopped)."""
    running = L.any_contains("line", L.RUNNING_MARKERS)
    stopped = L.any_contains("line", L.STOPPED_MARKERS)
    state = F.when(stopped, F.lit("stopped")).when(running, F.lit("running"))
    marks = lines.select("run_id", "line_no", "ts", state.alias("state")).where(F.col("state").isNotNull())
    j = with_neighbour(marks, ["run_id"], "line_no", ["state"], following=False)
    return j.select("run_id", "line_no", "ts", "state", F.col("prev_state"),
                    (~F.col("state").eqNullSafe(F.col("prev_state"))).alias("changed"))


def live_state_timeline(msgs: DataFrame, channel: str = "run_id") -> DataFrame:
    """Running/stopped state of each channel from its two sources in one order: the last writer wins.

    Output messages write a state by their markers (both: stopped). A status message always writes one: its
    ``running``, where null, false, 0 and an empty text mean stopped, as does a status without it.
    """
    routed = message_routes(msgs, keep=(channel,))
    told = ~F.coalesce(F.col("body"), F.lit("")).isin("", "false", "0", "null")
    state = (F.when(F.col("route") == "status", F.when(told, F.lit("running")).otherwise(F.lit("stopped")))
             .when(F.col("route") != "output", F.lit(None))
             .when(L.any_contains("body", L.STOPPED_MARKERS), F.lit("stopped"))
             .when(L.any_contains("body", L.RUNNING_MARKERS), F.lit("running")))
    marks = routed.select(channel, "msg_id", F.col("route").alias("source"), state.alias("state")).where(F.col("state").isNotNull())
    j = with_neighbour(marks, [channel], "msg_id", ["state"], following=False)
    return j.select(channel, "msg_id", "source", "state", "prev_state",
                    (~F.col("state").eqNullSafe(F.col("prev_state"))).alias("changed"))


def parsed_concurrency(lines: DataFrame) -> DataFrame:
    """Maximum-concurrency lines: int(float(x)) of the reported value, null where it isn't a whole number of 32 bits."""
    raw = F.regexp_extract("line", L.CONCURRENCY_RE, 2)
    m = lines.where(F.col("line").rlike(L.CONCURRENCY_RE))
    return m.select("run_id", "line_no", "ts",
                    F.regexp_extract("line", L.CONCURRENCY_RE, 1).try_cast("int").alias("tokens"),
                    raw.try_cast("double").try_cast("int").alias("max_concurrency"))


def max_batch_backfill(lines: DataFrame, run_models: DataFrame, models: DataFrame) -> DataFrame:
    """Fill a null ``max_batch_size`` from the concurrency lines of the model's runs.

    The value is written while it was null when the run began, so of a model's runs the earliest one with
    such a line decides, and in it the last line.
    """
    per_run = parsed_concurrency(lines).where(F.col("max_concurrency").isNotNull()).groupBy("run_id").agg(
        F.max_by("max_concurrency", "line_no").alias("last_value"), F.min("ts").alias("first_ts"))
    first = per_run.join(run_models, "run_id").groupBy("model_id").agg(
        F.min_by("last_value", F.struct("first_ts", "run_id")).alias("parsed_concurrency"))
    m = models.select("id", "model_name", F.col("max_batch_size").alias("max_batch_size_before"))
    j = m.join(first, m["id"] == first["model_id"], "left")
    return j.select("id", "model_name", "max_batch_size_before", "parsed_concurrency",
                    F.coalesce("max_batch_size_before", "parsed_concurrency").alias("max_batch_size"))


def run_health(lines: DataFrame, tail: int = 1000) -> DataFrame:
    """Health of each run from its last ``tail`` lines: error > waiting > running.

    Indicators are substring tests and never span lines, so "indicator in
    joined text" equals "some tail line contains it": one aggregate, no
    concatenated text.
    """
    # which blocks of a run hold its last lines is counted on (run, line number) alone
    at = F.floor(F.col("line_no") / F.lit(DEFAULT_BLOCK)).cast("long")
    counts = lines.groupBy("run_id", at.alias("_blk")).agg(F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy("run_id").orderBy(F.col("_blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    wanted = counts.withColumn("_after", F.coalesce(F.sum("_n").over(later), F.lit(0))).where(F.col("_after") < tail)
    rows = lines.withColumn("_blk", at).join(wanted.select("run_id", "_blk"), ["run_id", "_blk"], "left_semi").drop("_blk")
    # position counted from the end of the run: number the lines in descending order
    rev = ordered_index(rows.withColumn("_desc", -F.col("line_no")), ["run_id"], "_desc", "_ri")
    t = rev.where(F.col("_ri") < tail)
    flags = [F.bool_or(F.col("line").contains(ind)).alias(f"_f{i}")
             for i, ind in enumerate(L.HEALTH_ERROR_INDICATORS)]
    g = t.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_lines"), *flags,
        F.bool_or(F.col("line").contains(L.HEALTH_WAITING_MARKER)).alias("_wait"))
    found = F.array_compact(F.array(*[F.when(F.col(f"_f{i}"), F.lit(ind))
                                      for i, ind in enumerate(L.HEALTH_ERROR_INDICATORS)]))
    g = g.withColumn("_found", found)
    status = (F.when(F.size("_found") > 0, F.lit("error")).when(F.col("_wait"), F.lit("waiting"))
              .otherwise(F.lit("running")))
    return g.select("run_id", "n_lines", status.alias("status"),
                    F.array_join("_found", ", ").alias("errors_found"))


def run_duration(lines: DataFrame) -> DataFrame:
    """First/last timestamp of a run and its uptime as ``Xh Ym Zs`` (zero h/m left out)."""
    g = lines.groupBy("run_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                                    F.count(F.lit(1)).alias("n_lines"))
    # timestamp_ntz difference: independent of the session time zone
    secs = F.timestamp_diff("MICROSECOND", F.col("first_ts"), F.col("last_ts")) / 1e6
    whole = F.floor(secs).cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60
    text = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("h "))).otherwise(F.lit("")),
                    F.when(m > 0, F.concat(m.cast("string"), F.lit("m "))).otherwise(F.lit("")),
                    s.cast("string"), F.lit("s"))
    return g.select("run_id", "first_ts", "last_ts", "n_lines", secs.alias("duration_seconds"),
                    text.alias("uptime"))


def log_tail(lines: DataFrame, n: int = 100) -> DataFrame:
    """Last ``n`` lines of the newest log (largest run id), in one pass. n <= 0 returns none."""
    if n <= 0:
        return lines.select("run_id", "line_no", "line").limit(0)
    top = lines.select("run_id", "line_no", "line").orderBy(F.col("run_id").desc(), F.col("line_no").desc()).limit(n)
    # at most n rows from here on
    newest = F.max("run_id").over(Window.partitionBy(F.lit(0)))
    return top.withColumn("_newest", newest).where(F.col("run_id") == F.col("_newest")).drop("_newest").orderBy("line_no")


def log_unescape(lines: DataFrame) -> DataFrame:
    """All lines with their ``\\uXXXX`` escapes decoded for display."""
    return lines.select("run_id", "line_no", unescape_unicode("line").alias("text"))


def message_routes(msgs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Route live messages: JSON {type, data} by type, text that isn't JSON shown as is; pong dropped.

    JSON that isn't an object has no type and is ignored. ``progress`` gets its own route (the UI had
    none for it). Columns of ``keep`` come first.
    """
    is_json = F.try_parse_json("message").isNotNull()
    is_obj = F.json_object_keys("message").isNotNull()
    p = F.from_json("message", "type string, data string")
    t = msgs.select(*keep, "msg_id", "message", is_json.alias("_json"), is_obj.alias("_obj"), p.alias("_p"))
    typ = F.col("_p.type")
    data = F.col("_p.data")
    route = (F.when(~F.col("_json"), F.lit("text"))
             .when(~F.col("_obj"), F.lit("ignored"))
             .when(typ == "pong", F.lit("drop"))
             .when(typ.isin("output", "progress", "status", "error"), typ)
             .otherwise(F.lit("ignored")))
    body = (F.when(~F.col("_json"), F.col("message"))
            .when(~F.col("_obj"), F.lit(None).cast("string"))
            .when(typ.isin("output", "progress"), data)
            .when(typ == "error", F.get_json_object(data, "$.message"))
            .when(typ == "status", F.get_json_object(data, "$.running")))
    # Emit 0 or 1 row per message through a generator: a plain filter on
    # ``route`` would be pushed below the projection and parse the JSON twice.
    one = F.filter(F.array(F.struct(*keep, F.col("msg_id"), route.alias("route"), body.alias("body"))),
                   lambda x: x["route"] != "drop")
    return t.select(F.inline(one))
