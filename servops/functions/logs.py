"""Engine-log line predicates and the fixed strings they look for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_

# Markers written by the inference server and its launcher.
SERVER_PROGRESS_MARK = "%|"
SERVER_PROGRESS_BLOCKS = ["█", "▏"]
UI_PROGRESS_BLOCKS = ["█", "▏", "▎", "▍", "▌", "▋", "▊", "▉"]
EXIT_MARKER = "vLLM server exited with code"
ERRORISH_WORDS = ["error", "exception", "terminated"]
CRASH_SENTINEL = "RuntimeError: Server process terminated unexpectedly"
CONCURRENCY_RE = r"INFO .* Maximum concurrency for (\d+) tokens per request: ([\d.]+)x"
# Health indicators in declared order, and the waiting marker.
HEALTH_ERROR_INDICATORS = [
    "CUDA error",
    "RuntimeError",
    "Error:",
    "Exception:",
    "Traceback (most recent call last)",
    "Server process exited with code",
]
HEALTH_WAITING_MARKER = "Press Enter to close this session"
# UI output markers for the running/stopped timeline.
RUNNING_MARKERS = ["Server is running", "Server started successfully"]
STOPPED_MARKERS = ["Server stopped", "Server is not running"]
# Message extraction for a newly seen crash, tried in this order. The rest of the line is taken as
# one class instead of a lazy match up to the line's end: the same text, without backtracking and line by line.
NEW_ERROR_PATTERNS = [r"RuntimeError: ([^\n]+)", r"Error: ([^\n]+)", r"Exception: ([^\n]+)"]
NEW_ERROR_FALLBACK = "Unknown error"
NEW_ERROR_SOLUTION = "This is a newly detected error. No solution has been provided yet."
NEW_PATTERN_MAX_CHARS = 100


def any_contains(c, needles) -> Column:
    c = col_(c)
    out = None
    for n in needles:
        t = c.contains(n)
        out = t if out is None else (out | t)
    return out


def is_blank(line) -> Column:
    """``not line.strip()`` (Python whitespace)."""
    from .text import py_is_blank
    return py_is_blank(line)


def is_server_progress(line) -> Column:
    line = col_(line)
    return line.contains(SERVER_PROGRESS_MARK) & any_contains(line, SERVER_PROGRESS_BLOCKS)


def is_ui_progress(text) -> Column:
    text = col_(text)
    return text.contains("|") & any_contains(text, UI_PROGRESS_BLOCKS)


def is_exit_marker(line) -> Column:
    return col_(line).contains(EXIT_MARKER)


def is_errorish(line) -> Column:
    """lower(line) contains any of the words (one pass over the line)."""
    return F.lower(col_(line)).rlike("|".join(ERRORISH_WORDS))


def is_crash_sentinel(line) -> Column:
    return col_(line).contains(CRASH_SENTINEL)
