"""Which of many patterns may be found in which lines: a join over a literal that each pattern requires.

Every match of a pattern holds its required literals. One window of ``GRAM`` characters of them, the one that fewest
patterns have, stands for the pattern; a line is looked up by its own windows. So lines x patterns becomes a
hash join, and only pairs that share a window are tried. Windows of lines that no pattern has are left out before
the shuffle by a bit table of fixed size, whatever the number of patterns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import compiled, required_literals

#: characters of a window; bits of the table (a power of two)
GRAM, BITS = 6, 1 << 23
#: compiled patterns that a task keeps
KEPT = 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: characters that Python's IGNORECASE takes for an ASCII letter
_FOLD = {ord(a): b for a, b in zip("ſKİı", "skii")} | {k: chr(k + 32) for k in range(65, 91)}


def folded(text: str) -> str:
    """``text`` with every character that can match an ASCII letter without regard to case as that small letter."""
    return text.translate(_FOLD)


def window_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of each distinct window of ASCII characters of the folded texts."""
    points = np.frombuffer(folded("\n".join(texts)).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    if len(points) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), size)[:len(points)]
    h, plain = np.zeros(len(points) - GRAM + 1, np.uint64), points < 128
    whole = owner[:len(h)] == owner[GRAM - 1:]
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            part = points[k:len(points) - GRAM + 1 + k]
            h = (h ^ part) * _MIX
            h ^= h >> np.uint64(29)
            whole &= plain[k:len(points) - GRAM + 1 + k]
    # a text's last character but one is the last of its own; the joining line feed belongs to no window
    last = np.cumsum(size) - 1
    whole &= np.searchsorted(last, np.arange(len(h)), "left") == np.searchsorted(last, np.arange(len(h)) + GRAM - 1, "left")
    inside = ~np.isin(np.arange(len(h)) + GRAM - 1, last)
    at = np.flatnonzero(whole & inside)
    pairs = np.unique(np.stack((owner[at].astype(np.uint64), h[at])), axis=1)
    return pairs[0].astype(np.int64), pairs[1].view(np.int64)


def _windows(texts: DataFrame, keys: list[str], schema: str, of, table=None) -> DataFrame:
    """(keys, gram) rows of ``texts`` (keys, then the text), of what ``of`` makes of a text; with ``table`` only those in it."""
    def run(batches):
        bits = None if table is None else np.frombuffer(table.value, np.uint8)
        for b in batches:
            parts = [(at, part) for at, text in enumerate(b.column(len(keys)).to_pylist()) for part in of(text)]
            owner, gram = window_hashes([p for _, p in parts])
            if bits is not None:
                slot = gram.view(np.uint64) & np.uint64(BITS - 1)
                held = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                owner, gram = owner[held], gram[held]
            take = pa.array(np.array([at for at, _ in parts], np.int64)[owner])
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(len(keys))), pa.array(gram)], names=[*keys, "gram"])
    return texts.mapInArrow(run, schema)


def with_window(patterns: DataFrame) -> DataFrame:
    """(id, pattern, gram) of the patterns that have a window; the window that fewest patterns have, then the least."""
    of = lambda p: required_literals(p) if compiled(p) is not None else []
    grams = _windows(patterns.select("id", "pattern"), ["id"], "id long, gram long", of).distinct()
    many = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("many"))
    best = grams.join(many, "gram").groupBy("id").agg(F.min(F.struct("many", "gram"))["gram"].alias("gram"))
    return patterns.join(best, "id").select("id", "pattern", "gram")


def _table(patterns: DataFrame):
    """Broadcast bits of the patterns' windows: ``BITS`` / 8 bytes at most pass the driver."""
    at = F.pmod("gram", F.lit(BITS))
    words = patterns.select(F.floor(at / 32).alias("w"), (at % 32).cast("int").alias("b")).groupBy("w").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))).alias("bits"))
    table = np.zeros(BITS // 32, "<u4")
    found = words.toArrow()
    table[found.column("w").to_numpy()] = found.column("bits").to_numpy().astype("<u4")
    return patterns.sparkSession.sparkContext.broadcast(table.tobytes())


def found_in(pairs: DataFrame, text_col: str, pattern_col: str) -> DataFrame:
    """The rows of ``pairs`` whose pattern Python finds in the text, each pattern compiled once while it is kept."""
    def run(batches):
        kept: dict = {}
        for b in batches:
            texts, patterns = (b.column(b.schema.get_field_index(c)).to_pylist() for c in (text_col, pattern_col))
            ok = []
            for text, p in zip(texts, patterns):
                if p not in kept:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[p] = compiled(p)
                ok.append(kept[p] is not None and kept[p].search(text) is not None)
            yield b.filter(pc.equal(pa.array(ok, pa.bool_()), True))
    return pairs.mapInArrow(run, pairs.schema)


def lines_with(lines: DataFrame, patterns: DataFrame) -> DataFrame:
    """(line, error_id) of the distinct ``lines`` (column line) that a pattern is found in.

    ``patterns``: (id, pattern, gram) from ``with_window``, written once; patterns that match inside a line.
    """
    looked = _windows(lines.select("line", F.col("line").alias("text")), ["line"], "line string, gram long", lambda t: [t], _table(patterns))
    pairs = looked.join(patterns, "gram").select("line", "pattern", "id").distinct()
    return found_in(pairs, "line", "pattern").select("line", F.col("id").alias("error_id"))
