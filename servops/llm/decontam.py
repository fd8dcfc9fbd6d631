"""Benchmark decontamination by template canonicalisation (operator 8).

Texts become sequences of tokens in which numbers, units (after a number) and names (capitalised words
inside a sentence) are replaced by typed placeholders, the slots. Windows of such tokens are joined by hash
between documents and benchmark items. Windows with the item's own slots count always. Those with other slots
count if their slots are filled consistently along one alignment of a document with an item: of the pairs of an item's
and a document's value, the largest one-to-one set is taken, and a window counts whose pairs are all in it. So a
question is found again verbatim, verbatim but for some values, or with other numbers and names, also where one
of them is used twice for different ones.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import sieve
from .textarrays import byte_class, byte_view, mix64, small_batches, word_hashes

#: tokens a window; a window needs so many tokens that aren't slots
WINDOW, LITERALS = 8, 4
#: an item is found in a document with this share of its windows, or this many
SHARE, ENOUGH = 0.3, 10
#: bits of the table that keeps windows no item has on the map side (2 MB)
BITS = 1 << 24

#: Words that are units when they follow a number.
UNITS = ["mm", "cm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yards", "mi", "mile", "miles",
         "mg", "g", "gram", "grams", "kg", "t", "ton", "tons", "oz", "lb", "lbs", "pound", "pounds",
         "ml", "cl", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "ms", "s", "sec", "second", "seconds",
         "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months",
         "year", "years", "percent", "usd", "eur", "gbp", "dollar", "dollars", "euro", "euros", "cent", "cents",
         "mph", "kmh", "w", "kw", "kwh", "v", "hz", "khz", "mhz", "ghz", "kb", "mb", "gb", "tb"]

_TOKEN = byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
_DIGIT = byte_class(lambda b: 48 <= b <= 57)
_MARK = byte_class(lambda b: b in b".!?:;\n\r\"")
_JOINS = byte_class(lambda b: b in b".,")
_NUM, _UNIT, _NAME = (np.uint64(x) for x in (0x6E756D, 0x756E6974, 0x6E616D65))
_RAW = np.uint64(0x726177)
_STEP = np.uint64(0x9FB21C651E98DF25)


def _unit_hashes() -> np.ndarray:
    data, off = byte_view(pa.array([" ".join(UNITS)]))
    return word_hashes(data, off, _TOKEN)[0]


def canonical(data: np.ndarray, off: np.ndarray):
    """(token codes, hash of what stands there, whether it is a slot, first token of each text).

    A number is a run of digits, with points or commas between digits inside; a unit is a listed word
    after a number; a name is a word with a capital (A-Z, or Latin-1) that doesn't begin a sentence.
    """
    h, s, e, first = word_hashes(data, off, _TOKEN)
    if not len(h):
        return h, h, np.zeros(0, bool), first
    begins = np.zeros(len(h) + 1, bool)
    begins[first] = True
    begins = begins[:-1]
    number = _DIGIT[data[s]] & _DIGIT[data[e - 1]]
    joined = np.zeros(len(h), bool)
    joined[1:] = number[1:] & number[:-1] & (s[1:] - e[:-1] == 1) & _JOINS[data[np.minimum(e[:-1], len(data) - 1)]] & ~begins[1:]
    head = np.flatnonzero(~joined)
    place = np.arange(len(h)) - np.repeat(head, np.diff(np.append(head, len(h))))
    value = np.add.reduceat(mix64(h + place.astype(np.uint64)), head)
    h, s, begins, number = h[head], s[head], begins[head], number[head]
    e = e[np.append(head[1:], len(e)) - 1]
    after_number = np.zeros(len(h), bool)
    after_number[1:] = number[:-1] & ~begins[1:]
    unit = after_number & np.isin(h, _unit_hashes())
    marks = np.concatenate(([0], np.cumsum(_MARK[data])))
    inside = np.zeros(len(h), bool)
    inside[1:] = (marks[s[1:]] == marks[e[:-1]]) & ~begins[1:]
    second = data[np.minimum(s + 1, len(data) - 1)]
    capital = (data[s] >= 65) & (data[s] <= 90) | (data[s] == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    name = capital & inside & ~number & ~unit
    code = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, h)))
    return code, value, number | unit | name, np.searchsorted(head, first, "left")


def windows(code: np.ndarray, slot: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the window at every token, whether it has enough tokens that aren't slots)."""
    n = len(code) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * _STEP + code[k:k + n]
    plain = np.concatenate(([0], np.cumsum(~slot)))
    return mix64(out), plain[width:] - plain[:n] >= min(LITERALS, width)


def _window_rows(batches, widths: list[tuple[int, bool]], widest: int, only: bytes | None, names: list[str]):
    """Arrow batches of the windows of the texts in column 2; ``only``: those the bit table may hold.

    ``widths`` has (tokens, whether raw). Raw windows are of the tokens themselves and have no slots. A text shorter
    than ``widest`` gives, without a table, its single window of a kind; with one, the windows of every width.
    """
    table = np.frombuffer(only, np.uint8) if only is not None else None
    for b in small_batches(batches, 2):
        data, off = byte_view(b.column(2))
        code, value, slot, first = canonical(data, off)
        sizes = np.diff(first)
        texts = np.repeat(np.arange(len(sizes)), sizes)
        rows, at, hashes, width_of, kind = [], [], [], [], []
        for width, raw in widths:
            w, good = windows(value ^ _RAW, np.zeros(len(slot), bool), width) if raw else windows(code, slot, width)
            if not len(w):
                continue
            good &= texts[width - 1:] == texts[:len(w)]  # not over the end of a text
            if table is not None:
                good &= sieve.held(table, w)
            elif width < widest:
                good &= sizes[texts[:len(w)]] == width
            hit = np.flatnonzero(good)
            rows.append(texts[hit])
            at.append(hit)
            hashes.append(w[hit])
            width_of.append(np.full(len(hit), width))
            kind.append(np.full(len(hit), raw))
        if not rows:
            continue
        rows, at, hashes, width_of, kind = (np.concatenate(x) for x in (rows, at, hashes, width_of, kind))
        if not len(rows):
            continue
        none = np.zeros(0, np.int64)
        values = [none if raw else value[a:a + k][slot[a:a + k]].view(np.int64) for a, k, raw in zip(at, width_of, kind)]
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(take), b.column(1).take(take), pa.array(hashes.view(np.int64)),
             pa.array((at - first[rows]).astype(np.int64)), pa.array(values, pa.list_(pa.int64())),
             pa.array(width_of), pa.array(kind)], names=names)


def assign(weight: np.ndarray) -> np.ndarray:
    """The column of each row in the assignment of rows to columns, at least as many, with the highest sum of weights.

    Shortest augmenting paths with potentials, a row at a time; place 0 of the columns' arrays is the new row's.
    """
    rows, cols = weight.shape
    u, v = np.zeros(rows, np.int64), np.zeros(cols + 1, np.int64)
    owner = np.full(cols + 1, -1)
    for new in range(rows):
        owner[0], at = new, 0
        least, before, seen = np.full(cols + 1, 1 << 62), np.zeros(cols + 1, np.int64), np.zeros(cols + 1, bool)
        while owner[at] >= 0:
            seen[at] = True
            left = np.append(0, -weight[owner[at]] - u[owner[at]]) - v
            nearer = ~seen & (left < least)
            nearer[0] = False
            least[nearer], before[nearer] = left[nearer], at
            free = np.flatnonzero(~seen)
            at = int(free[least[free].argmin()])
            step = least[at]
            u[owner[seen]] += step
            v[seen] -= step
            least[free] -= step
        while at:
            owner[at] = owner[before[at]]
            at = int(before[at])
    out = np.empty(rows, np.int64)
    out[owner[1:][owner[1:] >= 0]] = np.flatnonzero(owner[1:] >= 0)
    return out


def largest_consistent(windows: list[tuple]) -> set[tuple]:
    """Of the pairs (item's value, document's value) in windows, one list of pairs each, the largest one-to-one set.

    A pair weighs the windows that hold it; of sets of the same weight one with more equal values is taken, then one by the
    order of the values. Values linked by pairs are decided together, apart from all others.
    """
    weight = Counter(p for w in windows for p in set(w))
    top: dict = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x
    for i, d in weight:
        a, b = root((0, i)), root((1, d))
        top[max(a, b)] = min(a, b)
    parts: dict = {}
    for p in sorted(weight):
        parts.setdefault(root((0, p[0])), []).append(p)
    out = set()
    for pairs in parts.values():
        if len(pairs) == 1:
            out.add(pairs[0])
            continue
        own, other = sorted({i for i, _ in pairs}), sorted({d for _, d in pairs})
        table = np.zeros((len(own), len(other)), np.int64)
        for i, d in pairs:
            table[own.index(i), other.index(d)] = weight[i, d] * (len(pairs) + 1) + (i == d)
        turn = len(own) > len(other)
        for a, b in enumerate(assign(table.T if turn else table).tolist()):
            pair = (own[b], other[a]) if turn else (own[a], other[b])
            if pair in weight:
                out.add(pair)
    return out


@F.arrow_udf(T.ArrayType(T.LongType()))
def _covered(alignments: pa.Array) -> pa.Array:
    """Places of the windows (item_at, i, d) that the largest consistent set covers, alignment after alignment; null for null."""
    out = []
    for windows in alignments.to_pylist():
        if windows is not None:
            pairs = [list(zip(w["i"], w["d"])) for w in windows]
            chosen = largest_consistent(pairs)
            windows = [w["item_at"] for w, p in zip(windows, pairs) if chosen.issuperset(p)]
        out.append(windows)
    return pa.array(out, pa.list_(pa.int64()))


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW,
               share: float = SHARE, enough: int = ENOUGH) -> DataFrame:
    """Benchmark items found in documents: one row per (row identity, item).

    ``id_col``, text_hash, ``item_col``, n_windows (distinct windows of the item found), item_windows,
    coverage, verbatim (no slot was filled otherwise). An item of fewer than ``width`` tokens is one window of its own
    length. A window is found by its lower-cased tokens, or by its tokens with slots where at least 4 of them
    aren't slots, if the largest consistent set of an alignment (see ``largest_consistent``) covers it; coverage is the share of the item's windows, or of those with 4 such tokens if that is
    higher. Null and empty texts hold nothing and are never found. Repeated rows of documents give one
    row. Other columns aren't read.

    Documents' windows pass a fixed-size bit table of the items' windows before they are shuffled, so what
    leaves the scan is in proportion to what is found.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_col].dataType.simpleString()
    widths = [(k, False) for k in range(width, LITERALS - 1, -1)] + [(k, True) for k in range(width, 0, -1)]
    more = "slots array<long>, width long, raw boolean"
    picked = items.select(F.col(item_col).alias("item"), F.xxhash64(F.col(item_text_col)).alias("tie"),
                          F.col(item_text_col).alias("text"))
    index = picked.mapInArrow(lambda bs: _window_rows(bs, widths, width, None, ["item", "item_tie", "w", "item_at", "item_slots", "width", "raw"]),
                              f"item {item_kind}, item_tie long, w long, item_at long, item_{more}")
    index = cut_lineage(index)
    only = sieve.bit_table(index, "w", BITS)
    # as many rows as there are widths at most
    used = sorted((r["width"], r["raw"]) for r in index.select("width", "raw").distinct().collect())
    picked = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).alias("text"))
    found = picked.mapInArrow(lambda bs: _window_rows(bs, used, width, only.value, ["id", "tie", "w", "at", "slots", "width", "raw"]),
                              f"id {kind}, tie long, w long, at long, {more}").drop("width", "raw")
    j = found.join(index, "w")
    # pairs of slot values along one alignment; an item's tokens bound what a group gathers
    exact = F.col("item_slots") == F.col("slots")
    along = j.groupBy("id", "tie", "item", "item_tie", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set("item_at").alias("places"), F.collect_set(F.when(exact, F.col("item_at"))).alias("sure"),
        F.collect_set(F.when(F.size("slots") > 0, F.struct("item_at", F.col("item_slots").alias("i"), F.col("slots").alias("d")))).alias("filled"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))))).alias("pairs"))
    values = F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"])))
    others = F.size(F.array_distinct(F.transform("pairs", lambda p: p["d"])))
    one_to_one = (values == F.size("pairs")) & (others == F.size("pairs"))
    # only alignments whose pairs are at odds are looked at window by window
    along = along.withColumn("part", _covered(F.when(~one_to_one, F.col("filled")))) \
        .withColumn("places", F.coalesce(F.array_union("sure", "part"), F.col("places"))).where(F.size("places") > 0)
    same = F.forall("pairs", lambda p: p["i"] == p["d"])
    per = along.select("id", "tie", "item", "item_tie", "places", same.alias("same")) \
        .groupBy("id", "tie", "item", "item_tie").agg(
            F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"), F.bool_and("same").alias("verbatim"))
    sizes = index.groupBy("item", "item_tie").agg(F.count_distinct("item_at").alias("item_windows"),
                                                  F.collect_set(F.when(~F.col("raw"), F.col("item_at"))).alias("plain"))
    n_plain = F.size(F.array_intersect("places", "plain"))
    out = per.withColumnsRenamed({"item": "i", "item_tie": "it"}) \
        .join(sizes, F.col("i").eqNullSafe(F.col("item")) & (F.col("it") == F.col("item_tie"))) \
        .withColumn("n_windows", F.size("places").cast("long")) \
        .withColumn("coverage", F.greatest(F.col("n_windows") / F.col("item_windows"),
                                           F.when(F.size("plain") > 0, n_plain / F.size("plain")))) \
        .where((F.col("coverage") >= share) | (F.col("n_windows") >= enough))
    return out.select(F.col("id").alias(id_col), F.col("tie").alias("text_hash"), F.col("i").alias(item_col), "n_windows",
                      "item_windows", "coverage", "verbatim")
