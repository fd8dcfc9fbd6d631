"""Spelling variants by dense prefix-suffix tiling (operator 12).

Two words are near if one inserted, deleted or replaced code point makes one the other. That is so exactly when
their common prefix and common suffix reach the longer length minus one together. Blocks of words stand as
padded code-point matrices, from the left for prefixes and from the right for suffixes, and two blocks are
compared whole.

Which blocks meet: with s the shorter length and h = s // 2, two near words agree in their first h code points, or
else in their last s - h. So a word is filed under both halves for s = its length and for s = its length less one,
and only words filed under the same half are compared; a pair that agrees in the first half counts there alone. A
half that many words share is cut into cells of two blocks each, so no task holds more than two blocks of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .licenses import LOWER, UPPER

#: letters of words, after A-Z were lower-cased
LETTERS = "a-zÀ-ÿ"
#: one in so many occurrences (by hash) loses a code point, as a misspelling would
SLIPS = 97
#: characters (64 at least a word) of one block of a half; cells hold two blocks
BLOCK = 1 << 19
#: rows of a tile, and entries of its comparison
TILE, DENSE = 256, 1 << 22


def occurrences(docs: DataFrame, id_col: str, text_col: str, least: int, slips: int) -> DataFrame:
    """``word`` of every run of at least ``least`` letters, with the slips; a shorter run can't give a word."""
    low = F.translate(F.col(text_col), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(low, F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return runs.select(F.when(h % slips == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, id_col: str, text_col: str, least: int, common: int, slips: int) -> DataFrame:
    """(word, n, size) of the distinct words, counted before the shuffle."""
    return occurrences(docs, id_col, text_col, least, slips).groupBy("word").agg(F.count(F.lit(1)).alias("n")) \
        .select("word", "n", F.char_length("word").alias("size")).where((F.col("n") >= common) & (F.col("size") >= least))


def _filed(words: DataFrame) -> DataFrame:
    """Each word under both halves, for the shorter length ``s`` being its own or one less."""
    def half(s: Column, side: int) -> Column:
        h = F.floor(s / 2).cast("int")
        part = F.substring(F.col("word"), F.lit(1), h) if side == 0 else F.right(F.col("word"), s - h)
        return F.struct(s.alias("s"), F.lit(side).alias("side"), F.xxhash64(part).alias("half"))
    size = F.col("size")
    return words.select("word", "n", "size", F.explode(F.array(*[half(size - d, side) for d in (0, 1) for side in (0, 1)])).alias("f")) \
        .select("word", "n", "size", "f.s", "f.side", "f.half").where(F.col("s") > 0)


def cells(words: DataFrame) -> DataFrame:
    """(s, side, half, i, j, part, word, n): the words of a half, dealt into cells (i, j) of two of its blocks.

    ``part`` is 0 for words of block i, 1 for those of block j. Halves without a word of length s, or with one
    word alone, can't hold a pair and are left out.
    """
    filed = _filed(words)
    weight = F.sum(F.greatest(F.lit(64), F.col("size")).cast("long"))
    held = filed.groupBy("s", "side", "half").agg(
        F.count(F.lit(1)).alias("many"), F.min("size").alias("least"), F.ceil(weight / BLOCK).cast("int").alias("blocks"))
    held = held.where((F.col("many") > 1) & (F.col("least") == F.col("s"))).select("s", "side", "half", "blocks")
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                         lambda j: F.struct(F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j")))
    dealt = filed.join(held, ["s", "side", "half"]).withColumn("own", own).withColumn("cell", F.explode(others))
    return dealt.select("s", "side", "half", "cell.i", "cell.j",
                        (F.col("own") != F.col("cell.i")).cast("int").alias("part"), "word", "n")


def code_points(words: list[str], size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Padded matrices of the words' code points, from the left and from the right (0 is no letter)."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    first = np.cumsum(size) - size
    at = np.arange(width)
    inside = at[None, :] < size[:, None]
    left = np.where(inside, flat[np.where(inside, first[:, None] + at, 0)], 0)
    right = np.where(inside, flat[np.where(inside, (first + size - 1)[:, None] - at, 0)], 0)
    return left, right


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading equal entries of every row of ``a`` with every row of ``b``."""
    same = np.ones((len(a), len(b), a.shape[1] + 1), bool)
    np.equal(a[:, None, :], b[None, :, :], out=same[:, :, :-1])
    same[:, :, -1] = False
    return same.argmin(2)


def near_in_tiles(group: np.ndarray, part: np.ndarray, crossing: np.ndarray, words: list[str], rank: np.ndarray,
                  s: int, side: int):
    """Near words of each word within its cell: (how many, least rank among them or -1).

    Rows are in order of ``group`` (the cell); all have length s or s + 1. Tiles of rows meet while their
    cells overlap. In a ``crossing`` cell only words of different parts are compared.
    """
    many = np.zeros(len(words), np.int64)
    best = np.full(len(words), len(words), np.int64)
    size = np.array([len(w) for w in words])
    left, right = code_points(words, size, s + 1)
    tile = max(1, min(TILE, int((DENSE // (s + 2)) ** 0.5)))
    ends = np.searchsorted(group, group, "right")
    for i in range(0, len(words), tile):
        a = slice(i, min(i + tile, len(words)))
        for j in range(i, int(ends[a.stop - 1]), tile):
            b = slice(j, min(j + tile, len(words)))
            prefix, suffix = _agree(left[a], left[b]), _agree(right[a], right[b])
            near = prefix + suffix >= np.maximum(size[a][:, None], size[b][None, :]) - 1
            near &= (group[a][:, None] == group[b][None, :]) & (np.minimum(size[a][:, None], size[b][None, :]) == s)
            near &= ~crossing[a][:, None] | (part[a][:, None] != part[b][None, :])
            if side == 1:
                near &= prefix < s // 2
            if i == j:
                near &= ~np.eye(a.stop - a.start, dtype=bool)
            if not near.any():
                continue
            for one, other, hit in ((a, b, near),) if i == j else ((a, b, near), (b, a, near.T)):
                many[one] += hit.sum(1)
                best[one] = np.minimum(best[one], np.where(hit, rank[other][None, :], len(words)).min(1))
    return many, np.where(best < len(words), best, -1)


def near_words(dealt: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) summed over cells: near words, and of those the one of largest n, then least."""
    def compare(s, side, rows):
        """``rows``: (cell, part, word, n) of whole cells of one s and side, in order of the cell."""
        cell, part, words, n = zip(*rows)
        group = np.cumsum([0] + [x != y for x, y in zip(cell, cell[1:])])
        order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        many, best = near_in_tiles(group, np.array(part), np.array([c[1] != c[2] for c in cell]), words, rank, s, side)
        return [(words[k], int(many[k]), words[order[best[k]]], n[order[best[k]]]) for k in np.flatnonzero(many)]

    def pack(found):
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)],
                                          names=["word", "k", "form", "form_n"])

    def run(batches):
        held, at = [], None
        for b in batches:
            found = []
            for s, side, half, i, j, part, word, n in zip(*(c.to_pylist() for c in b.columns)):
                cell = (half, i, j)
                # whole cells are compared together, some thousand rows at a time
                if held and ((s, side) != at or (cell != held[-1][0] and len(held) >= 8192)):
                    found += compare(*at, held)
                    held = []
                at = (s, side)
                held.append((cell, part, word, n))
            if found:
                yield pack(found)
        found = compare(*at, held) if held else []
        if found:
            yield pack(found)
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = dealt.repartition(parts, "s", "side", "half", "i", "j").sortWithinPartitions("s", "side", "half", "i", "j")
    some = spread.mapInArrow(run, "word string, k long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form")))
    return some.groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("best")) \
        .select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, following forms to the last by doubling steps; forms have no circle."""
    labels = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        above = labels.select(F.col("word").alias("root"), F.col("root").alias("above"))
        step = cut_lineage(labels.join(above, "root", "left").select(
            "word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        labels = step.select("word", "root")
        if step.where("moved").isEmpty():
            return labels


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, common: int = 3,
                      ratio: int = 2, slips: int = SLIPS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every distinct word of at least ``least`` code points and n >= ``common``.

    Words are longest runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. With h the crc32 of ``id:run``, a run
    whose h ``slips`` divides loses its code point h % length. A word's form is its near word of largest n (ties: the
    least in code-point order) if that n is at least ``ratio`` (above 1) times its own. ``root`` follows forms to the
    last one and is the word itself without a form. A null text has no words, a null id counts as empty text;
    repeated rows count each; an empty table gives no rows. Other columns aren't read.
    """
    words = cut_lineage(vocabulary(docs, id_col, text_col, least, common, slips))
    near = near_words(cells(words))
    j = words.join(near, "word", "left")
    fits = F.col("form_n") >= ratio * F.col("n")
    told = cut_lineage(j.select("word", F.when(fits, F.col("form")).alias("form"), "n",
                                F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(fits, F.col("form_n")).alias("form_n")))
    root = roots(told.where(F.col("form").isNotNull()))
    return told.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
