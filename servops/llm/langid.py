"""Language identification by prediction by partial matching (operator 5).

Each language has a tree of byte contexts up to three bytes long, grown from labelled texts: a
context is kept while it was seen often enough. A byte costs the code length its longest kept
context gives it; where that context hasn't seen the byte, the cost of an escape (distinct bytes
against all bytes seen, method C) is added and the next shorter context decides, down to a uniform
code. The statistics are frozen, so costs are flattened into one table and a text's code
length in every language is a sum of table rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .textarrays import byte_view, small_batches

UNDECIDED = "und"
#: labelled texts a language is learnt from, expected number (chosen by a hash of the key)
TEXTS_A_LANGUAGE = 600
#: times a context must have been seen to be kept; bytes of the longest context
SEEN, ORDER = 4, 3
#: bytes of evidence the score counts at most
EVIDENCE = 64
#: parts of the labelled texts, each measured by what the others taught to set the limits of ``clear_texts``; texts a
#: language must have for that
PARTS, ENOUGH = 2, 10
#: bits by which a text must be beyond a limit; part of a text that must speak for one language
BEYOND, PART = 32, 2 / 3
_PIECE = 1 << 19
#: bytes of text measured at once; counts a task sums up before it sends them
_BATCH, _HELD = 1 << 20, 1 << 20


@dataclass
class LanguageModel:
    """Counts of (three-byte context, byte) per language; byte 0 stands before the text."""
    languages: list[str]
    grams: np.ndarray  # context and byte as four bytes in one number
    which: np.ndarray  # language of each count
    counts: np.ndarray


def gram_numbers(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(context, byte) of every byte of every text as one number, contexts padded with zeros before the text."""
    out = data.astype(np.uint32)
    position = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
    for back in (1, 2, 3):
        before = np.zeros(len(data), np.uint32)
        before[back:] = data[:-back] if back < len(data) else data[:0]
        before[position < back] = 0
        out |= before << np.uint32(8 * back)
    return out


def _pieces(data: np.ndarray, off: np.ndarray):
    """(numbers of the texts in it, gram numbers, starts) for pieces of a batch; long texts are cut with their context kept."""
    i, n = 0, len(off) - 1
    while i < n:
        j = i + 1
        while j < n and off[j + 1] - off[i] <= _PIECE:
            j += 1
        if off[j] - off[i] <= _PIECE:
            size = np.diff(off[i:j + 1])
            full = np.flatnonzero(size)
            if len(full):
                yield i + full, gram_numbers(data[off[i]:off[j]], off[i:j + 1] - off[i]), (off[i:j] - off[i])[full]
        else:
            for at in range(int(off[i]), int(off[j]), _PIECE):
                lead = min(3, at - int(off[i]))
                part = data[at - lead:min(at + _PIECE, int(off[j]))]
                yield np.array([i]), gram_numbers(part, np.array([0, len(part)]))[lead:], np.array([0])
        i = j


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, sum of the counts of each)."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(key) else count


def _model(languages: list[str], which: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> LanguageModel:
    order = np.lexsort((grams, which))
    return LanguageModel(languages, grams[order], which[order], counts[order])


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", key: Column | None = None,
          texts_a_language: int | None = TEXTS_A_LANGUAGE) -> LanguageModel:
    """Model from the labelled rows of ``docs`` (null labels are left out, null texts teach nothing).

    With ``texts_a_language``, learns from a sample bounded by it: rows are chosen by a hash of ``key``
    (default: the text) with a share per language that gives that many rows. With None, every labelled row teaches.
    Counts are summed in the tasks and on the executors; what comes to the driver is one row for each (context, byte)
    that a language has.
    """
    rows = docs.where(F.col(lang_col).isNotNull())
    if texts_a_language is None:
        sample, languages = rows, sorted(r[0] for r in rows.select(lang_col).distinct().collect())
    else:
        sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).alias("l")).count().collect()}
        languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if texts_a_language is not None:
        scale = 1 << 20
        share = F.create_map(*[F.lit(v) for k in languages for v in (k, min(scale, -(-scale * texts_a_language // sizes[k])))])
        draw = F.pmod(F.xxhash64(key if key is not None else F.col(text_col), F.lit(5)), F.lit(scale))
        sample = rows.where(draw < share[F.col(lang_col)])
    place = {k: i for i, k in enumerate(languages)}

    def run(batches):
        def send(held):
            pairs, count = held
            return pa.RecordBatch.from_arrays([pa.array((pairs >> np.uint64(32)).astype(np.int32)),
                                               pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(count)],
                                              names=["l", "gram", "n"])
        keys, counts, many = [], [], 0
        for b in small_batches(batches, 1, _BATCH):
            label = np.array([place[x] for x in b.column(0).to_pylist()], np.uint64) << np.uint64(32)
            data, off = byte_view(b.column(1))
            for texts, grams, starts in _pieces(data, off):
                pairs, count = np.unique(np.repeat(label[texts], np.diff(np.append(starts, len(grams)))) | grams, return_counts=True)
                keys.append(pairs)
                counts.append(count.astype(np.int64))
                many += len(pairs)
            if many >= _HELD:
                pairs, count = _summed(keys, counts)
                keys, counts, many = [pairs], [count], len(pairs)
                if many >= _HELD // 2:
                    yield send((pairs, count))
                    keys, counts, many = [], [], 0
        if keys:
            yield send(_summed(keys, counts))
    found = sample.select(F.col(lang_col).alias("l"), F.col(text_col).alias("t")).mapInArrow(run, "l int, gram long, n long") \
        .groupBy("l", "gram").agg(F.sum("n").alias("n")).toArrow()
    return _model(languages, found.column("l").to_numpy().astype(np.int64), found.column("gram").to_numpy().astype(np.uint32),
                  found.column("n").to_numpy())


def merge(models: list[LanguageModel]) -> LanguageModel:
    """The model of all the rows that the models have learnt from, each row in one of them."""
    languages = sorted({k for m in models for k in m.languages})
    place = {k: i for i, k in enumerate(languages)}
    keys = [np.array([place[k] for k in m.languages] or [0], np.uint64)[m.which] << np.uint64(32) | m.grams for m in models]
    pairs, counts = _summed(keys, [m.counts for m in models])
    return LanguageModel(languages, (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32), (pairs >> np.uint64(32)).astype(np.int64), counts)


class _Level:
    """One language's contexts of one length: sorted (context, byte) numbers with their bits, contexts with their escapes."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int):
        self.mask = np.uint32((1 << 8 * (depth + 1)) - 1)
        pairs, place = np.unique(grams & self.mask, return_inverse=True)
        count = np.bincount(place, weights=counts, minlength=len(pairs))
        contexts, place = np.unique(pairs >> np.uint32(8), return_inverse=True)
        total, kinds = (np.bincount(place, weights=w, minlength=len(contexts)) for w in (count, None))
        kept = total >= (SEEN if depth else 1)
        with np.errstate(divide="ignore"):
            bits = -np.log2(count / (total + kinds)[place])
        self.pairs, self.bits = pairs[kept[place]], bits[kept[place]]
        self.contexts, self.escape = contexts[kept], -np.log2(kinds / (total + kinds))[kept]

    def after(self, grams: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Bits of each gram's byte in this level's context, from its bits after the next shorter one."""
        at, known = _find(self.contexts, (grams & self.mask) >> np.uint32(8))
        bits = shorter.copy()
        bits[known] += self.escape[at[known]]
        at, known = _find(self.pairs, grams & self.mask)
        bits[known] = self.bits[at[known]]
        return bits


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted keys, whether it is there) of each wanted number."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class CodeLengths:
    """The model as sorted arrays: bits of every byte after its longest kept context, a column a language."""

    def __init__(self, model: LanguageModel):
        self.levels = [[_Level(model.grams[model.which == k], model.counts[model.which == k], d) for d in range(ORDER + 1)]
                       for k in range(len(model.languages))]

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Bits of each (context, byte) in every language (columns)."""
        out = np.full((len(grams), len(self.levels)), 8.0)
        for k, levels in enumerate(self.levels):
            for level in levels:
                out[:, k] = level.after(grams, out[:, k])
        return out

    def of(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length in bits of every whole text (rows) in every language (columns)."""
        out = np.zeros((len(off) - 1, len(self.levels)))
        for texts, grams, starts in _pieces(data, off):
            kinds, place = np.unique(grams, return_inverse=True)
            np.add.at(out, texts, np.add.reduceat(self.bits(kinds)[place], starts, axis=0))
        return out


def _share(spark, model: LanguageModel):
    """Broadcast of the model as plain arrays: a broadcast names classes by their module, which a worker needn't have."""
    return spark.sparkContext.broadcast({"languages": model.languages, "grams": model.grams, "which": model.which,
                                         "counts": model.counts})


def _lengths(shared: dict) -> CodeLengths:
    """The worker's code lengths, made once a model."""
    if "lengths" not in shared:
        shared["lengths"] = CodeLengths(LanguageModel(*(shared[k] for k in ("languages", "grams", "which", "counts"))))
    return shared["lengths"]


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred",
            score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and a score from 0 to 1 (columns of those names are replaced).

    The language with the least code length of the whole text wins, ties by name. The score is its
    share of the likelihood at the text's rate, over at most ``EVIDENCE`` bytes. A text that is
    null or has no letter, and every text if no language was learnt, is ``und`` with score 0.
    No shuffle; the model goes to the workers with the function, its size is bounded by the sample.
    """
    shared = _share(docs.sparkSession, model)
    no_language = not model.languages

    @F.arrow_udf("struct<lang:string,score:double>")
    def identify(texts: pa.Array) -> pa.Array:
        data, off = byte_view(texts)
        bits = _lengths(shared.value).of(data, off)
        best = bits.argmin(1)
        size = np.maximum(np.diff(off), 1)
        ahead = (bits - bits.min(1, keepdims=True)) * (np.minimum(size, EVIDENCE) / size)[:, None]
        score = 1 / np.exp2(-np.minimum(ahead, 1000)).sum(1)
        names = np.array(shared.value["languages"], object)[best]
        return pa.StructArray.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(score)], names=["lang", "score"])
    found = F.lit(None).cast("struct<lang:string,score:double>") if no_language else identify(F.col(text_col))
    speaks = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)) & F.lit(not no_language)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (lang_out, score_out)]
    r = docs.select(F.struct(*kept).alias("row"), found.alias("told"), speaks.alias("speaks"))
    return r.select("row.*", F.when(F.col("speaks"), F.col("told.lang")).otherwise(F.lit(UNDECIDED)).alias(lang_out),
                    F.when(F.col("speaks"), F.col("told.score")).otherwise(F.lit(0.0)).alias(score_out))


def letters(text: Column) -> Column:
    """The text's words in lower case with one space between: style, numbers and codes say nothing about its language."""
    plain = F.regexp_replace(F.lower(text), r"(?<![\p{L}\p{M}])[\p{L}\p{M}]*+\p{N}[\p{L}\p{M}\p{N}]*+|[^\p{L}\p{M}]++", " ")
    return F.regexp_replace(plain, " {2,}+", " ")


def part_of(text: Column) -> Column:
    """Which of the ``PARTS`` a labelled text belongs to; the same for equal texts."""
    return F.pmod(F.xxhash64(text, F.lit(9)), F.lit(PARTS))


def _best(bits: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its bits a byte, bits a byte by which the second best is behind; 0 with one language)."""
    order = np.sort(bits, axis=1)
    second = order[:, min(1, bits.shape[1] - 1)]
    return bits.argmin(1), order[:, 0] / size, (second - order[:, 0]) / size


def measure(docs: DataFrame, model: LanguageModel, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(l, rate, noise, lead) of every labelled row whose ``letters`` have at least ``EVIDENCE`` bytes.

    Bits a byte of the whole text in its own language, of the same letters in random order in their best one, and the text's lead
    before the second language. ``model`` has learnt from ``letters``, and should not from these rows; ``text_col`` holds letters.
    """
    rows = docs.where(F.col(lang_col).isin(model.languages) & (F.octet_length(text_col) >= EVIDENCE)) \
        .select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    shared = _share(docs.sparkSession, model)

    def run(batches):
        place = {k: i for i, k in enumerate(shared.value["languages"])}
        for b in small_batches(batches, 1, _BATCH):
            mixed = []
            for t in b.column(1).to_pylist():
                points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
                mixed.append(np.random.default_rng(len(points)).permutation(points).tobytes().decode("utf-32-le"))
            own = np.array([place[x] for x in b.column(0).to_pylist()], np.int64)
            data, off = byte_view(b.column(1))
            size = np.maximum(np.diff(off), 1)
            bits = _lengths(shared.value).of(data, off)
            rate = bits[np.arange(len(own)), own] / size if len(own) else np.zeros(0)
            noise = _best(_lengths(shared.value).of(*byte_view(pa.array(mixed, pa.string()))), size)[1]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rate), pa.array(noise), pa.array(_best(bits, size)[2])],
                                             names=["l", "rate", "noise", "lead"])
    return rows.mapInArrow(run, "l string, rate double, noise double, lead double")


def limits(measured: DataFrame) -> dict[str, tuple[float, float, float]]:
    """Language -> medians of (rate, noise, lead) over all its rows in ``measured``, so a few wrong labels move nothing.

    Values count in steps of a thousandth of a bit, so a median is found from counts of at most some thousand
    values, however many rows there are. Languages with fewer than ``ENOUGH`` rows have no entry.
    """
    found = measured.groupBy("l").agg(
        F.count(F.lit(1)).alias("n"), *[F.percentile(F.round(c, 3), F.lit(0.5)).alias(c) for c in ("rate", "noise", "lead")])
    return {r["l"]: (r["rate"], r["noise"], r["lead"]) for r in found.collect() if r["n"] >= ENOUGH}


def calibrate(docs: DataFrame, model: LanguageModel, lang_col: str = "lang", text_col: str = "text") -> dict[str, tuple[float, float, float]]:
    """The ``limits`` of all labelled rows, which ``model`` should not have learnt from."""
    if not model.languages:
        return {}
    return limits(measure(docs.select(lang_col, letters(F.col(text_col)).alias(text_col)), model, lang_col, text_col))


def learn_with_limits(docs: DataFrame, lang_col: str = "lang",
                      text_col: str = "text") -> tuple[LanguageModel, dict[str, tuple[float, float, float]]]:
    """(model of the ``letters`` of every labelled row, limits from every labelled row).

    The rows are dealt into ``PARTS`` by their text. A part is measured by what the other parts taught, so no text sets limits
    by itself; the model has learnt from all parts.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = cut_lineage(rows.select(F.col(lang_col).alias("lang"), part_of(F.col(text_col)).alias("part"), letters(F.col(text_col)).alias("text")))
    parts = [rows.where(F.col("part") == i) for i in range(PARTS)]
    models = [learn(p, texts_a_language=None) for p in parts]
    others = [merge(models[:i] + models[i + 1:]) for i in range(PARTS)]
    measured = [measure(p, m) for p, m in zip(parts, others) if m.languages]
    return merge(models), limits(reduce(DataFrame.unionByName, measured)) if measured else {}


def clear_texts(docs: DataFrame, model: LanguageModel, limits: dict[str, tuple[float, float, float]], lang_col: str = "lang",
                text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text has a letter and isn't gibberish, foreign to all languages of the model or mixed.

    Judged on its ``letters``, in the best language of a model that has learnt from such: it goes when a byte costs more than midway between
    the language's texts and the same letters in random order, or when less than two thirds of it
    speak for the language (a text with a part p of it is (1 - p) leads dearer than usual and has a lead of 2 p - 1
    times the usual one), by ``BEYOND`` bits each. A best language without limits has the first limit of the language
    where it is highest. Rows stay where the limits can't tell: there are none, or none for the language
    that the row is labelled with.
    """
    speaks = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    if not limits:
        return docs.where(speaks)
    shared = _share(docs.sparkSession, model)
    lenient = (*max((x[:2] for x in limits.values()), key=sum), 0.0)

    @F.arrow_udf("boolean")
    def clear(texts: pa.Array) -> pa.Array:
        data, off = byte_view(texts)
        size = np.maximum(np.diff(off), 1)
        best, rate, lead = _best(_lengths(shared.value).of(data, off), size)
        usual, noise, ahead = np.array([limits.get(k, lenient) for k in shared.value["languages"]]).T[:, best]
        gibberish = (rate - (usual + noise) / 2) * size > BEYOND
        mixed = (((rate - usual) - (1 - PART) * ahead) * size > BEYOND) & (((2 * PART - 1) * ahead - lead) * size > BEYOND)
        return pa.array(~(gibberish | mixed))
    told = F.col(lang_col).isNull() | F.col(lang_col).isin(list(limits))
    kept = F.when(~speaks, False).when(~told, True).otherwise(clear(letters(F.col(text_col))))
    r = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), kept.alias("clear"))
    return r.where("clear").select("row.*")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never teach: crc32 of the id as text leaves 1 when divided by 3 (a null id doesn't)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
