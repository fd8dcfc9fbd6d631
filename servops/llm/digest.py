"""Document fingerprints: quartile bucket digests (operator 10).

A text's byte triplets are hashed into 256 buckets. The digest holds, for each
bucket, the quartile of its count among all buckets (two bits), and a
logarithmic length code. Two digests compare by a bounded difference score.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BUCKETS = 256
#: difference at which two digests count as wholly unlike
BOUND = 480
#: cost of a bucket whose quartiles differ by 0, 1, 2, 3, and of each step of the length code beyond the first
STEP_COST = np.array([0, 1, 3, 6])
LENGTH_COST, LENGTH_MOST = 4, 60
_seed = np.arange(1, 769, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_seed = (_seed ^ (_seed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
_T0, _T1, _T2 = ((_seed >> np.uint64(40)) & np.uint64(255)).astype(np.uint8).reshape(3, 256)
_PIECE = 1 << 20


def bucket_counts(raw: np.ndarray) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(len(raw) - 2, 0), _PIECE):
        b = raw[at:at + _PIECE + 2]
        counts += np.bincount(_T0[b[:-2]] ^ _T1[b[1:-1]] ^ _T2[b[2:]], minlength=BUCKETS)
    return counts


def length_code(n: int) -> int:
    """Steps of a tenth: 0 for no bytes, 255 from about 3e10 bytes on."""
    return 0 if n == 0 else min(255, 1 + int(np.log(n) / np.log(1.1)))


def codes_of(raw: bytes) -> np.ndarray:
    """257 small integers: the quartile (0-3) of each bucket, then the length code."""
    counts = bucket_counts(np.frombuffer(raw, np.uint8))
    ranked = np.sort(counts)
    quarter = BUCKETS // 4
    out = np.empty(BUCKETS + 1, np.uint8)
    out[:BUCKETS] = sum((counts > ranked[k * quarter - 1]).astype(np.uint8) for k in (1, 2, 3))
    out[BUCKETS] = length_code(len(raw))
    return out


def digest_text(codes: np.ndarray) -> str:
    """Length code (2 hex digits), then four buckets a byte (128 hex digits)."""
    q = codes[:BUCKETS].reshape(-1, 4)
    return f"{int(codes[BUCKETS]):02x}" + (q[:, 0] << 6 | q[:, 1] << 4 | q[:, 2] << 2 | q[:, 3]).astype(np.uint8).tobytes().hex()


def digest_codes(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8)
    q = raw[1:]
    out = np.empty(BUCKETS + 1, np.uint8)
    out[:BUCKETS] = np.stack([q >> 6, q >> 4 & 3, q >> 2 & 3, q & 3], 1).ravel()
    out[BUCKETS] = raw[0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, falling with the difference, 0 from ``BOUND`` on."""
    gap = np.abs(a.astype(np.int16) - b.astype(np.int16))
    cost = int(STEP_COST[gap[:BUCKETS]].sum()) + min(LENGTH_MOST, LENGTH_COST * max(0, int(gap[BUCKETS]) - 1))
    return 1.0 - min(cost, BOUND) / BOUND


def fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the digest of each whole text; null counts as empty. A column called ``out`` is replaced."""
    schema = docs.drop(out).schema.add(out, "string")

    def run(batches):
        for b in batches:
            b = b.drop_columns([out]) if out in b.schema.names else b
            texts = b.column(text_col).to_pylist()
            found = [digest_text(codes_of((t or "").encode("utf-8"))) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, out])
    return docs.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last third of ``text``'s code points replaced by as many first ones of ``following``."""
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def _row(text: str, codes, following: str, following_codes):
    raw = edited(text, following).encode("utf-8")
    other = codes_of(raw)
    return (len(text), hashlib.sha256(raw).hexdigest(), digest_text(codes), digest_text(other),
            likeness(codes, other), likeness(codes, following_codes))


_FIELDS = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
_ARROW = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every whole text, of its edited text, and their likeness; one row per row of ``docs``.

    The next document is the one that follows in descending ``id_col`` (null ids come last, equal ids
    by the hash of the text; after the last comes the first). The rows are dealt once into id ranges,
    each read in order with one text kept back. The last row of a range waits for the first text of the
    next range: these few rows (two a range) go through a small join on the range number. A null text is
    empty. The result has ``id_col`` and the six digest columns.
    """
    key = [F.col("_id").desc_nulls_last(), F.col("_tie")]
    ordered = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
                          F.xxhash64(F.col(text_col)).alias("_tie"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        part = TaskContext.get().partitionId()
        kept = None  # id, text, codes of the row whose next one isn't read yet
        first = None
        for b in batches:
            ids, rows, heads, texts = [], [], [], b.column(1).to_pylist()
            for i, text in enumerate(texts):
                codes = codes_of(text.encode("utf-8"))
                if kept is not None:
                    ids.append(kept[0])
                    rows.append(_row(kept[1], kept[2], text, codes))
                    heads.append(first)
                    first = None
                else:
                    first = text
                kept = (b.column(0).slice(i, 1), text, codes)
            if rows:
                yield pack(part, ids, rows, heads, [None] * len(rows))
        if kept is not None:
            yield pack(part, [kept[0]], [(len(kept[1]), None, digest_text(kept[2]), None, None, None)], [first], [kept[1]])

    def pack(part, ids, rows, heads, tails):
        cols = [pa.array([part] * len(rows), pa.int32()), pa.concat_arrays(ids)]
        cols += [pa.array([r[k] for r in rows], t) for k, t in enumerate(_ARROW)]
        return pa.RecordBatch.from_arrays(cols + [pa.array(heads, pa.string()), pa.array(tails, pa.string())],
                                          names=names)

    names = ["part", "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
             "near_next", "head", "tail"]
    table = cut_lineage(ordered.select("_id", "_text").mapInArrow(
        run, f"part int, id {kind}, {_FIELDS}, head string, tail string"))

    # a range's last row meets the first text of the next range that has rows (after the last: the first range)
    w = Window.orderBy("part")
    turn = table.where(F.col("head").isNotNull()).select("part") \
        .select("part", F.coalesce(F.lead("part").over(w), F.min("part").over(w)).alias("then"))
    heads = table.where(F.col("head").isNotNull()).select(F.col("part").alias("then"), "head")
    waiting = table.where(F.col("tail").isNotNull()).select("part", "id", "tail") \
        .join(turn, "part").join(heads, "then").select("id", "tail", "head")

    def finish(batches):
        for b in batches:
            rows = [_row(t, codes_of(t.encode("utf-8")), h, codes_of(h.encode("utf-8")))
                    for t, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(_ARROW)]],
                names=["id", *names[2:8]])
    done = waiting.mapInArrow(finish, f"id {kind}, {_FIELDS}")
    rest = table.where(F.col("tail").isNull()).select("id", *names[2:8])
    return rest.unionByName(done).withColumnRenamed("id", id_col)
