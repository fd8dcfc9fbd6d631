"""A bit table of fixed size that lets rows through whose key may be in a set.

Used before a shuffled join, to keep rows on the map side that can't have a partner. Its size is a
parameter, not a function of the data: a set too large for it lets more rows through, never fewer.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 1 << 21


def bit_table(keys: DataFrame, col: str, bits: int = BITS):
    """Broadcast bits of the 64-bit hashes in ``col``: at most ``bits`` / 8 bytes pass the driver."""
    at = F.pmod(F.col(col), F.lit(bits))
    words = keys.select(at.alias("_at")).select(F.floor(F.col("_at") / 32).alias("_word"), (F.col("_at") % 32).alias("_bit")) \
        .groupBy("_word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit").cast("int"))).alias("_bits"))
    table = np.zeros(bits // 32, "<u4")
    found = words.toArrow()
    table[found.column(0).to_numpy()] = found.column(1).to_numpy().astype("<u4")
    return keys.sparkSession.sparkContext.broadcast(table.tobytes())


#: bits of a chunk that tables of places are put together from; keys that a task deals to chunks at once
CHUNK, DEALT = 1 << 16, 1 << 19


def place_table(keys: DataFrame, bits: int, made: Callable | None = None):
    """Broadcast bits of the 64-bit hashes in the one column of ``keys``, at two places each (``held_twice``).

    ``made``: makes that column from batches of ``keys``, in the same Python worker that deals them out.

    ``bits``: a power of two, ``CHUNK`` at least. Tasks send the places of a chunk as two bytes each, or the chunk
    itself where that is shorter; chunks are put together where they meet, and ``bits`` / 8 bytes pass the driver.
    """
    def chunk_of(at: np.ndarray) -> np.ndarray:
        out = np.zeros(CHUNK, np.uint8)
        out[at] = 1
        return np.packbits(out, bitorder="little")

    def deal(held: list[np.ndarray]):
        h = np.concatenate(held)
        at = np.unique(np.concatenate((h, h >> np.uint64(32))) & np.uint64(bits - 1))
        which, first = np.unique(at // np.uint64(CHUNK), return_index=True)
        parts = [p.astype("<u2") for p in np.split(at % np.uint64(CHUNK), first[1:])]
        sent = [p.tobytes() if 2 * len(p) < CHUNK // 8 else chunk_of(p).tobytes() for p in parts]
        return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(sent, pa.binary())], names=["chunk", "at"])

    def send(batches):
        held, many = [], 0
        for b in made(batches) if made else batches:
            held.append(b.column(0).to_numpy().view(np.uint64))
            many += len(held[-1])
            if many >= DEALT:
                yield deal(held)
                held, many = [], 0
        if many:
            yield deal(held)

    def meet(batches):
        chunk, whole = None, None
        for b in batches:
            for c, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if c != chunk:
                    if whole is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([whole.tobytes()], pa.binary())], names=["chunk", "at"])
                    chunk, whole = c, np.zeros(CHUNK // 8, np.uint8)
                whole |= np.frombuffer(at, np.uint8) if len(at) == CHUNK // 8 else chunk_of(np.frombuffer(at, "<u2"))
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([whole.tobytes()], pa.binary())], names=["chunk", "at"])
    sent = keys.mapInArrow(send, "chunk int, at binary").repartition("chunk").sortWithinPartitions("chunk")
    table = np.zeros(bits // 8, np.uint8)
    for batch in sent.mapInArrow(meet, "chunk int, at binary").toArrow().to_batches():
        for c, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            table[c * (CHUNK // 8):(c + 1) * (CHUNK // 8)] = np.frombuffer(at, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table.tobytes())


def held_twice(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False only for 64-bit hashes (unsigned) that are not in a ``place_table``."""
    out = held(table, hashes)
    some = np.flatnonzero(out)  # few, as a rule
    out[some] = held(table, hashes[some] >> np.uint64(32))
    return out


def held(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False only for 64-bit hashes (unsigned) that are not in the set; ``table``: its bytes as an array."""
    at = hashes & np.uint64(8 * len(table) - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def may_hold(table, hashes: Column) -> Column:
    """The same test for a column of 64-bit hashes; ``table`` is the broadcast bytes."""
    @F.arrow_udf(T.BooleanType())
    def test(values: pa.Array) -> pa.Array:
        known = pc.fill_null(values, 0).to_numpy(zero_copy_only=False).view(np.uint64)
        return pc.and_(pa.array(held(np.frombuffer(table.value, np.uint8), known)), values.is_valid())
    return test(hashes)
