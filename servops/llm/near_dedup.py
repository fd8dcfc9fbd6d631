"""Near-duplicate documents by circulant MinHash (operator 4).

A document's shingles go through one permutation; a second permutation, shifted circularly by
0, 1, 2, ... places, gives all coordinates of its signature. Documents that agree in a band of
coordinates share a bucket. Links are confirmed on the full shingle sets.

Documents with the same shingle set are one node. ``linking`` joins the nodes of the buckets into
components; a document's component is the same as with every pair of every bucket confirmed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import sieve
from .linking import Measure, linked_components, shared_buckets
from .textarrays import NOT_SPACE, byte_view, mix64, shingles, small_batches, word_hashes

#: 36 bands of 5 coordinates: a pair of similarity 0.8 shares no band once in 1.7 million, one of 0.2 once in 87 does
BANDS, ROWS = 36, 5
#: share of equal coordinates below which a pair isn't confirmed; a pair of 0.8 falls below it once in a million
AGREE = 0.66
#: shingles a block of texts that are compared in one cell, about
CELL = 1 << 17
_GROUP = 1 << 16


def permute_once(x: np.ndarray) -> np.ndarray:
    """The first permutation, of 64-bit shingle hashes; the upper half of the result is used."""
    return (mix64(x ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


def circulant_signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """Signature coordinates (one row a non-empty set): coordinate k is the least second permutation,
    shifted by k, over the once permuted shingles.

    The second permutation of 32-bit numbers is v -> m2 * (w ^ w >> 15) with w = m1 * v; shifting
    its argument by k takes m1 * k off w.
    """
    out = np.empty((len(sets), size), np.uint32)
    m1, m2 = 0x85EBCA6B, np.uint32(0xC2B2AE35)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= _GROUP):
            total += len(sets[end])
            end += 1
        group = sets[at:end]
        w = permute_once(np.concatenate(group)) * np.uint32(m1)
        first = np.cumsum([0] + [len(s) for s in group[:-1]])
        v, t = np.empty_like(w), np.empty_like(w)
        for k in range(size):
            np.subtract(w, np.uint32(m1 * k & 0xFFFFFFFF), out=v)
            np.right_shift(v, np.uint32(15), out=t)
            np.bitwise_xor(v, t, out=v)
            np.multiply(v, m2, out=v)
            out[at:end, k] = np.minimum.reduceat(v, first)
        at = end
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band."""
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), parts.shape[:2]).copy()
    for r in range(rows):
        h = mix64(h * np.uint64(0x9FB21C651E98DF25) + parts[:, :, r])
    return h.view(np.int64)


def text_sets(column, width: int) -> list[np.ndarray]:
    """Sorted shingle hashes of each text of an Arrow column."""
    data, off = byte_view(column)
    hashes, _, _, first = word_hashes(data, off, NOT_SPACE)
    return [shingles(hashes[first[i]:first[i + 1]], width) for i in range(len(off) - 1)]


def sign(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """id, hash of the text, n_shingles, node (64-bit hash of the shingle set, null if empty),
    sig (one byte a coordinate) and band keys of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).alias("text"))

    def run(batches):
        for b in small_batches(batches, 2):
            sets = text_sets(b.column(2), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            sigs = circulant_signatures([sets[i] for i in full], bands * rows)
            keys = band_keys(sigs, bands, rows)
            low = (sigs * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)  # minima are small: mix before cutting
            node, sig, band = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            for k, i in enumerate(full):
                s = sets[i]
                node[i] = int(mix64(s).sum(dtype=np.uint64).view(np.int64))
                sig[i], band[i] = low[k].tobytes(), keys[k]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()),
                 pa.array(sig, pa.binary()), pa.array(band, pa.list_(pa.int64()))],
                names=["id", "tie", "n", "node", "sig", "bands"])
    return picked.mapInArrow(run, f"id {kind}, tie long, n long, node long, sig binary, bands array<long>")


def _measure(size: int, percent: int) -> Measure:
    """Equal coordinates of two signatures; sizes that allow the similarity."""
    return Measure(score=lambda a, b: (a == b).sum(1), least=int(AGREE * size),
                   fits=lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m),
                   fits_arrays=lambda n, m: 100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def linked_sets(xs: list[np.ndarray], ys: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether the full sets have 100 * intersection >= percent * union."""
    out = np.zeros(len(xs), bool)
    for k, (s, t) in enumerate(zip(xs, ys)):
        both = len(np.intersect1d(s, t, assume_unique=True))
        out[k] = both > 0 and 100 * both >= percent * (len(s) + len(t) - both)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Class of every document: ``id_col``, text_hash, n_shingles, component_id, kept; one row per row of ``docs``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document's set holds its distinct
    ``width``-word shingles (the whole sequence if it has fewer words). Documents are linked whose
    sets have 100 * intersection >= percent * union. ``component_id`` is the least id reachable over
    links, its own included. ``kept`` marks the class's row with the least (id, hash of the text);
    repeated rows are marked alike. A null or wordless text has an empty set and is linked with
    nothing. A null id counts as greater than any other. Other columns aren't read.
    """
    signed = cut_lineage(sign(docs, id_col, text_col, width, bands, rows))
    nodes = signed.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.min("n").alias("n"), F.min("tie").alias("tie"), F.first("sig").alias("sketch"), F.first("bands").alias("bands"))
    nodes = cut_lineage(nodes)
    shared = shared_buckets(nodes.select("node", "n", F.explode("bands").alias("key")))
    candidates = shared.select("node").distinct()
    maybe = sieve.bit_table(candidates, "node")
    sketches = cut_lineage(nodes.select("node", "tie", "n", "sketch").where(sieve.may_hold(maybe, F.col("node")))
                           .join(candidates, "node", "left_semi"))
    # one text of each node in a bucket: only those texts are shuffled
    wanted = sieve.bit_table(sketches, "tie")
    texts = docs.select(F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).alias("text")) \
        .where(sieve.may_hold(wanted, F.col("tie"))).join(sketches, "tie").groupBy("node").agg(F.first("text").alias("text"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    texts = cut_lineage(texts)
    blocks = 1 + (texts.agg(F.sum("n")).first()[0] or 0) // CELL
    component = linked_components(
        shared, texts, _measure(bands * rows, percent), blocks,
        lambda found: text_sets(pa.array(found, pa.string()), width), lambda xs, ys: linked_sets(xs, ys, percent))

    # classes of all rows
    least_id = F.struct(F.col("id").isNull().alias("no_id"), "id", "tie")
    owner = signed.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(least_id).alias("own")) \
        .join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = owner.groupBy("component").agg(F.min("own").alias("head"))
    classes = owner.join(heads, "component").select("node", "head")
    j = signed.select("id", "tie", "n", "node").join(classes, "node", "left")
    head = F.coalesce("head", least_id)
    return j.select(F.col("id").alias(id_col), F.col("tie").alias("text_hash"), F.col("n").alias("n_shingles"),
                    head["id"].alias("component_id"),
                    (head["id"].eqNullSafe(F.col("id")) & (head["tie"] == F.col("tie"))).alias("kept"))
