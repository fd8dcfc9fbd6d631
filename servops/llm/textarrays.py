"""Whole-text work on Arrow batches with numpy: byte views and word hashes.

Texts are handled as the UTF-8 bytes Arrow holds. The hashing walks a batch in
pieces of about 256 KB that end between words, so the scratch arrays stay small
whatever the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_tables: dict = {}


def byte_view(column):
    """(bytes of all texts, offsets of each text) of an Arrow string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) \
        else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def byte_class(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


#: words of the form [^\x20\x09-\x0D]+
NOT_SPACE = byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int):
    """Powers of the hash base and of its inverse modulo 2^64, and the 64-bit code of each (lower-cased) byte."""
    if _tables.get("n", 0) < n:
        n = max(n, PIECE + 4096)
        inverse = pow(_BASE, -1, 1 << 64)

        def series(b):
            out = np.ones(n, np.uint64)
            out[1:] = b
            return np.multiply.accumulate(out)
        codes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))[_LOWER]
        _tables.update(n=n, up=series(np.uint64(_BASE)), down=series(np.uint64(inverse)), codes=codes)
    return _tables["up"], _tables["down"], _tables["codes"]


def word_hashes(data: np.ndarray, off: np.ndarray, is_word: np.ndarray):
    """64-bit hashes of the words (A-Z lower-cased) of all texts.

    Returns (hashes, first byte of each word, end byte of each word, index of the first word of
    each text with the total at the end). A word is a longest run of ``is_word`` bytes in a text.
    """
    n = len(data)
    cuts = off[1:-1]
    hs, ss, es = [], [], []
    pos = 0
    while pos < n:
        end = min(pos + PIECE, n)
        if end < n and is_word[data[end - 1]] and is_word[data[end]]:
            # step back to the last place between two words, else on to the next one
            gap = np.flatnonzero(~is_word[data[pos:end]])
            back = pos + int(gap[-1]) + 1 if len(gap) else pos
            k = int(np.searchsorted(cuts, end, "right"))
            if k and cuts[k - 1] > back:
                back = int(cuts[k - 1])
            if back > pos:
                end = back
            else:
                stop = int(cuts[k]) if k < len(cuts) else n
                while end < stop:
                    ahead = np.flatnonzero(~is_word[data[end:min(end + PIECE, stop)]])
                    if len(ahead):
                        end += int(ahead[0])
                        break
                    end = min(end + PIECE, stop)
        piece = data[pos:end]
        flag = is_word[piece]
        first = flag.copy()
        first[1:] &= ~flag[:-1]
        lo, hi = np.searchsorted(cuts, pos, "left"), np.searchsorted(cuts, end, "left")
        inner = cuts[lo:hi] - pos
        first[inner] = flag[inner]
        last = flag.copy()
        last[:-1] &= ~flag[1:]
        inner = inner[inner > 0] - 1
        last[inner] |= flag[inner]
        s = np.flatnonzero(first)
        if len(s):
            e = np.flatnonzero(last) + 1
            up, down, codes = _powers(len(piece) + 1)
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(codes[piece] * up[:len(piece)], out=total[1:])
            h = (total[e] - total[s]) * down[s]
            hs.append(mix64(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            ss.append(s + pos)
            es.append(e + pos)
        pos = end
    if hs:
        h, s, e = np.concatenate(hs), np.concatenate(ss), np.concatenate(es)
    else:
        h, s, e = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return h, s, e, np.searchsorted(s, off, "left")


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's ``width``-word shingles.

    Fewer words give one shingle, the whole sequence; no words give none.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(width, n)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = mix64(h * np.uint64(0x9FB21C651E98DF25) + words[i:n - k + 1 + i])
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def small_batches(batches, col: int = 0, most: int = 1 << 20):
    """The rows of ``batches`` in batches of at most ``most`` bytes of text in column ``col`` (or one row).

    Scratch arrays are several times a batch's text; this keeps them small whatever Spark's batch size.
    """
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(col)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        at = 0
        while at < len(ends):
            base = ends[at] - size[at]
            end = max(int(np.searchsorted(ends, base + most, "right")), at + 1)
            yield b.slice(at, end - at)
            at = end
