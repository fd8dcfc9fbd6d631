"""Exact token counts at every prefix of a text (operator 2).

Byte-pair encoding splits a text by a pattern and encodes each piece alone. The
encoding of every prefix of a piece follows from the encodings of its shorter
prefixes: the last token of a prefix is the one vocabulary entry that ends
there and stands next to the last token before it unmerged. So one pass over a
piece gives the exact count at each of its prefixes. A text's counts are kept
as one signed byte per text byte, the change of the count, built by joining
its pieces' changes; sums of that string answer truncation and budget questions
without encoding again.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pattern byte-level BPE splits texts by, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: pieces up to this many characters are remembered, so many at most (each worker)
REMEMBER_CHARS, REMEMBER = 48, 500_000


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Counts of byte-level BPE tokens at every prefix, from a tokenizer's .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_of_char()
        raw = lambda s: bytes(back[c] for c in s)
        model = spec["model"]
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.tokens = {raw(t) for t in model["vocab"] if t not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.starts = {t[:k] for t in self.tokens for k in range(1, len(t) + 1)}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") \
            if special else None
        self.pattern = regex.compile(PATTERN)
        self.space = regex.compile(r"\s+")
        self.inner_space = regex.compile(r"\s (?:\s|\Z)")
        self.known: dict[str, bytes] = {}
        self.size: dict[str, int] = {}
        self.step: dict[tuple[bytes, int], tuple[bytes, bytes]] = {}
        self.apart: dict[tuple[bytes, bytes], bool] = {}

    def _merged(self, raw: bytes) -> list[bytes]:
        """Plain byte-pair merging, for a few bytes only."""
        parts = [raw[k:k + 1] for k in range(len(raw))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:])]
            least = min(ranks)
            if least == 1 << 60:
                break
            k = ranks.index(least)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def stays_apart(self, a: bytes, b: bytes) -> bool:
        """Whether two neighbouring tokens are how their bytes are encoded."""
        found = self.apart.get((a, b))
        if found is None:
            if len(self.apart) >= REMEMBER:
                self.apart.clear()
            found = self.apart[a, b] = self._merged(a + b) == [a, b]
        return found

    def _suffix(self, of: bytes) -> bytes:
        """The longest vocabulary entry that ends ``of`` (itself included)."""
        while of not in self.tokens:
            of = of[1:]
        return of

    def counts(self, raw: bytes) -> list[int]:
        """Tokens of raw[:k] for k = 0 .. len(raw), raw being one piece.

        ``state`` is the longest end of the prefix that some entry starts with, so the entries that
        end here are among its ends; they are tried from the longest on.
        """
        n = len(raw)
        last: list[bytes] = [b""] * (n + 1)
        count = [0] * (n + 1)
        state = b""
        if len(self.step) > REMEMBER:
            self.step.clear()
        for end in range(1, n + 1):
            move = (state, raw[end - 1])
            found = self.step.get(move)
            if found is None:
                state += raw[end - 1:end]
                while state not in self.starts:
                    state = state[1:]
                found = self.step[move] = (state, self._suffix(state))
            state, t = found
            while True:
                at = end - len(t)
                if not at:
                    break
                pair = (last[at], t)
                apart = self.apart.get(pair)
                if self.stays_apart(*pair) if apart is None else apart:
                    break
                t = self._suffix(t[1:])
            last[end], count[end] = t, count[at] + 1
        return count

    def changes(self, piece: str) -> bytes:
        """Change of the count with each byte of a piece of the text."""
        found = self.known.get(piece)
        if found is None:
            count = self.counts(piece.encode("utf-8"))
            if piece in ("'re", "'ve", "'ll"):  # cut after the first letter, the pattern sees a mark and a letter
                count[2] = 2
            found = bytes([(b - a) & 255 for a, b in zip(count, count[1:])])
            if len(piece) <= REMEMBER_CHARS:
                if len(self.known) >= REMEMBER:
                    self.known.clear()
                self.known[piece] = found
        return found

    def length(self, piece: str) -> int:
        return total_of(self.changes(piece))

    def _after_space(self, chunk: str) -> int:
        """Tokens of a space and the text up to the next space, remembered by that text."""
        found = self.size.get(chunk)
        if found is None:
            found = sum(map(self.length, self.pattern.findall(" " + chunk)))
            if len(chunk) <= REMEMBER_CHARS:
                if len(self.size) >= REMEMBER:
                    self.size.clear()
                self.size[chunk] = found
        return found

    def _ordinary(self, text: str) -> tuple[list[str], list[int]]:
        """Text without special strings in chunks, and their tokens.

        The pattern always starts a piece at a space, but for one inside white space with more of it
        (or the end) behind; without such spaces, the chunks between spaces are encoded alone.
        """
        if self.inner_space.search(text):
            pieces = self.pattern.findall(text)
            return pieces, [self.length(p) for p in pieces]
        first, *chunks = text.split(" ")
        try:
            size = self.size
            sizes = [size[c] for c in chunks]
        except KeyError:
            sizes = [self._after_space(c) for c in chunks]
        return [first, *[" " + c for c in chunks]], [sum(map(self.length, self.pattern.findall(first))), *sizes]

    def _segments(self, text: str) -> list[str]:
        """Ordinary text and special strings in turn."""
        return self.special.split(text) if self.special else [text]

    def total(self, text: str) -> int:
        """Tokens of the whole text."""
        return sum(1 if k % 2 else sum(self._ordinary(part)[1]) for k, part in enumerate(self._segments(text)))

    def total_and_cut(self, text: str, limit: int) -> tuple[int, int]:
        """Tokens of the whole text, and the bytes of its longest prefix with at most ``limit``."""
        if self.special and self.special.search(text):
            store = self.store(text)
            return total_of(store), longest_within(store, text.encode("utf-8"), limit)
        chunks, sizes = self._ordinary(text)
        n = sum(sizes)
        if n <= limit:
            return n, len(text.encode("utf-8"))
        # only around the first chunk that passes the limit can a prefix end
        sums = np.cumsum(sizes)
        k = max(int(np.searchsorted(sums, limit, "right")) - 1, 0)
        near = "".join(chunks[k:k + 3])
        done = int(sums[k - 1]) if k else 0
        return n, len("".join(chunks[:k]).encode("utf-8")) + longest_within(self.store(near), near.encode("utf-8"), limit - done)

    def store(self, text: str) -> bytes:
        """Change of the count with each byte of the text: summed up to a code point's end, the tokens of that prefix."""
        out: list[bytes] = []
        ahead = ""  # the last piece before a special string
        for k, part in enumerate(self._segments(text)):
            if k % 2:
                out.append(self._into_special(ahead, part))
                ahead = ""
                continue
            pieces = self.pattern.findall(part)
            done = [self.changes(p) for p in pieces]
            for i in range(len(pieces) - 1):
                space = pieces[i + 1][0]
                if self.space.fullmatch(pieces[i]) and self.space.match(space):
                    # a prefix that ends with this space has the run and the space as one piece
                    extra = self.length(pieces[i] + space) - self.length(pieces[i])
                    own = np.frombuffer(done[i + 1], np.int8).copy()
                    width = len(space.encode("utf-8"))
                    shift = extra - int(own[:width].sum())
                    own[width - 1] += shift
                    if width < len(own):
                        own[width] -= shift
                        done[i + 1] = own.tobytes()
                    else:  # the piece is that one space; what follows takes the difference back
                        done[i + 1] = own.tobytes()
                        if i + 2 < len(pieces):
                            follow = np.frombuffer(done[i + 2], np.int8).copy()
                            follow[0] -= shift
                            done[i + 2] = follow.tobytes()
            out.extend(done)
            ahead = pieces[-1] if pieces else ""
        return b"".join(out)

    def _into_special(self, ahead: str, special: str) -> bytes:
        """Changes over a special string: its proper prefixes are ordinary text, the whole is one token."""
        base = self.length(ahead) if ahead else 0
        at = [base]
        raw = special.encode("utf-8")
        for k in range(1, len(raw)):
            at.append(sum(map(self.length, self.pattern.findall(ahead + raw[:k].decode("utf-8", "ignore")))))
        at.append(base + 1)
        return np.diff(np.array(at, np.int64)).astype(np.int8).tobytes()


def total_of(store: bytes) -> int:
    return int(np.frombuffer(store, np.int8).sum(dtype=np.int64)) if len(store) > 24 else \
        sum(store) - 256 * sum(b > 127 for b in store)


def _ends(raw: bytes) -> np.ndarray:
    """True at bytes that end a code point."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, bool)
    return np.append((b[1:] & 0xC0) != 0x80, True)


def longest_within(store: bytes, raw: bytes, budget: int) -> int:
    """Bytes of the longest prefix (whole code points) with at most ``budget`` tokens."""
    counts = np.cumsum(np.frombuffer(store, np.int8), dtype=np.int64)
    fit = np.flatnonzero((counts <= budget) & _ends(raw))
    return int(fit[-1]) + 1 if len(fit) else 0


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The worker's counter, made once."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def prefix_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id",
                  text_col: str = "text", with_store: bool = False) -> DataFrame:
    """Tokens of every whole text: ``id_col``, n_bytes, n_tokens, limit_bytes and, if asked for, prefix_store.

    ``vocabulary`` is the .json file of a byte-level BPE tokenizer, readable on every machine.
    ``limit_bytes`` is the longest prefix (in bytes, whole code points) of at most ``limit`` tokens.
    ``prefix_store`` holds the count at every prefix (see ``tokens_at`` and ``bytes_within``).
    A null text is empty: no bytes, no tokens. Other columns aren't read. No shuffle; memory is
    bounded by an Arrow batch and the remembered pieces.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_tokens long, limit_bytes long" + ", prefix_store binary" * with_store

    def run(batches):
        own = counter(vocabulary)
        for b in batches:
            n_bytes, n_tokens, within, stores = [], [], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                n, cut = own.total_and_cut(text, limit)
                n_bytes.append(len(text.encode("utf-8")))
                n_tokens.append(n)
                within.append(cut)
                if with_store:
                    stores.append(zlib.compress(own.store(text), 1))
            cols = [b.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_tokens, within))]
            names = ["id", "n_bytes", "n_tokens", "limit_bytes"]
            if with_store:
                cols, names = [*cols, pa.array(stores, pa.binary())], [*names, "prefix_store"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def tokens_at(store: Column, n_bytes: Column) -> Column:
    """Tokens of the prefix of ``n_bytes`` bytes (a whole number of code points), from a prefix store."""
    @F.pandas_udf("long")
    def look(stores: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(zlib.decompress(s), np.int8)[:int(e)].sum(dtype=np.int64))
                          for s, e in zip(stores, ends)], dtype="int64")
    return look(store, n_bytes)


def bytes_within(store: Column, text: Column, budget: Column) -> Column:
    """Bytes of the longest prefix of at most ``budget`` tokens, from a prefix store."""
    @F.pandas_udf("long")
    def look(stores: pd.Series, texts: pd.Series, budgets: pd.Series) -> pd.Series:
        return pd.Series([longest_within(zlib.decompress(s), (t or "").encode("utf-8"), int(m))
                          for s, t, m in zip(stores, texts, budgets)], dtype="int64")
    return look(store, text, budget)
