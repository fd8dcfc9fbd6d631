import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from servops.llm import tokencount
from . import common

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
PIECES = ["<|endoftext|>", "'re", "'ll", "'", "  ", "   ", "\n\n", " the", "hello", "Ünü", "12", "!!", " ", "\t", "\x1c", "\x85",
          "　", "漢字", "é", "<|endo", "🎉", "x", " Sentence.", "\n"]


def lib(text):
    return len(LIB.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def own():
    return tokencount.PrefixCounter(PATH)


def test_counts_of_every_prefix_equal_the_library(own):
    random.seed(5)
    for _ in range(700):
        text = "".join(random.choice(PIECES) for _ in range(random.randint(0, 14)))
        counts = np.cumsum(np.frombuffer(own.store(text), np.int8).astype(int))
        for k in range(1, len(text) + 1):
            assert counts[len(text[:k].encode()) - 1] == lib(text[:k]), (text, k)
        for limit in (0, 1, 3, 8):
            best = max([0] + [len(text[:k].encode()) for k in range(1, len(text) + 1) if lib(text[:k]) <= limit])
            assert own.total_and_cut(text, limit) == (lib(text), best), (text, limit)


def test_random_code_points(own):
    random.seed(6)
    for _ in range(600):
        text = "".join(chr(random.choice([random.randint(0, 0x2FF), random.randint(0x300, 0xD7FF), random.randint(0xE000, 0x1FFFF)]))
                       for _ in range(10))
        assert own.total(text) == lib(text), [hex(ord(c)) for c in text]


def test_long_piece_without_spaces(own):
    text = "ab" * 5000 + "漢" * 300
    assert own.total(text) == lib(text)


def test_operator(spark):
    got = tokencount.prefix_counts(common.docs(spark), PATH, limit=20, with_store=True)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "limit_bytes", "prefix_store"]
    want = common.by([{"d": r[0], "n": lib(r[1] or ""), "b": len((r[1] or "").encode())} for r in common.ROWS], ["d", "n"])
    rows = common.by([{"d": r[0], "n": r[2], "b": r[1]} for r in got.collect()], ["d", "n"])
    assert rows == want
    text = common.LONG
    one = got.where("doc_id = 7").select(
        "limit_bytes", tokencount.tokens_at(F.col("prefix_store"), F.lit(1000)).alias("t"),
        tokencount.bytes_within(F.col("prefix_store"), F.lit(text), F.lit(20)).alias("b")).first()
    assert one["t"] == lib(text[:1000]) and one["b"] == one["limit_bytes"]
    assert lib(text[:one["b"]]) <= 20 < lib(text[:one["b"] + 1])
    assert tokencount.prefix_counts(common.empty(spark), PATH).count() == 0
