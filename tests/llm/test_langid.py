import math
import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from servops.llm import langid
from servops.llm.textarrays import byte_view
from . import common

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    from servops.llm.queries import QUERIES
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op5_language_id"](spark, SF).join(docs, "doc_id").where("held_out").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.min("score").alias("l"), F.max("score").alias("h")).first()
    assert got["a"] >= 0.98 and 0 <= got["l"] and got["h"] <= 1


def test_labels_of_held_out_rows_do_not_matter(spark):
    from servops.llm.queries import QUERIES  # noqa: F401
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    wrong = docs.withColumn("lang", F.when(langid.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))

    def run(df):
        model = langid.learn(df.where(~langid.held_out("doc_id")), key=F.col("doc_id"))
        return sorted(tuple(r) for r in langid.predict(df.select("doc_id", "text"), model).select("doc_id", "lang_pred", "score").collect())
    assert run(docs) == run(wrong)


def brute_bits(model, text, k):
    """Code length of a text in language k by walking the context tree byte by byte."""
    counts = {}
    for g, w, n in zip(model.grams.tolist(), model.which.tolist(), model.counts.tolist()):
        c = [g >> s & 255 for s in (24, 16, 8, 0)]
        if w == k:
            for d in range(4):
                node = counts.setdefault(tuple(c[3 - d:3]), {})
                node[c[3]] = node.get(c[3], 0) + n

    def cost(context, s):
        if context is None:
            return 8
        shorter = context[1:] if context else None
        node = counts.get(context, {})
        n = sum(node.values())
        if n < (langid.SEEN if context else 1):
            return cost(shorter, s)
        if s in node:
            return -math.log2(node[s] / (n + len(node)))
        return -math.log2(len(node) / (n + len(node))) + cost(shorter, s)
    raw = [0, 0, 0] + list(text.encode())
    return sum(cost(tuple(raw[i - 3:i]), raw[i]) for i in range(3, len(raw)))


def test_code_lengths_against_the_tree(spark, monkeypatch):
    rows = [(i, t, lang, None, None) for i, (t, lang) in enumerate(
        [("the cat and the dog and the bird " * 4, "en"), ("der hund und die katze und der vogel " * 4, "de"), ("le chat et le chien " * 5, "fr")])]
    model = langid.learn(common.docs(spark, rows))
    assert model.languages == ["de", "en", "fr"]
    texts = ["the dog", "und der hund zzz", "", "é漢 the", "le chien et the katze " * 3]
    whole = langid.CodeLengths(model).of(*byte_view(pa.array(texts)))
    for i, t in enumerate(texts):
        for k in range(3):
            assert abs(whole[i, k] - brute_bits(model, t, k)) < 1e-9 * max(1, whole[i, k])
    monkeypatch.setattr(langid, "_PIECE", 5)  # long texts in pieces
    assert np.allclose(langid.CodeLengths(model).of(*byte_view(pa.array(texts))), whole)


def test_edges(spark):
    df = common.docs(spark)
    model = langid.learn(df)
    got = langid.predict(df, model)
    assert [c for c in got.columns if c not in ("lang_pred", "score")] == [c for c in df.columns if c not in ("lang_pred", "score")]
    rows = got.select("doc_id", "text", "lang_pred", "score").collect()
    assert len(rows) == len(common.ROWS)
    for r in rows:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in model.languages and 0 <= r["score"] <= 1
    assert langid.predict(common.empty(spark), model).count() == 0
    nothing = langid.learn(common.empty(spark))
    assert {r["lang_pred"] for r in langid.predict(df, nothing).collect()} == {"und"}


def test_no_context_is_dropped_for_many_languages(spark):
    """A small language keeps all its contexts beside large ones, and rare bytes stay apart."""
    import random
    random.seed(3)
    large = ["".join(random.choices([chr(c) for c in range(0x4E00, 0x5E00)], k=20000)) for _ in range(4)]
    rows = [(i, t, f"l{i}", None, None) for i, t in enumerate(large)] + [(9, "ŵy ŷn ŵyn " * 3, "cy", None, None)]
    model = langid.learn(common.docs(spark, rows))
    levels = langid.CodeLengths(model).levels
    assert len(levels) == 5 and all(len(levels[k][2].contexts) > 3000 for k in range(1, 5))
    small = "\0\0\0".encode() + ("ŵy ŷn ŵyn " * 3).encode()
    seen = {}
    for i in range(3, len(small)):
        seen[small[i - 3:i]] = seen.get(small[i - 3:i], 0) + 1
    assert len(levels[0][3].contexts) == sum(n >= langid.SEEN for n in seen.values()) > 0
    got = langid.predict(common.docs(spark, [(1, "ŵyn", None, None, None)]), model).first()
    assert got["lang_pred"] == "cy"


def test_workers_without_the_package(tmp_path):
    """The model reaches workers that can't import the package."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""import sys; sys.path.insert(0, {repo!r})
from servops.session import build_session
from servops.llm import langid
spark = build_session("local[2]", 2)
docs = spark.createDataFrame([(i, t, l) for i in range(30) for t, l in [("the cat and the dog " * 9, "en"), ("der hund und die katze " * 9, "de")]],
                             "doc_id long, text string, lang string")
model = langid.learn(docs)
limits = langid.calibrate(docs, model)
print(langid.predict(docs, model).where("lang = lang_pred").count(), langid.clear_texts(docs, model, limits).count())"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert done.stdout.split() == ["60", "60"], done.stderr[-2000:]
