import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from . import common
from .test_near_dedup import brute

SF = "/root/testdata/sf0.01"


def test_stages_over_the_data(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name != "shards":
            assert out.columns == docs.columns
            texts = {r["doc_id"]: r["text"] for r in rows}
            assert len(texts) == len(rows)
            if name == "near_dedup":
                want = brute([(r["doc_id"], r["text"]) for r in before], 5, 80)
                assert set(texts) == {d for d, _, c in want if d == c}
            if name == "decontamination":
                items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
                hit = {r["doc_id"] for r in before if any(i in r["text"] for i in items)}
                assert hit and not hit & set(texts) and len(before) - len(rows) <= len(hit) + 2
            if name == "source_mix":
                size = sum(-(-len(r["text"].encode()) // 4) for r in before)
                assert 0.7 * size < sum(-(-len(r["text"].encode()) // 4) for r in rows) <= corpus_pipeline.MIX_SHARE * size
            docs = spark.createDataFrame(rows, docs.schema)
        else:
            assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in before)
        before = rows


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_edges(spark, name, stage):
    df = common.docs(spark)
    out = stage(spark, df, SF)
    if name != "shards":
        assert out.columns == df.columns
    rows = out.collect()
    if name == "language_id":
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(["1", "2", "None", "7", "8", "9", "9", "10"])
    elif name == "near_dedup":
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(["1", "3", "4", "5", "6", "7", "8", "9", "10", "None"])
    elif name == "decontamination":
        assert len(rows) == len(common.ROWS)
    elif name == "shards":
        assert len(rows) == len(common.ROWS)
    assert stage(spark, common.empty(spark), SF).count() == 0


def test_run_equals_the_stages(spark):
    from __spark_entry__ import queries
    got = queries()["pipeline"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect())) and F


def test_language_stage_rejects_on_the_models_evidence(spark):
    import random
    random.seed(4)
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    en, de = ([r["text"][:700] for r in rows if r["lang"] == k and len(r["text"]) > 1000][:10] for k in ("en", "de"))
    bad = ["".join(random.choices("abcdefghijklmnopqrstuvwxyz ", k=600)) for _ in range(10)]
    bad += ["Zażółć gęślą jaźń, a potem wszyscy poszli do domu na obiad." * 4, "сегодня хорошая погода, мы идём гулять. " * 5]
    bad += [a + " " + b for a, b in zip(en, de)]
    odd = [(10**6 + i, t, None, "x", len(t)) for i, t in enumerate(bad)]
    docs = spark.createDataFrame([tuple(r) for r in rows] + odd, spark.read.parquet(f"{SF}/documents.parquet").schema)
    left = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF).collect()}
    assert not left & {r[0] for r in odd[:12]} and len(left & {r[0] for r in odd[12:]}) <= 2
    assert len(left & {r["doc_id"] for r in rows}) >= len(rows) - 2


def test_language_stage_learns_from_every_labelled_row(spark, monkeypatch):
    """More rows than any sample takes, ids of every kind, a text with its own words far from its begin."""
    import random

    import numpy as np
    import pyarrow as pa

    from servops.llm import langid
    from servops.llm.textarrays import byte_view
    random.seed(6)
    words = {"en": "the cat and dog saw a bird on that old green house".split(), "de": "der hund und die katze sind nicht im haus aber garten".split()}
    rows = [(None if i % 50 == 7 else i, " ".join(random.choices(words[k], k=20)) + f" x{i}!", k, "s", i) for i in range(2600) for k in words]
    rows += [(9000, "the cat and dog " * 8000 + "zyxw vuts", "en", "s", 1), (9001, None, "en", "s", 1), (9002, "12 3", "fr", "s", 1),
             (9003, "unlabelled words", None, "s", 1)]
    docs, seen = common.docs(spark, rows, clash=False), []
    monkeypatch.setattr(langid, "clear_texts", lambda df, model, limits, *a: seen.append((model, limits)) or df)
    assert corpus_pipeline.language_id(spark, docs, SF).count() == len(rows)
    model, limits = seen[0]
    plain = docs.where("lang is not null and text is not null").select(
        "lang", langid.letters(F.col("text")).alias("t"), langid.part_of(F.col("text")).alias("part")).collect()
    for k in ("en", "de"):
        of = model.which == model.languages.index(k)
        assert model.counts[of].sum() == sum(len(r["t"].encode()) for r in plain if r["lang"] == k)
    assert {int.from_bytes(b"vuts", "big"), int.from_bytes(b"zyxw", "big")} <= set(model.grams.tolist())
    rates = {"en": [], "de": []}
    for part in range(langid.PARTS):
        own, other = ([r for r in plain if (r["part"] == part) == x] for x in (True, False))
        taught = langid.learn(common.docs(spark, [(1, r["t"], r["lang"], None, None) for r in other], clash=False), texts_a_language=None)
        own = [r for r in own if r["lang"] in rates and len(r["t"].encode()) >= langid.EVIDENCE]
        bits = langid.CodeLengths(taught).of(*byte_view(pa.array([r["t"] for r in own])))
        for r, b in zip(own, bits):
            rates[r["lang"]].append(b[taught.languages.index(r["lang"])] / len(r["t"].encode()))
    assert set(limits) == set(rates) and all(abs(limits[k][0] - np.median(v)) < 2e-3 for k, v in rates.items())


def test_language_stage_keeps_what_it_cannot_judge(spark):
    rows = [(i, f"words without any label {i}", None, None, None) for i in range(5)]
    assert corpus_pipeline.language_id(spark, common.docs(spark, rows), SF).count() == 5


def test_columns_of_any_name_come_back_as_they_were(spark):
    names = ["_key_id", "_key_text", "_mark_id", "_mark_text", "key_id", "mark_text", "row", "mix_notes", "mix_tokens", "mix_copies",
             "MIX_lang", "text_hash", "kept", "clear", "a.b"]
    df = spark.createDataFrame([r + tuple(f"{c}{i}" for c in names) for i, r in enumerate(common.ROWS)],
                               common.SCHEMA + ", " + ", ".join(f"`{c}` string" for c in names))
    whole = {tuple(r) for r in df.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        rows = out.collect()
        assert out.columns == df.columns and rows and {tuple(r) for r in rows} <= whole, name
    assert corpus_pipeline.shards(spark, df, SF).count() == len(common.ROWS)
