"""Corpus pipeline: five stages, each one of the training-data operators, over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from servops.llm import decontam, langid, mixing, near_dedup, queries, sharding
from servops.session import checkpoint_dir
from servops.sources.tables import read_table

#: part of the tokens that the mix keeps; no document is repeated
MIX_SHARE, MIX_EPOCHS = 0.8, 1


def _marked(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """``docs`` whose (id, hash of the text) is in ``marks`` (how: left_semi) or isn't (left_anti).

    A row travels as one struct, so its columns may have any names. A null id equals a null id; a null text has
    a hash as any other text.
    """
    keys = marks.select(F.col("doc_id").alias("mark_id"), F.col("text_hash").alias("mark_text"))
    own = docs.select(F.struct(*_columns(docs)).alias("row"), F.col("doc_id").alias("key_id"), F.xxhash64("text").alias("key_text"))
    same = F.col("key_id").eqNullSafe(F.col("mark_id")) & (F.col("key_text") == F.col("mark_text"))
    return own.join(keys, same, how).select("row.*")


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, gibberish, mixed ones and those in no language of the labels go; ``lang`` is left as it is.

    A null or empty text has no letter. Every labelled row teaches, and sets the limits, with its whole text. Without labelled
    rows, or in a language with too few of them to tell, all texts with a letter stay. Rows with the same text and
    label have the same fate; an empty table stays empty.
    """
    return langid.clear_texts(docs, *langid.learn_with_limits(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the least id (a null id is the least; ties: hash of the text).

    Rows repeated with id and text stay once, whichever of them. Null texts and texts without words are in no class: each
    stays. An empty table stays empty.
    """
    found = near_dedup.near_duplicates(docs, width=5, percent=80)
    kept = _marked(docs, found.where("kept").select("doc_id", "text_hash").distinct(), "left_semi")
    repeated = found.where("kept").groupBy("doc_id", "text_hash").count().where(F.col("count") > 1)
    # only rows that occur several times are grouped
    single = _marked(kept, repeated, "left_anti")
    several = _marked(kept, repeated, "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(several)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none, nor does any text with an empty benchmark. Repeated rows have the same fate; an empty
    table stays empty.
    """
    found = decontam.find_items(docs, read_table(spark, sf_dir, "benchmark"))
    return _marked(docs, found.select("doc_id", "text_hash").distinct(), "left_anti")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fall into the mix by the weights of the domain-language-source tree.

    A null language, or a null or unnumbered source, is a node of its own. Null and empty texts have no tokens: they go with
    their leaf's order. Rows with the same id and leaf are taken together. All columns come back as they were, those
    named like the operator's too; an empty table stays empty.
    """
    rows = docs.select(F.struct(*_columns(docs)).alias("row"), "doc_id", "text", "lang", "source")
    mixed = mixing.mix(rows, queries.mix_levels(), MIX_SHARE, MIX_EPOCHS, queries.MIX_WEIGHTS, queries.MIX_SEED)
    return mixed.where(F.col("mix_copies") > 0).select("row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document that is left; equal texts and null texts are rows like others."""
    return sharding.assign_shards(docs, queries.SHARDS)


STAGES = [("language_id", language_id), ("near_dedup", near_duplicates), ("decontamination", decontamination),
          ("source_mix", source_mix), ("shards", shards)]

#: language models and near-duplicate classes can't be told in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared checkpoint folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{name}-{uuid.uuid4().hex}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
