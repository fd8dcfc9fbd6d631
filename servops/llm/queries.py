"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import (centroids, decontam, digest, extract, langid, licenses, line_dedup, mixing, near_dedup, sharding, spelling, tokencount,
               vector_dedup)

#: file of the tokenizer whose tokens are counted
VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024
SHARDS = 24
#: per cent of a long line that may be edited; code points from which on a short line may have one edit
LINE_GROW, LINE_SHORT = 4, 20
#: tree of the mix: the sources' numbers in four domains, then language, then source; and its weights
MIX_WEIGHTS = {("domain0",): 4, ("domain1",): 3, ("domain2",): 2, ("domain3",): 1,
               (None, "en"): 4, (None, "de"): 2, (None, "fr"): 2, (None, "es"): 1}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 2, 11


def mix_levels() -> dict[str, Column]:
    number = F.regexp_extract("source", r"(\d+)", 1).try_cast("int")
    return {"domain": F.concat(F.lit("domain"), (number % 4).cast("string")), "lang": F.col("lang"), "source": F.col("source")}


def op1_shards(spark: SparkSession, d: str) -> DataFrame:
    placed = sharding.assign_shards(read_table(spark, d, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op2_token_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = tokencount.prefix_counts(read_table(spark, d, "documents"), public_tokenizers.path(VOCABULARY), TOKEN_LIMIT)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "limit_bytes")


def op3_main_text(spark: SparkSession, d: str) -> DataFrame:
    found = extract.extract_main_text(read_table(spark, d, "pages"))
    return found.select("page_id", "url", "text", "n_chars", "n_blocks")


def op4_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = near_dedup.near_duplicates(read_table(spark, d, "documents"), width=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op5_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    model = langid.learn(docs.where(~langid.held_out("doc_id") & F.col("doc_id").isNotNull()), key=F.col("doc_id"))
    rows = docs.select("doc_id", "text", langid.held_out("doc_id").alias("held_out"))
    return langid.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op6_source_mix(spark: SparkSession, d: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, d, "documents"), mix_levels(), MIX_SHARE, MIX_EPOCHS, MIX_WEIGHTS, MIX_SEED)
    return mixed.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_tokens").alias("tokens"),
                        F.col("mix_copies").alias("copies"))


def op7_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    left = line_dedup.dedup_lines(read_table(spark, d, "documents"), grow=LINE_GROW, short=LINE_SHORT)
    return left.select("doc_id", "n_lines", "n_dropped", F.char_length("text").cast("long").alias("n_chars"),
                       F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op8_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = decontam.find_items(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "item_windows", "coverage", "verbatim")


def op9_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, d, "documents"))


def op10_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return digest.compare_with_next(read_table(spark, d, "documents"))


def op11_centroid_clusters(spark: SparkSession, d: str) -> DataFrame:
    return centroids.cluster_vectors(read_table(spark, d, "embeddings"))


def op12_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, d, "documents"))


def op13_embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    return vector_dedup.near_vectors(read_table(spark, d, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: fn for name, fn in sorted(globals().items(), key=lambda x: (len(x[0].split("_")[0]), x[0]))
    if name.startswith("op") and name[2].isdigit()
}
