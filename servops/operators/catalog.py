"""Model-configuration catalog: lookups, defaults, grouping, resolve-or-derive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ids import assign_dense_ids

CONFIG_COLUMNS = ["id", "model_name", "model_path", "tensor_parallel_size", "max_model_len",
                  "gpu_memory_utilization", "enforce_eager", "chat_template",
                  "speculative_decoding", "max_batch_size"]


def _first_by_min_id(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the configuration with the lowest id.

    ``min_by`` is a partial aggregate, so a name with a third of all rows
    still ships one row per map task.
    """
    cols = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
              .agg(F.min_by(F.struct(*cols), F.col("id")).alias("_row"))
              .select(*keys, "_row.*"))


def default_config(models: DataFrame) -> DataFrame:
    """Default configuration of each model name = lowest id."""
    return _first_by_min_id(models, ["model_name"]).select(*models.columns)


def model_by_id(models: DataFrame, lookups: DataFrame) -> DataFrame:
    """Batch form of get-by-id: every lookup row, with the model or nulls."""
    m = models.select(F.col("id").alias("model_id"), "model_name", "model_path", "max_model_len")
    return lookups.join(m, "model_id", "left").select(
        "request_id", "model_id", F.col("model_name").isNotNull().alias("found"),
        "model_name", "model_path", "max_model_len")


def model_configs(models: DataFrame, names: DataFrame) -> DataFrame:
    """All configurations of the requested names, ordered by name and length."""
    wanted = names.select("model_name").distinct()  # a few names, however many requests
    return models.join(wanted, "model_name", "left_semi") \
        .orderBy("model_name", "max_model_len", "id").select(*models.columns)


def model_by_path(models: DataFrame, lookups: DataFrame) -> DataFrame:
    """Model name from a served path (lowest id if a path is registered twice)."""
    by_path = (models.groupBy("model_path")
                     .agg(F.min_by(F.struct("id", "model_name"), F.col("id")).alias("_m"))
                     .select("model_path", F.col("_m.id").alias("model_id"),
                             F.col("_m.model_name").alias("model_name")))
    return lookups.join(by_path, "model_path", "left").select("lookup_id", "model_path", "model_id", "model_name")


def start_config(models: DataFrame, requests: DataFrame) -> DataFrame:
    """Name match plus an optional length (applied only when truthy); lowest id.

    Split into two equi-joins against pre-aggregated, unique-key sides instead
    of one join that pairs every request with every configuration of a name.
    """
    has_len = F.coalesce(F.col("max_model_len"), F.lit(0)) != 0
    r = requests.select("request_id", "model_name", F.col("max_model_len").alias("requested_len"),
                        has_len.alias("_has_len"))
    by_name = models.groupBy("model_name").agg(F.min("id").alias("_id_name"))
    by_len = models.groupBy("model_name", F.col("max_model_len").alias("requested_len")) \
        .agg(F.min("id").alias("_id_len"))
    j = r.join(by_name, "model_name", "left").join(by_len, ["model_name", "requested_len"], "left")
    cfg = F.when(F.col("_has_len"), F.col("_id_len")).otherwise(F.col("_id_name"))
    return j.select("request_id", "model_name", "requested_len", cfg.alias("config_id"),
                    cfg.isNotNull().alias("found"))


def model_listing(models_with_stats: DataFrame) -> DataFrame:
    return models_with_stats.orderBy("model_name", "max_model_len", "id")


def model_group_summary(models: DataFrame) -> DataFrame:
    """Per model name: configurations, sorted distinct lengths, any speculative, base config.

    The UI groups rows arriving in (name, length) order and takes the first as
    base, i.e. the shortest length (ties: lowest id).
    """
    base = F.min_by(F.struct("id", "model_path", "max_model_len", "tensor_parallel_size", "chat_template"),
                    F.struct("max_model_len", "id"))
    lengths = F.sort_array(F.collect_set("max_model_len"))
    g = models.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("n_configs"),
        lengths.alias("_lengths"),
        F.bool_or("speculative_decoding").alias("any_speculative"),
        base.alias("_base"))
    return g.select(
        "model_name", "n_configs", F.size("_lengths").alias("n_lengths"),
        F.array_join(F.col("_lengths").cast("array<string>"), ",").alias("lengths"),
        "any_speculative",
        F.col("_base.id").alias("base_id"), F.col("_base.model_path").alias("base_model_path"),
        F.col("_base.max_model_len").alias("base_max_model_len"),
        F.col("_base.tensor_parallel_size").alias("base_tensor_parallel_size"),
        F.col("_base.chat_template").alias("base_chat_template"),
    ).orderBy("model_name")


def resolve_configs(models: DataFrame, requests: DataFrame):
    """Resolve-or-derive a configuration for every start request (set form).

    * no custom option given: default configuration (lowest id), else error;
    * custom options: exact (name, length, speculative) match; a missing
      length never matches (``= NULL``);
    * otherwise a configuration is derived from the name's base row (lowest
      id) with the requested length (or the base length) and speculative flag.
      Requests with a length share one derived row per (name, length,
      speculative): the first derives it and the later ones match it.
      Requests without a length derive one row each. No base row: error.

    Returns ``(resolution, new_models)``; new ids continue after the largest id.
    """
    has_len = F.coalesce(F.col("max_model_len"), F.lit(0)) != 0
    spec = F.coalesce(F.col("speculative_decoding"), F.lit(False))
    r = requests.select("request_id", "model_name", F.col("max_model_len").alias("requested_len"),
                        spec.alias("requested_speculative"), has_len.alias("_has_len"),
                        (has_len | spec).alias("_custom"))
    base = _first_by_min_id(models, ["model_name"]).select(
        "model_name", F.col("id").alias("_base_id"), F.col("max_model_len").alias("_base_len"))
    exact = models.groupBy("model_name", F.col("max_model_len").alias("requested_len"),
                           F.col("speculative_decoding").alias("requested_speculative")) \
        .agg(F.min("id").alias("_match_id"))
    j = (r.join(base, "model_name", "left")
          .join(exact, ["model_name", "requested_len", "requested_speculative"], "left"))
    j = j.withColumn("_match_id", F.when(F.col("_custom") & F.col("_has_len"), F.col("_match_id")))
    # one row per request, read by the derivation, its id assignment and the result
    j = cut_lineage(j)

    needs = j.where(F.col("_custom") & F.col("_match_id").isNull() & F.col("_base_id").isNotNull())
    derived_len = F.when(F.col("_has_len"), F.col("requested_len")).otherwise(F.col("_base_len"))
    # one derived row per (name, length, speculative) when a length was given
    keyed = needs.withColumn("_grp_len", F.when(F.col("_has_len"), F.col("requested_len"))) \
        .withColumn("_grp_req", F.when(~F.col("_has_len"), F.col("request_id")))
    groups = keyed.groupBy("model_name", "_grp_len", "requested_speculative", "_grp_req").agg(
        F.min("request_id").alias("first_request_id"),
        F.first("_base_id").alias("_base_id"),
        F.max(derived_len).alias("_new_len"))
    max_id = models.agg(F.max("id")).first()[0] or 0
    groups = assign_dense_ids(groups, ["first_request_id"], "new_id", start=int(max_id))
    # join on null-safe equality of the grouping key
    g = groups.select(F.col("model_name").alias("_g_name"), F.col("_grp_len").alias("_g_len"),
                      F.col("requested_speculative").alias("_g_spec"), F.col("_grp_req").alias("_g_req"),
                      "first_request_id", "new_id", "_new_len")
    cond = ((keyed["model_name"] == g["_g_name"]) & keyed["_grp_len"].eqNullSafe(g["_g_len"]) &
            (keyed["requested_speculative"] == g["_g_spec"]) & keyed["_grp_req"].eqNullSafe(g["_g_req"]))
    req_to_new = keyed.join(g, cond, "inner").select("request_id", "first_request_id", "new_id", "_new_len")

    res = j.join(req_to_new, "request_id", "left")
    status = (F.when(~F.col("_custom") & F.col("_base_id").isNotNull(), F.lit("default"))
              .when(F.col("_match_id").isNotNull(), F.lit("match"))
              .when(F.col("new_id").isNotNull() & (F.col("first_request_id") == F.col("request_id")),
                    F.lit("derived"))
              .when(F.col("new_id").isNotNull(), F.lit("match"))
              .otherwise(F.lit("error")))
    config_id = F.coalesce(F.when(~F.col("_custom"), F.col("_base_id")), F.col("_match_id"),
                           F.col("new_id").cast("int"))
    resolution = res.select(
        "request_id", "model_name", "requested_len", "requested_speculative",
        status.alias("status"), config_id.cast("int").alias("config_id"))

    base_rows = models.select(F.col("id").alias("_base_id"), "model_path", "tensor_parallel_size",
                              "gpu_memory_utilization", "enforce_eager", "chat_template")
    new_models = groups.join(base_rows, "_base_id", "inner").select(
        F.col("new_id").cast("int").alias("id"), "model_name", "model_path", "tensor_parallel_size",
        F.col("_new_len").cast("int").alias("max_model_len"), "gpu_memory_utilization", "enforce_eager",
        "chat_template", F.col("requested_speculative").alias("speculative_decoding"),
        F.lit(None).cast("int").alias("max_batch_size"))
    return resolution, new_models


def register_models(new_models: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Rows as an append to the models table: statistics start at zero."""
    created = created_at if created_at is not None else F.localtimestamp()
    return new_models.select(
        *CONFIG_COLUMNS,
        F.lit(0).cast("long").alias("generations_count"),
        F.lit(0).cast("long").alias("tokens_generated_count"),
        F.lit(0.0).alias("avg_tokens_per_second"),
        created.cast("timestamp_ntz").alias("created_at"))
