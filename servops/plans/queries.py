"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables through ``sources.fixtures`` and runs
over them whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import errors as E
from ..operators import gpu as G
from ..operators import inference as I
from ..operators import logs as L
from ..operators import usage as U
from ..sources import api_log, fixtures as fx
from ..session import cut_lineage
from ..sources.sinks import to_json_lines

# Fixed registration time of derived configurations (the reference uses now()).
REGISTERED_AT = "2024-02-01 00:00:00"
# Fixed generation time of the round-trip rows.
GENERATED_AT = "2024-02-01 00:00:00"


def q_usage_rollup(spark, d):
    return U.usage_rollup(fx.generations(spark, d))


def q_model_stats(spark, d):
    return U.model_stats(fx.models(spark, d), fx.generations(spark, d))


def q_latest_model(spark, d):
    return U.latest_model(fx.generations(spark, d), fx.models(spark, d), fx.GENERATION_ORDER)


def q_model_by_id(spark, d):
    return C.model_by_id(fx.models(spark, d), fx.model_id_lookups(spark, d))


def q_model_configs(spark, d):
    return C.model_configs(fx.models(spark, d), fx.start_requests(spark, d))


def q_model_by_path(spark, d):
    return C.model_by_path(fx.models(spark, d), fx.model_path_lookups(spark, d))


def q_start_config(spark, d):
    return C.start_config(fx.models(spark, d), fx.start_requests(spark, d))


def q_default_config(spark, d):
    return C.default_config(fx.models(spark, d))


def q_model_listing(spark, d):
    return C.model_listing(U.model_stats(fx.models(spark, d), fx.generations(spark, d)))


def q_model_group_summary(spark, d):
    return C.model_group_summary(fx.models(spark, d))


def q_config_resolve(spark, d):
    res, _ = C.resolve_configs(fx.models(spark, d), fx.start_requests(spark, d))
    return res


def q_model_register(spark, d):
    _, new = C.resolve_configs(fx.models(spark, d), fx.start_requests(spark, d))
    return C.register_models(new, F.lit(REGISTERED_AT).cast("timestamp_ntz"))


def q_models_json(spark, d):
    return to_json_lines(C.model_listing(U.model_stats(fx.models(spark, d), fx.generations(spark, d))))


def q_log_line_classes(spark, d):
    return L.classify_lines(fx.log_lines(spark, d))


def q_progress_collapse(spark, d):
    return L.progress_collapse(fx.log_lines(spark, d))


def q_server_state_timeline(spark, d):
    return L.server_state_timeline(fx.log_lines(spark, d))


def q_live_state_timeline(spark, d):
    return L.live_state_timeline(fx.channel_messages(spark, d))


def q_max_batch_backfill(spark, d):
    return L.max_batch_backfill(fx.log_lines(spark, d), fx.run_models(spark, d), fx.models(spark, d))


def q_run_health(spark, d):
    return L.run_health(fx.log_lines(spark, d))


def q_run_duration(spark, d):
    return L.run_duration(fx.log_times(spark, d))


def q_log_tail(spark, d):
    return L.log_tail(fx.log_lines(spark, d), 100)


def q_log_unescape(spark, d):
    return L.log_unescape(fx.log_lines(spark, d))


def q_message_routes(spark, d):
    return L.message_routes(fx.messages(spark, d))


def q_crash_buffer(spark, d):
    return E.crash_buffers(fx.log_lines(spark, d))


def q_known_error_match(spark, d):
    return E.match_known_errors(fx.log_lines(spark, d), fx.error_catalog(spark))


def _error_job(spark, d):
    return E.ErrorJob(fx.log_lines(spark, d), fx.error_catalog(spark))


def q_new_error_mining(spark, d):
    return _error_job(spark, d).mined


def q_error_occurrences(spark, d):
    return _error_job(spark, d).occurrences()


def q_error_ranking(spark, d):
    return E.error_ranking(_error_job(spark, d).occurrences())


def q_gpu_samples(spark, d):
    return G.parse_gpu_samples(fx.gpu_csv_lines(spark, d))


def q_gpu_metrics(spark, d):
    return G.gpu_metrics(q_gpu_samples(spark, d))


def q_gpu_processes(spark, d):
    return G.gpu_process_view(G.parse_gpu_processes(fx.gpu_process_csv_lines(spark, d)))


def q_gpu_latest(spark, d):
    return G.latest_per_gpu(q_gpu_samples(spark, d))


def q_api_log_summary(spark, d):
    return api_log.summarize(api_log.parse_lines(fx.api_log_lines(spark, d)))


def _plan(spark, d):
    return I.request_plan(fx.prompts(spark, d), fx.models(spark, d))


def _inference_inputs(spark, d):
    """Prompts, request plan and prompt batches for the inference jobs.

    Plan (one row per request) and batches (one narrow row per prompt) feed
    several branches each; they are materialised once so the prompt and
    model tables are not re-read and re-joined for every branch.
    """
    prompts = fx.prompts(spark, d)
    plan = cut_lineage(I.request_plan(prompts, fx.models(spark, d)))
    batches = cut_lineage(I.prompt_batches(prompts, plan))
    return prompts, plan, batches


def q_request_plan(spark, d):
    return _plan(spark, d)


def q_prompt_batches(spark, d):
    prompts = fx.prompts(spark, d)
    return I.prompt_batches(prompts, cut_lineage(I.request_plan(prompts, fx.models(spark, d))))


def _calls(spark, d):
    prompts, plan, batches = _inference_inputs(spark, d)
    return prompts, plan, batches, I.request_calls(prompts, plan, batches)


def q_request_payloads(spark, d):
    return I.request_payloads(_calls(spark, d)[3])


def q_response_parse(spark, d):
    return I.parse_chat(fx.chat_responses(spark, d), ["request_id", "prompt_no"])


def _completion_parsed(spark, d):
    _, plan, batches = _inference_inputs(spark, d)
    resp = fx.completion_responses(spark, d, batches, plan)
    return plan, batches, I.parse_completions(resp, ["request_id", "batch_no"])


def q_response_align(spark, d):
    _, batches, parsed = _completion_parsed(spark, d)
    return I.align_completions(parsed, batches)


def q_batch_mismatch(spark, d):
    plan, batches, parsed = _completion_parsed(spark, d)
    comp_req = plan.where((F.col("status") == "ok") & (F.col("mode") == "completion"))
    comp = batches.join(comp_req.select("request_id"), "request_id", "left_semi")
    return I.batch_mismatch(comp, parsed)


def q_batch_generate(spark, d):
    calls = _calls(spark, d)[3]
    return I.answers(I.generate(calls, I.echo_model, timer=I.fixed_time))


def q_inference_round_trip(spark, d):
    prompts, plan, batches, calls = _calls(spark, d)
    responses = I.generate(calls, I.echo_model, timer=I.fixed_time)
    gens = I.generation_rows(prompts, plan, batches, responses, F.lit(GENERATED_AT))
    return U.usage_rollup(gens)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
