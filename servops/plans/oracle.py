"""DuckDB SQL equal to each registered query (tables are pre-registered views).

The test-table adapters of ``sources/fixtures.py`` are repeated here as CTEs,
then each query states the operator's semantics directly in SQL (windows and
correlated forms are fine here: the oracle only has to be obviously right).
"""

from __future__ import annotations

from ..functions.logs import (CONCURRENCY_RE, CRASH_SENTINEL, EXIT_MARKER, HEALTH_ERROR_INDICATORS,
                              HEALTH_WAITING_MARKER, NEW_ERROR_FALLBACK, NEW_ERROR_PATTERNS,
                              NEW_ERROR_SOLUTION, RUNNING_MARKERS, SERVER_PROGRESS_BLOCKS, SERVER_PROGRESS_MARK,
                              STOPPED_MARKERS, UI_PROGRESS_BLOCKS)
from ..functions.text import PY_NON_WHITESPACE_RUN, PY_STRIP_PATTERN, PY_WHITESPACE_CLASS, RE_ESCAPE_CLASS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {_q(PY_STRIP_PATTERN)}, '', 'g')"


def wc(x: str) -> str:
    return f"len(regexp_extract_all({x}, {_q(PY_NON_WHITESPACE_RUN)}))"


def blank(x: str) -> str:
    return f"regexp_matches({x}, {_q('^' + PY_WHITESPACE_CLASS + '*$')})"


K = "cast(json_extract_string(props, '$.k') as int)"

CTE = {
    "models_fx": """select cast(p_partkey as int) as id, p_brand as model_name,
      concat('/models/', replace(p_name, ' ', '-'), '-', cast(p_partkey as varchar)) as model_path,
      cast(1 + p_partkey % 4 as int) as tensor_parallel_size,
      cast(2048 * (1 + p_size % 8) as int) as max_model_len,
      case when p_partkey % 5 = 0 then null else cast(0.9 as double) end as gpu_memory_utilization,
      (p_size % 2 = 0) as enforce_eager,
      case when p_partkey % 3 = 0 then null when p_partkey % 7 = 0 then '' else 'chatml' end as chat_template,
      (p_type = 'ECONOMY') as speculative_decoding,
      case when p_partkey % 3 = 1 then null else cast(p_size as int) end as max_batch_size
    from part""",
    "gens_fx": """select cast(l_partkey as int) as model_id, cast(l_quantity as int) as tokens_generated,
      l_discount as time_taken,
      case when l_orderkey % 500 = 0 then null else l_shipdate end as generated_at,
      l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax
    from lineitem""",
    "usage_fx": """select model_id, count(*) as generations_count,
      cast(coalesce(sum(tokens_generated), 0) as bigint) as tokens_generated_count,
      coalesce(cast(sum(tokens_generated) as double)
               / nullif(cast(sum(cast(time_taken as decimal(38,9))) as double), 0), 0.0) as avg_tokens_per_second
    from gens_fx group by model_id""",
    "stats_fx": """select m.*, cast(coalesce(u.generations_count, 0) as bigint) as generations_count,
      cast(coalesce(u.tokens_generated_count, 0) as bigint) as tokens_generated_count,
      coalesce(u.avg_tokens_per_second, 0.0) as avg_tokens_per_second
    from models_fx m left join usage_fx u on u.model_id = m.id""",
    "sr_fx": """select event_id as request_id, concat('Brand#', cast(user_id % 30 as int)) as model_name,
      case when event_id % 4 = 0 then null else cast(2048 * (1 + event_id % 10) as int) end as max_model_len,
      (event_id % 3 = 0) as speculative_decoding
    from events""",
    "default_fx": """select * exclude (rn) from (
      select *, row_number() over (partition by model_name order by id) as rn from models_fx) where rn = 1""",
    # config resolution (set form)
    "r_fx": """select request_id, model_name, max_model_len as requested_len,
      speculative_decoding as requested_speculative,
      coalesce(max_model_len, 0) <> 0 as has_len,
      (coalesce(max_model_len, 0) <> 0 or speculative_decoding) as custom
    from sr_fx""",
    "base_fx": """select model_name, min(id) as base_id, arg_min(max_model_len, id) as base_len
    from models_fx group by model_name""",
    "exact_fx": """select model_name, max_model_len, speculative_decoding, min(id) as match_id
    from models_fx group by model_name, max_model_len, speculative_decoding""",
    "j_fx": """select r.*, b.base_id, b.base_len,
      case when r.custom and r.has_len then e.match_id end as match_id
    from r_fx r left join base_fx b on b.model_name = r.model_name
      left join exact_fx e on e.model_name = r.model_name and e.max_model_len = r.requested_len
        and e.speculative_decoding = r.requested_speculative""",
    "need_fx": """select *, case when has_len then min(request_id) over
        (partition by model_name, requested_len, requested_speculative, has_len) else request_id end as first_req
    from j_fx where custom and match_id is null and base_id is not null""",
    "grp_fx": """select first_req, (select max(id) from models_fx) + row_number() over (order by first_req) as new_id,
      any_value(model_name) as model_name, any_value(base_id) as base_id,
      max(case when has_len then requested_len else base_len end) as new_len,
      any_value(requested_speculative) as spec
    from need_fx group by first_req""",
    "res_fx": """select j.*, n.first_req, g.new_id from j_fx j
      left join need_fx n on n.request_id = j.request_id left join grp_fx g on g.first_req = n.first_req""",
    # engine logs
    "l0_fx": f"""select user_id as run_id, event_id as line_no, ts, event_type, value, {K} as k from events""",
    "log_fx": """select run_id, line_no, ts, case
      when event_type = 'error' and k >= 90 then concat('RuntimeError: Server process terminated unexpectedly with exit code ', k)
      when event_type = 'error' and k >= 60 then concat('RuntimeError: CUDA error (code ', k % 7, '): out of memory')
      when event_type = 'error' and k >= 30 then concat('ValueError: No base configuration found for model m', k % 5)
      when event_type = 'error' and k < 4 then concat('ValueError: Größe überschritten in shard ', k)
      when event_type = 'error' then concat('Exception: worker ', k % 3, ' died')
      when event_type = 'view' then concat('Loading shards: ', k, '%|', repeat('█', cast(floor(k / 10) as int)), '|')
      when event_type = 'signup' then concat('INFO 03-15 core.py: Maximum concurrency for 4096 tokens per request: ',
           cast(cast(value as decimal(18,2)) as varchar), 'x')
      when event_type = 'click' and k < 10 then '   '
      when event_type = 'click' and k >= 95 then 'Press Enter to close this session'
      when event_type = 'click' and k >= 90 then concat('vLLM server exited with code ', k % 2)
      when event_type = 'purchase' and k >= 90 then 'INFO: Server started successfully'
      when event_type = 'purchase' and k < 5 then 'INFO: Server stopped'
      when event_type = 'purchase' and k < 10 then 'Traceback (most recent call last):'
      when event_type = 'purchase' and k < 20 then concat('Downloading \\u2588\\u2588 ', k, '%')
      else concat('INFO request ', line_no) end as line
    from l0_fx""",
    "run_models_fx": """select distinct user_id as run_id, cast(user_id % 40 as int) as model_id from events""",
    "err_fx": f"""select run_id, line_no, ts, line, contains(line, {_q(CRASH_SENTINEL)}) as sent from log_fx
    where contains(lower(line), 'error') or contains(lower(line), 'exception') or contains(lower(line), 'terminated')""",
    "crash_fx": """select run_id, line_no, ts, crash_no, n_lines, buffer from (
      select *, array_to_string(list(line || chr(10)) over w, '') as buffer, count(*) over w as n_lines,
             cast(sum(cast(sent as int)) over w as bigint) as crash_no
      from err_fx window w as (partition by run_id order by line_no rows between unbounded preceding and current row))
    where sent""",
    "end_fx": """select run_id, max(line_no) as line_no, arg_max(ts, line_no) as ts,
      array_to_string(list(line || chr(10) order by line_no), '') as buffer
    from err_fx group by run_id having not bool_or(sent)""",
    "event_fx": """select run_id, line_no, ts, false as at_end, buffer from crash_fx
    union all select run_id, line_no, ts, true, buffer from end_fx""",
    # sp: the pattern in DuckDB's dialect; null where Python refuses the pattern
    "cat_fx": r"""select * from (values
      (1, 'cuda error \(code [0-3]\)', 'cuda error \(code [0-3]\)', 'CUDA out of memory on a low device code',
       'Lower gpu_memory_utilization or max_model_len', 5, timestamp '2024-01-01 00:00:00'),
      (2, 'no base configuration found for model m[12]', 'no base configuration found for model m[12]',
       'Missing base configuration', 'Register a base configuration for the model', 2, timestamp '2024-01-01 00:00:00'),
      (3, 'worker 9 died', 'worker 9 died', 'Worker nine died', 'Restart the worker pool', 0, timestamp '2024-01-01 00:00:00'),
      (4, '(?P<who>worker) (?P<no>0) died', 'worker 0 died', 'Worker zero died', 'Restart the worker pool', 1,
       timestamp '2024-01-01 00:00:00'),
      (5, 'gr\w{2}e \w+schritten in shard [01]\b', 'gr[\pL\pN_]{2}e [\pL\pN_]+schritten in shard [01]([^\pL\pN_]|$)',
       'Shard too large', 'Split the shard', 0, timestamp '2024-01-01 00:00:00'),
      (6, 'worker (1 died', null, 'Not a pattern', '', 7, timestamp '2024-01-01 00:00:00'),
      (7, 'worker 2 died\nValueError', 'worker 2 died\nValueError', 'Worker two died, then a value error', '', 0,
       timestamp '2024-01-01 00:00:00'),
      (9, '\p{L}+ died', null, 'Not a Python pattern', '', 0, timestamp '2024-01-01 00:00:00'))
      t(id, error_pattern, sp, error_message, solution, initial_count, first_seen)""",
    "hits_fx": """select c.run_id, c.line_no, c.ts, c.at_end, k.id as error_id, k.error_message, k.solution
    from event_fx c join cat_fx k on regexp_matches(c.buffer, k.sp, 'i')""",
    "unm_fx": f"""select run_id, line_no, ts, buffer, {strip(
        'coalesce(' + ', '.join(f"nullif(regexp_extract(buffer, {_q(p)}, 1), '')" for p in NEW_ERROR_PATTERNS)
        + ', ' + _q(NEW_ERROR_FALLBACK) + ')')} as error_message
    from crash_fx c where not exists (select 1 from hits_fx h where h.run_id = c.run_id and h.line_no = c.line_no)""",
    "mined0_fx": f"""select run_id, line_no, ts, error_message,
      regexp_replace(substring(error_message, 1, 100), {_q(RE_ESCAPE_CLASS)}, '\\\\\\1', 'g') as error_pattern
    from unm_fx""",
    "mined_fx": f"""select cast((select max(id) from cat_fx) + row_number() over (order by first_seen, first_run_id, first_line_no) as int) as id,
      error_pattern, error_message, {_q(NEW_ERROR_SOLUTION)} as solution, first_run_id, first_line_no, first_seen, n_crashes
    from (select lower(error_pattern) as k,
            first(error_pattern order by ts, run_id, line_no) as error_pattern,
            first(error_message order by ts, run_id, line_no) as error_message,
            first(run_id order by ts, run_id, line_no) as first_run_id,
            first(line_no order by ts, run_id, line_no) as first_line_no,
            min(ts) as first_seen,
            count(*) as n_crashes
          from mined0_fx group by lower(error_pattern))""",
    "occ_fx": """select a.id, a.error_pattern, a.error_message, a.solution,
      a.initial_count + coalesce(h.hits, 0) as occurrence_count, a.first_seen, h.last_seen
    from (select id, error_pattern, error_message, solution, cast(initial_count as bigint) as initial_count, first_seen from cat_fx
      union all select id, error_pattern, error_message, solution, cast(0 as bigint), first_seen from mined_fx) a left join (
      select error_id as id, count(*) as hits, max(ts) as last_seen from (
        select error_id, ts from hits_fx
        union all select k.id, c.ts from unm_fx c join mined_fx k on regexp_matches(c.buffer, k.error_pattern, 'i')) group by error_id) h
    on h.id = a.id""",
    # GPU telemetry
    "gl_fx": f"""select sample_id, ts, case when sample_id % 53 = 0 then ''
        when sample_id % 61 = 0 then concat_ws(', ', f0, f1, f2, f3, f4)
        else concat_ws(', ', f0, f1, f2, f3, f4, f5, f6, f7) end as line
    from (select event_id as sample_id, ts, cast(cast(user_id % 8 as int) as varchar) as f0,
            concat('NVIDIA RTX A', cast(cast(user_id % 8 as int) as varchar)) as f1,
            cast(30 + {K} % 50 as varchar) as f2, cast({K} as varchar) as f3,
            cast(cast(value * 40 as decimal(18,2)) as varchar) as f4,
            case when event_id % 97 = 0 then '0' else '24576' end as f5,
            case when event_id % 13 = 0 then '[N/A]' else cast(cast(value as decimal(18,2)) as varchar) end as f6,
            '300.00' as f7 from events)""",
    "gs_fx": f"""select sample_id, ts, try_cast(p[1] as int) as gpu_index, p[2] as name,
      try_cast(p[3] as double) as temperature, try_cast(p[4] as double) as utilization,
      try_cast(p[5] as double) as mem_used, try_cast(p[6] as double) as mem_total,
      try_cast(p[7] as double) as power_draw, try_cast(p[8] as double) as power_limit
    from (select sample_id, ts, list_transform(string_split(line, ','), lambda x: {strip('x')}) as p
          from gl_fx where not {blank('line')}) where len(p) >= 8""",
    "gpl_fx": f"""select sample_id, case when sample_id % 59 = 0 then concat_ws(', ', f0, f1, f2)
        else concat_ws(', ', f0, f1, f2, f3) end as line
    from (select event_id as sample_id, cast(cast(user_id % 8 as int) as varchar) as f0,
            cast(event_id + 1000 as varchar) as f1,
            case when {K} % 3 = 0 then '/usr/bin/python3' when {K} % 3 = 1 then 'VLLM::EngineCore_worker_process'
                 else 'python -m vllm.entrypoints.openai.api_server' end as f2,
            cast(cast(value * 10 as decimal(18,2)) as varchar) as f3
          from events)""",
    "gp_fx": f"""select sample_id, try_cast(p[1] as int) as gpu_id, try_cast(p[2] as int) as pid, p[3] as name,
      try_cast(p[4] as double) as memory_usage, 'C' as type
    from (select sample_id, list_transform(string_split(line, ','), lambda x: {strip('x')}) as p
          from gpl_fx where not {blank('line')}) where len(p) >= 4""",
    # inference
    "pr_fx": """select conv_id as request_id, turn as prompt_no, text as prompt,
      case when conv_id % 2 = 0 then 'chat' else 'completion' end as mode,
      concat('Brand#', cast(conv_id % 28 as int)) as model_name,
      case when conv_id % 3 = 0 then null else cast(conv_id % 5 - 1 as int) end as batch_size,
      conv_id % 4 as ov
    from conversations where role = 'user'""",
    "plan_fx": """select r.request_id, r.model_name,
      case when d.id is null then 'unknown_model' else 'ok' end as status,
      d.id as model_id, d.model_path,
      case when d.id is not null then
        case when r.mode = 'chat' and coalesce(d.chat_template, '') <> '' then 'chat' else 'completion' end end as mode,
      case when d.id is not null then cast(greatest(1, least(r.batch_size, coalesce(d.max_batch_size, 1))) as int) end
        as batch_size,
      case when d.id is not null then case r.ov
        when 0 then '{"temperature": 0.2, "max_tokens": 1024, "top_p": 0.95}'
        when 1 then '{"temperature": 0.7, "max_tokens": 256, "top_p": 0.95, "stop": "END"}'
        else '{"temperature": 0.7, "max_tokens": 1024, "top_p": 0.95}' end end as params_json
    from (select request_id, any_value(model_name) as model_name, any_value(mode) as mode,
            any_value(batch_size) as batch_size, any_value(ov) as ov from pr_fx group by request_id) r
      left join default_fx d on d.model_name = r.model_name""",
    "pb_fx": """select request_id, prompt_no, cast(floor(idx / batch_size) as bigint) as batch_no,
      cast(idx % batch_size as int) as pos
    from (select p.request_id, p.prompt_no, pl.batch_size,
            row_number() over (partition by p.request_id order by p.prompt_no) - 1 as idx
          from pr_fx p join plan_fx pl on pl.request_id = p.request_id and pl.status = 'ok')""",
    "ans_fx": """select u.conv_id as request_id, u.turn as prompt_no, a.text as answer,
      case when u.turn % 4 = 0 then cast(length(a.text) as int) else 0 end as usage_tokens
    from conversations u join conversations a
      on a.conv_id = u.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
    where u.role = 'user'""",
    "cb_fx": """select b.* from pb_fx b join plan_fx p on p.request_id = b.request_id
    where p.status = 'ok' and p.mode = 'completion'""",
    "cn_fx": """select request_id, batch_no, count(*) as n_prompts from cb_fx group by request_id, batch_no""",
    "ca_fx": """select b.request_id, b.batch_no, b.prompt_no, a.answer, a.usage_tokens,
      row_number() over (partition by b.request_id, b.batch_no order by b.prompt_no) - 1 as cpos
    from cb_fx b join ans_fx a on a.request_id = b.request_id and a.prompt_no = b.prompt_no""",
    "calls_fx": """select request_id, batch_no, 0 as call_no, 'completions' as endpoint, count(*) as n_prompts,
      to_json({'prompt': list(prompt order by pos), 'model': any_value(model_path)}) as obj,
      any_value(params_json) as params_json
    from (select b.*, p.prompt, pl.model_path, pl.params_json from pb_fx b
          join pr_fx p on p.request_id = b.request_id and p.prompt_no = b.prompt_no
          join plan_fx pl on pl.request_id = b.request_id where pl.mode = 'completion')
    group by request_id, batch_no
    union all
    select b.request_id, b.batch_no, b.pos as call_no, 'chat/completions' as endpoint, 1 as n_prompts,
      to_json({'model': pl.model_path, 'messages': [{'role': 'user', 'content': p.prompt}]}) as obj, pl.params_json
    from pb_fx b join pr_fx p on p.request_id = b.request_id and p.prompt_no = b.prompt_no
      join plan_fx pl on pl.request_id = b.request_id where pl.mode = 'chat'""",
    # API access log
    "api_fx": f"""select event_id as line_no, case when event_id % 37 = 0 then '  File "server.py", line 1 - in main'
      else concat(strftime(ts, '%Y-%m-%d %H:%M:%S,%g'), ' - vllm-api - INFO - ',
      case when event_id % 10 = 9 then concat('Found loaded model: m', {K} % 5)
           when event_id % 2 = 0 then concat('Request: ',
             case when event_type in ('purchase', 'signup') then 'POST' else 'GET' end,
             ' http://localhost:8000/api/', event_type, '?k=', {K})
           else concat('Response: ', case when event_type = 'error' then '500' when {K} >= 95 then '404' else '200' end)
      end) end as value from events""",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in names) + "\n"


def _health_sql() -> str:
    flags = ", ".join(f"bool_or(contains(line, {_q(ind)})) as f{i}" for i, ind in enumerate(HEALTH_ERROR_INDICATORS))
    any_err = " or ".join(f"f{i}" for i in range(len(HEALTH_ERROR_INDICATORS)))
    items = ", ".join(f"case when f{i} then {_q(ind)} end" for i, ind in enumerate(HEALTH_ERROR_INDICATORS))
    return with_("l0_fx", "log_fx") + f"""
    select run_id, n_lines, case when {any_err} then 'error' when w then 'waiting' else 'running' end as status,
      array_to_string(list_filter([{items}], lambda x: x is not null), ', ') as errors_found
    from (select run_id, count(*) as n_lines, {flags}, bool_or(contains(line, {_q(HEALTH_WAITING_MARKER)})) as w
          from (select *, row_number() over (partition by run_id order by line_no desc) as rn from log_fx)
          where rn <= 1000 group by run_id)"""


def _contains_any(needles) -> str:
    return "(" + " or ".join(f"contains(line, {_q(n)})" for n in needles) + ")"


_UI_PROGRESS = f"(contains(line, '|') and {_contains_any(UI_PROGRESS_BLOCKS)})"

_ORDER_GEN = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax"

_BAND = "case when {x} < 30 then 'low' when {x} < 70 then 'mid' when {x} is not null then 'high' end"

ORACLE_SQL: dict[str, str] = {
    "usage_rollup": with_("gens_fx", "usage_fx") + "select * from usage_fx",
    "model_stats": with_("models_fx", "gens_fx", "usage_fx", "stats_fx") + "select * from stats_fx",
    "model_listing": with_("models_fx", "gens_fx", "usage_fx", "stats_fx") +
        "select * from stats_fx order by model_name, max_model_len, id",
    "latest_model": with_("models_fx", "gens_fx") + f"""
        select g.model_id, m.model_name, g.generated_at from (
          select * from gens_fx order by generated_at desc nulls first, {_ORDER_GEN} limit 1) g
        join models_fx m on m.id = g.model_id""",
    "model_by_id": with_("models_fx") + """
        select l.request_id, l.model_id, m.model_name is not null as found, m.model_name, m.model_path, m.max_model_len
        from (select event_id as request_id, cast(floor(value * 10) as int) as model_id from events) l
        left join models_fx m on m.id = l.model_id""",
    "model_configs": with_("models_fx", "sr_fx") + """
        select * from models_fx where model_name in (select model_name from sr_fx)
        order by model_name, max_model_len, id""",
    "model_by_path": with_("models_fx") + """
        select l.lookup_id, l.model_path, b.model_id, b.model_name
        from (select p_partkey as lookup_id,
                concat('/models/', replace(p_name, ' ', '-'), '-', cast(p_partkey + p_partkey % 2 as varchar)) as model_path
              from part) l
        left join (select model_path, min(id) as model_id, arg_min(model_name, id) as model_name
                   from models_fx group by model_path) b on b.model_path = l.model_path""",
    "start_config": with_("models_fx", "sr_fx") + """
        select r.request_id, r.model_name, r.max_model_len as requested_len, min(m.id) as config_id,
          min(m.id) is not null as found
        from sr_fx r left join models_fx m on m.model_name = r.model_name
          and (coalesce(r.max_model_len, 0) = 0 or m.max_model_len = r.max_model_len)
        group by r.request_id, r.model_name, r.max_model_len""",
    "default_config": with_("models_fx", "default_fx") + "select * from default_fx",
    "model_group_summary": with_("models_fx") + """
        select model_name, count(*) as n_configs, cast(count(distinct max_model_len) as int) as n_lengths,
          array_to_string(list_sort(list_distinct(list(max_model_len))), ',') as lengths,
          bool_or(speculative_decoding) as any_speculative,
          first(id order by max_model_len, id) as base_id,
          first(model_path order by max_model_len, id) as base_model_path,
          first(max_model_len order by max_model_len, id) as base_max_model_len,
          first(tensor_parallel_size order by max_model_len, id) as base_tensor_parallel_size,
          first(chat_template order by max_model_len, id) as base_chat_template
        from models_fx group by model_name order by model_name""",
    "config_resolve": with_("models_fx", "sr_fx", "r_fx", "base_fx", "exact_fx", "j_fx", "need_fx", "grp_fx",
                            "res_fx") + """
        select request_id, model_name, requested_len, requested_speculative,
          case when not custom and base_id is not null then 'default'
               when match_id is not null then 'match'
               when new_id is not null and first_req = request_id then 'derived'
               when new_id is not null then 'match' else 'error' end as status,
          cast(coalesce(case when not custom then base_id end, match_id, new_id) as int) as config_id
        from res_fx""",
    "model_register": with_("models_fx", "sr_fx", "r_fx", "base_fx", "exact_fx", "j_fx", "need_fx", "grp_fx") + """
        select cast(g.new_id as int) as id, g.model_name, m.model_path, m.tensor_parallel_size,
          cast(g.new_len as int) as max_model_len, m.gpu_memory_utilization, m.enforce_eager, m.chat_template,
          g.spec as speculative_decoding, cast(null as int) as max_batch_size,
          cast(0 as bigint) as generations_count, cast(0 as bigint) as tokens_generated_count,
          0.0::double as avg_tokens_per_second, timestamp '2024-02-01 00:00:00' as created_at
        from grp_fx g join models_fx m on m.id = g.base_id""",
    "log_line_classes": with_("l0_fx", "log_fx") + f"""
        select run_id, line_no, is_progress, is_exit, is_errorish, is_crash,
          case when is_crash then 'crash' when is_errorish then 'error' when is_progress then 'progress'
               when is_exit then 'exit' else 'output' end as line_class
        from (select run_id, line_no,
                contains(line, {_q(SERVER_PROGRESS_MARK)}) and {_contains_any(SERVER_PROGRESS_BLOCKS)} as is_progress,
                contains(line, {_q(EXIT_MARKER)}) as is_exit,
                contains(lower(line), 'error') or contains(lower(line), 'exception')
                  or contains(lower(line), 'terminated') as is_errorish,
                contains(line, {_q(CRASH_SENTINEL)}) as is_crash
              from log_fx where not {blank('line')})""",
    "progress_collapse": with_("l0_fx", "log_fx") + f"""
        select run_id, line_no, line from (
          select *, lead(p) over (partition by run_id order by line_no) as np
          from (select *, {_UI_PROGRESS} as p from log_fx where not {blank('line')}))
        where not (p and coalesce(np, false))""",
    "server_state_timeline": with_("l0_fx", "log_fx") + f"""
        select run_id, line_no, ts, state, prev_state, not (state is not distinct from prev_state) as changed
        from (select *, lag(state) over (partition by run_id order by line_no) as prev_state
              from (select run_id, line_no, ts,
                      case when {_contains_any(STOPPED_MARKERS)} then 'stopped'
                           when {_contains_any(RUNNING_MARKERS)} then 'running' end as state
                    from log_fx) where state is not null)""",
    "max_batch_backfill": with_("models_fx", "l0_fx", "log_fx", "run_models_fx") + f"""
        select m.id, m.model_name, m.max_batch_size as max_batch_size_before, p.parsed_concurrency,
          coalesce(m.max_batch_size, p.parsed_concurrency) as max_batch_size
        from models_fx m left join (
          select rm.model_id, arg_min(r.last_mc, (r.first_ts, r.run_id)) as parsed_concurrency
          from (select run_id, arg_max(mc, line_no) as last_mc, min(ts) as first_ts from (
                  select run_id, line_no, ts,
                    try_cast(trunc(try_cast(regexp_extract(line, {_q(CONCURRENCY_RE)}, 2) as double)) as int) as mc
                  from log_fx where regexp_matches(line, {_q(CONCURRENCY_RE)})) where mc is not null group by run_id) r
          join run_models_fx rm on rm.run_id = r.run_id group by rm.model_id) p
        on p.model_id = m.id""",
    "run_health": _health_sql(),
    "run_duration": with_("l0_fx", "log_fx") + """
        select run_id, first_ts, last_ts, n_lines, duration_seconds,
          concat(case when h > 0 then concat(h, 'h ') else '' end, case when m > 0 then concat(m, 'm ') else '' end,
                 s, 's') as uptime
        from (select *, cast(floor(whole / 3600) as bigint) as h, cast(floor(whole / 60) as bigint) % 60 as m,
                whole % 60 as s
              from (select *, cast(floor(duration_seconds) as bigint) as whole
                    from (select run_id, min(ts) as first_ts, max(ts) as last_ts, count(*) as n_lines,
                            (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as duration_seconds
                          from log_fx group by run_id)))""",
    "log_tail": with_("l0_fx", "log_fx") + """
        select * from (select run_id, line_no, line from log_fx where run_id = (select max(run_id) from log_fx)
                       order by line_no desc limit 100) order by line_no""",
    "log_unescape": with_("l0_fx", "log_fx") + r"""
        select run_id, line_no,
          list_reduce(list_distinct(regexp_extract_all(line, '\\u[0-9a-fA-F]{4}')),
                      lambda acc, x: replace(acc, x, chr(cast('0x' || substr(x, 3, 4) as int))), line) as text
        from log_fx""",
    "message_routes": with_("l0_fx", "log_fx") + """,
        msg_fx AS (select run_id, line_no as msg_id, case when trim(line) = '' then '{"type": "pong"}'
            when contains(line, '%|') then concat('{"type": "progress", "data": "', line, '"}')
            when contains(line, 'RuntimeError') then concat('{"type": "error", "data": {"known": false, "message": "', line, '"}}')
            when contains(line, 'Maximum concurrency') then '{"type": "status", "data": {"running": true}}'
            when line_no % 5 = 0 then line
            when line_no % 7 = 0 then concat('[', line_no, ']')
            when line_no % 11 = 0 then '"x"'
            when line_no % 13 = 0 then line_no::varchar
            else concat('{"type": "output", "data": "', line, '"}') end as message from log_fx),
        q AS (select run_id, msg_id, message, obj, js, case when obj then json_extract_string(message, '$.type') end as typ
              from (select *, case when json_valid(message) then json_type(message) = 'OBJECT' else false end as obj,
                json_valid(message) as js from msg_fx))
        select msg_id,
          case when not js then 'text' when not obj then 'ignored' when typ in ('output', 'progress', 'status', 'error') then typ
               else 'ignored' end as route,
          case when not js then message when typ in ('output', 'progress') then json_extract_string(message, '$.data')
               when typ = 'error' then json_extract_string(message, '$.data.message')
               when typ = 'status' then json_extract_string(message, '$.data.running') end as body
        from q where not (obj and coalesce(typ = 'pong', false))""".replace("WITH ", "WITH ", 1).replace(
        "\n,\n        msg_fx", ",\n        msg_fx"),
    "crash_buffer": with_("l0_fx", "log_fx", "err_fx", "crash_fx") + "select * from crash_fx",
    "known_error_match": with_("l0_fx", "log_fx", "err_fx", "crash_fx", "end_fx", "event_fx", "cat_fx", "hits_fx") + "select * from hits_fx",
    "new_error_mining": with_("l0_fx", "log_fx", "err_fx", "crash_fx", "end_fx", "event_fx", "cat_fx", "hits_fx", "unm_fx", "mined0_fx",
                              "mined_fx") + "select * from mined_fx",
    "error_occurrences": with_("l0_fx", "log_fx", "err_fx", "crash_fx", "end_fx", "event_fx", "cat_fx", "hits_fx", "unm_fx", "mined0_fx",
                               "mined_fx", "occ_fx") + "select * from occ_fx",
    "error_ranking": with_("l0_fx", "log_fx", "err_fx", "crash_fx", "end_fx", "event_fx", "cat_fx", "hits_fx", "unm_fx", "mined0_fx",
                           "mined_fx", "occ_fx") +
        "select * from occ_fx order by occurrence_count desc nulls first, id",
    "gpu_samples": with_("gl_fx", "gs_fx") + "select * from gs_fx",
    "gpu_metrics": with_("gl_fx", "gs_fx") + f"""
        select sample_id, gpu_index, string_split(name, ' ')[-1] as short_name, utilization,
          {_BAND.format(x='utilization')} as utilization_band, pct as memory_pct, {_BAND.format(x='pct')} as memory_band,
          mem_used / 1024 as mem_used_gb, mem_total / 1024 as mem_total_gb
        from (select *, mem_used / nullif(mem_total, 0) * 100 as pct from gs_fx)""",
    "gpu_processes": with_("gpl_fx", "gp_fx") + """
        select sample_id, gpu_id, pid,
          case when length(name) > 20 then concat(substring(name, 1, 18), '...') else name end as display_name,
          memory_usage, memory_usage / 1024 as memory_gb, type
        from gp_fx""",
    "gpu_latest": with_("gl_fx", "gs_fx") + """
        select gpu_index, sample_id, ts, name, temperature, utilization, mem_used, mem_total, power_draw, power_limit
        from gs_fx qualify row_number() over (partition by gpu_index order by ts desc, sample_id desc) = 1""",
    "api_log_summary": with_("api_fx") + r"""
        select kind, level, method, path, status, count(*) as n_lines, min(asctime) as first_seen,
          max(asctime) as last_seen
        from (select asctime, level,
                case when regexp_matches(message, '^Request: ([A-Z]+) (\S+)$') then 'request'
                     when regexp_matches(message, '^Response: (\d{3})$') then 'response' else 'other' end as kind,
                case when regexp_matches(message, '^Request: ([A-Z]+) (\S+)$')
                     then regexp_extract(message, '^Request: ([A-Z]+) (\S+)$', 1) end as method,
                case when regexp_matches(message, '^Request: ([A-Z]+) (\S+)$')
                     then regexp_extract(regexp_extract(message, '^Request: ([A-Z]+) (\S+)$', 2),
                                         '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) end as path,
                case when regexp_matches(message, '^Response: (\d{3})$')
                     then cast(regexp_extract(message, '^Response: (\d{3})$', 1) as int) end as status
              from (select regexp_extract(value, '^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - (.+?) - ([A-Z]+) - (.*)$', 1) as asctime,
                      regexp_extract(value, '^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - (.+?) - ([A-Z]+) - (.*)$', 3) as level,
                      regexp_extract(value, '^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - (.+?) - ([A-Z]+) - (.*)$', 4) as message
                    from api_fx
                    where regexp_matches(value, '^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - (.+?) - ([A-Z]+) - (.*)$'))
              union all
              select null, null, 'unparsed', null, null, null from api_fx
              where not regexp_matches(value, '^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - (.+?) - ([A-Z]+) - (.*)$'))
        group by kind, level, method, path, status""",
    "request_plan": with_("models_fx", "default_fx", "pr_fx", "plan_fx") + "select * from plan_fx",
    "prompt_batches": with_("models_fx", "default_fx", "pr_fx", "plan_fx", "pb_fx") + "select * from pb_fx",
    "request_payloads": with_("models_fx", "default_fx", "pr_fx", "plan_fx", "pb_fx", "calls_fx") + r"""
        select request_id, batch_no, call_no, endpoint, cast(n_prompts as int) as n_prompts,
          concat(substring(obj, 1, length(obj) - 1),
                 case when regexp_replace(params_json, '^\{|\}$', '', 'g') <> ''
                      then ',' || regexp_replace(params_json, '^\{|\}$', '', 'g') else '' end, '}') as payload
        from calls_fx""",
    "response_parse": with_("ans_fx") + f"""
        select request_id, prompt_no, {strip('answer')} as output_text,
          cast(case when usage_tokens <> 0 then usage_tokens else {wc(strip('answer'))} end as int) as tokens_generated,
          (prompt_no % 7 + 1) * 0.25::double as time_taken
        from ans_fx""",
    "response_align": with_("models_fx", "default_fx", "pr_fx", "plan_fx", "pb_fx", "ans_fx", "cb_fx", "cn_fx",
                            "ca_fx") + f"""
        select b.request_id, b.batch_no, b.pos, b.prompt_no, {strip('a.answer')} as output_text,
          cast(case when a.usage_tokens <> 0 then a.usage_tokens else {wc('a.answer')} end as int) as tokens_generated,
          ((b.batch_no + 1) * 0.3::double) / n.n_prompts as time_taken
        from ca_fx a join cb_fx b on b.request_id = a.request_id and b.batch_no = a.batch_no and b.pos = a.cpos
          join cn_fx n on n.request_id = b.request_id and n.batch_no = b.batch_no""",
    "batch_mismatch": with_("models_fx", "default_fx", "pr_fx", "plan_fx", "pb_fx", "ans_fx", "cb_fx", "cn_fx",
                            "ca_fx") + """
        select n.request_id, n.batch_no, n.n_prompts, coalesce(r.n_responses, 0) as n_responses
        from cn_fx n left join (select request_id, batch_no, count(*) as n_responses from ca_fx
                                group by request_id, batch_no) r
          on r.request_id = n.request_id and r.batch_no = n.batch_no
        where n.n_prompts <> coalesce(r.n_responses, 0)""",
    "models_json": with_("models_fx", "gens_fx", "usage_fx", "stats_fx") + """
        select to_json(t)::varchar as json from (select * from stats_fx order by model_name, id) t""",
    "batch_generate": with_("models_fx", "default_fx", "pr_fx", "plan_fx", "pb_fx") + f"""
        select b.request_id, b.batch_no, case when any_value(pl.mode) = 'chat' then any_value(b.pos) else 0 end as call_no,
          case when any_value(pl.mode) = 'chat' then 'chat/completions' else 'completions' end as endpoint,
          cast(count(*) as int) as n_prompts, 'ok' as status,
          array_to_string(list(array_to_string(list_reverse(regexp_extract_all(p.prompt, {_q(PY_NON_WHITESPACE_RUN)})), ' ')
            order by b.pos), chr(10)) as answers, 0.25::double * count(*) as latency
        from pb_fx b join pr_fx p on p.request_id = b.request_id and p.prompt_no = b.prompt_no
          join plan_fx pl on pl.request_id = b.request_id
        group by b.request_id, b.batch_no, case when pl.mode = 'chat' then b.pos else -1 end""",
    "inference_round_trip": with_("models_fx", "default_fx", "pr_fx", "plan_fx", "pb_fx") + f"""
        select pl.model_id, count(*) as generations_count, cast(sum({wc('p.prompt')}) as bigint) as tokens_generated_count,
          cast(sum({wc('p.prompt')}) as double) / (0.25 * count(*)) as avg_tokens_per_second
        from pb_fx b join pr_fx p on p.request_id = b.request_id and p.prompt_no = b.prompt_no
          join plan_fx pl on pl.request_id = b.request_id
        group by pl.model_id""",
}

ORACLE_SQL["live_state_timeline"] = ORACLE_SQL["message_routes"].replace("        select msg_id,\n", "        , routed as (select run_id, msg_id,\n", 1) + f""")
        select run_id, msg_id, source, state, prev_state, not (state is not distinct from prev_state) as changed
        from (select *, lag(state) over (partition by run_id order by msg_id) as prev_state
              from (select run_id, msg_id, route as source,
                      case when route = 'status' then case when coalesce(line, '') in ('', 'false', '0', 'null') then 'stopped' else 'running' end
                           when route <> 'output' then null
                           when {_contains_any(STOPPED_MARKERS)} then 'stopped'
                           when {_contains_any(RUNNING_MARKERS)} then 'running' end as state
                    from (select run_id, msg_id, route, body as line from routed)) where state is not null)"""
