"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import licenses, queries, spelling

ORACLE_SQL: dict[str, str] = {}


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_templates = ", ".join(f"({k}, {_text(label)}, {_list(ws)}, {_list(licenses.required_words(label, ws))}::varchar[])"
                       for k, label, ws in licenses.template_words())
_places = " || ".join(
    "[{'at': i, 'label': " + _text(label) + "} for i in range(1, len(w) + 2 - " + str(len(parts)) + ") if "
    + " and ".join(f"w[i + {k}] = {_text(p)}" for k, p in enumerate(parts)) + "]"
    for phrase, label in licenses.BASE_PHRASES.items() for parts in [phrase.split(" ")])

ORACLE_SQL["op9_license_scan"] = f"""
with low as (
  select doc_id, translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}') as t from documents),
words as (select doc_id, t, regexp_extract_all(t, '{_WORDS}') as w from low),
places as (select doc_id, len(w) as n, {_places} as p from words),
lines as (select doc_id, b, regexp_extract_all(line, '{_WORDS}') as lw
          from (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as b from low)),
starts as (select doc_id, len(lw) as n, sum(len(lw)) over (partition by doc_id order by b) - len(lw) as s from lines),
sets as (select doc_id, list_distinct(w[s + 1 : s + l.n + {licenses.reach()}]) as w
         from starts l join words using (doc_id) where l.n > 0),
templates(k, label, tw, must) as (values {_templates}),
hits as (
  select doc_id, label, len(list_intersect(w, tw)) / len(tw) as score
  from sets, templates
  where len(list_intersect(w, tw)) / len(tw) >= {licenses.THRESHOLD} and list_has_all(w, must)),
best as (select doc_id, list(distinct label) as found, max(score) as best from hits group by doc_id)
select p.doc_id, n::bigint as n_words, len(p)::bigint as n_base,
  (list_min([x.at for x in p]) - 1)::bigint as first_word, (list_max([x.at for x in p]) - 1)::bigint as last_word,
  coalesce(array_to_string(list_sort(list_distinct([x.label for x in p])), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct([x.label for x in p] || coalesce(found, []))), ','), '') as labels,
  case when len(p) > 0 then 1.0 else coalesce(best, 0.0) end::double as score
from places p left join best b on p.doc_id = b.doc_id
"""

_SPACE = r"[^\x20\x09-\x0D]+"
ORACLE_SQL["op4_near_dedup"] = f"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{_SPACE}') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w
    else list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) end as s from words),
sizes as (select doc_id, len(s)::bigint as n from sets),
rows_ as (select doc_id, unnest(s) as g from sets),
shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as k
  from rows_ a join rows_ b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (
  select x, y from shared join sizes a on a.doc_id = x join sizes b on b.doc_id = y
  where 100 * k >= 80 * (a.n + b.n - k)),
both_ways as (select x, y from links union select y, x from links),
reach(doc_id, r) as (
  select doc_id, doc_id from sizes
  union
  select reach.doc_id, both_ways.y from reach join both_ways on reach.r = both_ways.x),
parts as (select doc_id, min(r) as component_id from reach group by doc_id)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from sizes join parts using (doc_id)
"""


def _weight(depth: int, names: list[str]) -> str:
    """CASE over the weights of paths of one depth (later entries first, as in the operator)."""
    out = "1"
    for path, w in sorted(queries.MIX_WEIGHTS.items(), key=lambda x: (len(x[0]), str(x[0]))):
        if len(path) == depth:
            hit = " and ".join(f"{c} is not distinct from {_text(v)}" for c, v in zip(names, path) if v is not None) or "true"
            out = f"case when {hit} then {w} else {out} end"
    return out


def _level(depth: int, levels: list[str]) -> str:
    """CTEs that divide the budgets of one level of the tree."""
    path, up = levels[:depth], levels[:depth - 1]
    cols = ", ".join(path)
    part = f"partition by {', '.join(up)}" if up else ""
    given = f"(select budget from b{depth - 1} u where {' and '.join(f'u.{c} is not distinct from n.{c}' for c in up)})" \
        if up else f"least((select b from budget), (select sum(tokens) * {queries.MIX_EPOCHS} from leaves))"
    order = f"{part} order by held / weight, {path[-1]} nulls first"
    return f"""
n{depth} as (select {cols}, sum(tokens)::hugeint * {queries.MIX_EPOCHS} as held, ({_weight(depth, path)})::hugeint as weight
  from leaves group by {cols}),
g{depth} as (select n.*, {given}::hugeint as given from n{depth} n),
w{depth} as (select *,
    greatest(given - coalesce(sum(held) over ({order} rows between unbounded preceding and 1 preceding), 0), 0) as remains,
    sum(weight) over ({part}) - coalesce(sum(weight) over ({order} rows between unbounded preceding and 1 preceding), 0) as weights
  from g{depth}),
f{depth} as (select *, held = 0 or held * weights <= remains * weight as filled from w{depth}),
b{depth} as (select {cols}, case when filled then held else
    ((given - coalesce(sum(held) filter (filled) over ({part}), 0)) * weight) // nullif(sum(weight) filter (not filled) over ({part}), 0)
    end as budget from f{depth})"""


_levels = ["domain", "lang", "source"]
_order = ("('0x' || substr(md5(concat_ws('|', '" + str(queries.MIX_SEED) + "', whole::varchar, "
          "coalesce(doc_id::varchar, md5(coalesce(text, ''))))), 1, 15))::bigint")
_same = " and ".join(f"d.{c} is not distinct from p.{c}" for c in _levels)
ORACLE_SQL["op6_source_mix"] = f"""
with docs as (
  select doc_id, text, 'domain' || (try_cast(regexp_extract(source, '(\\d+)', 1) as int) % 4)::varchar as domain, lang, source,
    coalesce((strlen(text) + 3) // 4, 0)::bigint as tokens from documents),
leaves as (select domain, lang, source, sum(tokens)::hugeint as tokens from docs group by all),
budget as (select floor(sum(tokens)::double * {queries.MIX_SHARE})::hugeint as b from leaves),
{",".join(_level(k, _levels) for k in (1, 2, 3))},
plan as (
  select p.domain, p.lang, p.source, case when tokens > 0 then budget // tokens else 1 end as whole,
    case when tokens > 0 then budget % tokens else 0 end as rest
  from leaves d join b3 p on {_same}),
turn as (select d.*, whole, rest, {_order} as o from docs d join plan p on {_same}),
run as (select *, sum(tokens) over (partition by domain, lang, source order by o
  range between unbounded preceding and current row) as s from turn)
select doc_id, domain, lang, source, tokens, (whole + case when rest > 0 and s <= rest then 1 else 0 end)::bigint as copies from run
"""


_K = 8  # centroids of op11, its rounds and scale
_ROUNDS, _SCALE, _DIMS = 10, 1024, 64
_usable = "len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def _round(r: int) -> str:
    """Assignment to the centroids c{r}, and the centroids after it."""
    return f"""
a{r} as materialized (
  select k.i, arg_min(c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint * {_K} + c.c) as c
  from kept k, c{r} c group by k.i),
m{r} as (select c, p, sum(x)::hugeint as s, count(*)::hugeint as n from a{r} join parts using (i) group by c, p),
n{r} as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by p) as v from m{r} group by c),
c{r + 1} as materialized (select c{r}.c, coalesce(n{r}.v, c{r}.v) as v from c{r} left join n{r} using (c))"""


ORACLE_SQL["op11_centroid_clusters"] = f"""
with kept as materialized (
  select row_number() over () as i, vec_id, list_transform(embedding, lambda x: floor({_SCALE} * x::double)::bigint) as v
  from embeddings where len(embedding) = {_DIMS} and {_usable}),
parts as materialized (select i, unnest(v) as x, generate_subscripts(v, 1) as p from kept),
c0 as materialized (
  select row_number() over (order by sha256('3:' || vec_id), v) - 1 as c, v from kept
  qualify row_number() over (order by sha256('3:' || vec_id), v) <= {_K}),
{",".join(_round(r) for r in range(_ROUNDS))},
d as (
  select k.i, k.vec_id, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as distance, c.v
  from kept k, c{_ROUNDS} c),
best as (select i, vec_id, arg_min(c, distance::hugeint * {_K} + c) as c from d group by i, vec_id)
select d.vec_id, d.c::int as cluster, distance, (sum(distance) over (partition by d.c))::bigint as cluster_inertia,
  (sum(distance) over ())::bigint as inertia, sha256(array_to_string(v, ',')) as centroid_sha256
from d join best using (i, c)
"""

# crc32 of a list of bytes, by the table of its reflected polynomial
_crc_table = ("list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), "
              "lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))")
_bytes = ("flatten(list_transform(string_split({0}, ''), lambda ch: case when unicode(ch) < 128 then [unicode(ch)::bigint] "
          "else [(192 + unicode(ch) // 64)::bigint, (128 + unicode(ch) % 64)::bigint] end))")
ORACLE_SQL["op12_spelling_variants"] = f"""
with recursive runs as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'),
    '[a-z\u00C0-\u00FF]+')) as w from documents),
counted as (select coalesce(doc_id::varchar, '') || ':' || w as named, w, count(*) as k from runs where length(w) >= 5 group by all),
tab as materialized (select {_crc_table} as t),
hashed as (
  select w, k, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {_bytes.format("named")}),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) as h from counted, tab),
said as (
  select case when h % {spelling.SLIPS} = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word,
    sum(k)::bigint as n from hashed group by 1),
words as materialized (select word, n, length(word) as size from said where length(word) >= 5 and n >= 3),
less as materialized (
  select word, n, size, p, substr(word, 1, (p - 1)::int) || substr(word, (p + 1)::int) as rest
  from words, lateral (select unnest(range(1, size + 1)) as p)),
pairs as (
  select a.word, b.word as other, b.n from less a join less b on a.rest = b.rest and a.p = b.p and a.size = b.size and a.word <> b.word
  union select a.word, b.word, b.n from less a join words b on a.rest = b.word
  union select b.word, a.word, a.n from less a join words b on a.rest = b.word),
near as (select word, count(*)::bigint as n_near, min({{'less': -n, 'other': other}}) as best from pairs group by word),
told as materialized (
  select w.word, case when -best.less >= 2 * n then best.other end as form, n, coalesce(n_near, 0)::bigint as n_near,
    case when -best.less >= 2 * n then (-best.less)::bigint end as form_n
  from words w left join near using (word)),
up(word, root) as (
  select word, form from told where form is not null
  union all select up.word, told.form from up join told on up.root = told.word where told.form is not null),
top as (select word, arg_max(root, n) as root from (select up.word, up.root, told.n from up join told on told.word = up.root) group by word)
select word, form, coalesce(root, word) as root, n, n_near, form_n from told left join top using (word)
"""

ORACLE_SQL["op13_embedding_dedup"] = f"""
with recursive kept as materialized (
  select row_number() over () as i, vec_id, label, embedding::double[] as v,
    label is not null and coalesce(len(embedding) > 0 and {_usable} and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) as good
  from embeddings),
links as materialized (
  select a.i as x, b.i as y from kept a join kept b on a.label = b.label and a.i <> b.i and len(a.v) = len(b.v)
  where a.good and b.good and list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))
    / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x)))) >= 0.98),
reach(i, r) as (
  select i, i from kept
  union select reach.i, links.y from reach join links on reach.r = links.x),
heads as (select reach.i, min(k.vec_id) as component_id from reach join kept k on k.i = reach.r group by reach.i),
many as (select x as i, count(*) as n from links group by x)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id is not distinct from component_id as kept
from kept join heads using (i) left join many using (i)
"""
