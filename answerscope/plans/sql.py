"""The same queries in DuckDB's SQL over the same tables, written independently."""

from __future__ import annotations


def _tok(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: w <> ''))"


def _share(answer: str, context: str) -> str:
    return (f"case when {answer} is null or {context} is null then 0.0::double else coalesce("
            f"len(list_intersect({_tok(answer)}, {_tok(context)}))::double / nullif(len({_tok(answer)}), 0), 0.0) end")


_QA = """nb as (select count(*) n from benchmark),
qa as (
  select d.doc_id as _id, d.lang as title, d.text as context, b.text as question, d.source || '.csv' as _shard
  from documents d cross join nb left join benchmark b on b.item_id = d.doc_id % greatest(nb.n, 1))"""

_PREDICTIONS = f"""{_QA},
sent as (
  select qa.*, list_filter(string_split_regex(context, '[.\\n]+\\s*'), lambda x: x <> '') as ss,
         {_tok('question')} as qw from qa),
sc as (
  select *, list_transform(ss, lambda s: len(list_intersect(qw, {_tok('s')}))::double / nullif(len(qw), 0)) as sv from sent),
raw as (
  select _id, title, context, question, _shard, 'lead' as model, ss[1] as answer, sv[1] as score from sc
  union all
  select _id, title, context, question, _shard, 'lexical', ss[list_position(sv, list_max(sv))], list_max(sv) from sc
  union all
  select _id, title, context, question, _shard, 'echo',
         case when _id % 13 = 0 then null else question end,
         case when _id % 13 = 0 then null else (_id * 7919 % 1000)::double / 1000.0::double end from sc),
predictions as (
  select *, {_share('answer', 'context')} as overlap,
         length(context)::integer as context_length, length(question)::integer as question_length
  from raw)"""

_A, _B = "lexical", "echo"

_WIDE = f"""{_PREDICTIONS},
wide as (
  select x._id, x.question, x.context, x.question_length, x.context_length,
         x.answer as lexical_answer, x.score as lexical_score, x.overlap as overlap_lexical,
         y.answer as echo_answer, y.score as echo_score, y.overlap as overlap_echo,
         y.score - x.score as score_difference, y.overlap - x.overlap as overlap_difference,
         case when x.score > y.score then 'lexical' when y.score > x.score then 'echo' else 'tie' end as score_winner,
         case when x.overlap > y.overlap then 'lexical' when y.overlap > x.overlap then 'echo' else 'tie' end
           as overlap_winner
  from (select * from predictions where model = 'lexical') x
  join (select * from predictions where model = 'echo') y on x._id = y._id)"""

_EXTREMES = f"""{_WIDE},
ranked as (
  select _id, model, score,
         row_number() over (partition by model order by score desc nulls last, _id) as t,
         row_number() over (partition by model order by score asc nulls last, _id) as w
  from predictions)"""

_SAMPLE = f"""{_EXTREMES},
left_out as (select distinct _id from ranked where model in ('lexical', 'echo') and (t <= 10 or w <= 10)),
picked as (
  select * from wide
  where _id not in (select _id from left_out)
    and regexp_replace(lower(lexical_answer), '^\\s+|\\s+$', '', 'g')
        is distinct from regexp_replace(lower(echo_answer), '^\\s+|\\s+$', '', 'g')
  order by md5('42|' || _id::varchar), _id limit 5)"""

_PAIR = """sha256(coalesce(length(question)::varchar || ':' || question, '-') || '|' ||
               coalesce(length(context)::varchar || ':' || context, '-'))"""

_PAIRS = f"""{_PREDICTIONS},
keyed as (select *, {_PAIR} as pair_id from predictions),
classes as (
  select pair_id, count(*) as n_rows,
         count(distinct model) + max(case when model is null then 1 else 0 end) as n_models,
         count(distinct coalesce(answer, '')) as n_answers,
         bool_and(question is not null and context is not null) as complete
  from keyed group by pair_id),
levels as (
  select pair_id, n_rows, n_models::bigint as n_models, n_answers,
         case when not complete or n_models < 2 then 'insufficient_models'
              when n_answers = n_models then 'full_disagreement'
              when n_answers > 1 then 'partial_disagreement' else 'no_disagreement' end as level
  from classes)"""

_EDGES = _PAIRS.replace("keyed as (", """edged as (
  select * replace (case when _id % 5 = 0 then 'same' else answer end as answer,
                    case when _id % 5 <> 2 then question end as question,
                    case when _id % 5 = 1 then 'lead' when _id % 5 = 3 and model = 'echo' then null else model end as model)
  from predictions),
keyed as (""").replace("as pair_id from predictions", "as pair_id from edged")

_BEST = """best as (select model from (select model, avg(overlap) as m from predictions group by model)
         order by m desc, model limit 1)"""

_PAIR_SAMPLE = f"""{_PAIRS},
{_BEST},
ends as (
  (select _id, model, pair_id from keyed where model = (select model from best)
   order by score desc nulls last, _id, model limit 10)
  union
  (select _id, model, pair_id from keyed where model = (select model from best)
   order by score asc nulls last, _id, model limit 10)),
excluded as (select pair_id, count(*) as x from ends group by pair_id),
chosen as (
  select l.pair_id, l.level from levels l left join excluded e on e.pair_id = l.pair_id
  where l.level in ('full_disagreement', 'partial_disagreement') and l.n_rows > coalesce(e.x, 0)
  order by case when l.level = 'full_disagreement' then 0 else 1 end, md5('42|' || l.pair_id), l.pair_id limit 5),
pairs as (
  select pair_id, level,
         row_number() over (order by md5('42|shuffle|' || pair_id), pair_id)::integer as position from chosen)"""

_NULL_TOKENS = ("'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', "
                "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'")

_RISK = "case when coalesce(score, 0) >= 0.8 then 'low_risk' when coalesce(score, 0) >= 0.5 then 'medium_risk' else 'high_risk' end"
_TIER = ("case when overlap >= 0.8 then 'very_high' when overlap >= 0.6 then 'high' when overlap >= 0.4 then 'moderate' "
         "when overlap >= 0.2 then 'low' when overlap > 0 then 'very_low' else 'none' end")


def _verdict(x: str) -> str:
    return (f"case when {x} >= 80 then 'excellent' when {x} >= 60 then 'good' when {x} >= 40 then 'moderate' "
            f"when {x} >= 20 then 'worrying' else 'critical' end")


_CLEAN = r"lower(trim(regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s.,\-?]', '', 'g'), '\s+', ' ', 'g')))"
_DOCUMENT = f"""with {_PREDICTIONS},
per_model as (
  select model, count(*)::double as "count", avg(score) as mean_score, quantile_cont(score, 0.5) as median_score,
         avg(overlap) as avg_overlap from predictions group by model),
pairs as (select {_PAIR} as p, count(distinct answer) + max(case when answer is null then 1 else 0 end) as u
          from predictions group by 1),
rows_ as (
  select 'overall' as section, '' as item, 'total_predictions' as metric, count(*)::double as value from predictions
  union all select 'overall', '', 'avg_overlap', avg(overlap) from predictions
  union all select 'per_model', model, 'count', "count" from per_model
  union all select 'per_model', model, 'mean_score', mean_score from per_model
  union all select 'per_model', model, 'median_score', median_score from per_model
  union all select 'per_model', model, 'avg_overlap', avg_overlap from per_model
  union all select 'comparative', '', 'avg_unique_answers', avg(u) from pairs
  union all select 'categorical', {_RISK}, 'count', count(*)::double from predictions group by 2)
select section, item, metric, round(value, 6) as value from rows_"""


def _histogram(column: str, bins: int) -> str:
    return f"""with {_PREDICTIONS},
v as (select {column} as x from predictions where {column} is not null),
b as (select min(x) as lo, max(x) as hi, avg(x) as m from v),
c as (select case when hi > lo then least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) else 0 end::integer as bin,
             count(*) as n from v, b group by 1)
select g.bin::integer as bin, round(lo + g.bin * ((hi - lo) / {bins}), 6) as lower,
       round(lo + (g.bin + 1) * ((hi - lo) / {bins}), 6) as upper,
       coalesce(c.n, 0)::bigint as count, round(m, 6) as mean_value
from range({bins}) as g(bin) cross join b left join c on c.bin = g.bin"""


def _box(column: str, key: str, key_name: str) -> str:
    return f"""with {_PREDICTIONS},
v as (select {key} as k, {column} as x from predictions where {column} is not null),
q as (select k, count(*) as n, quantile_cont(x, 0.25) as q25, quantile_cont(x, 0.5) as q50,
             quantile_cont(x, 0.75) as q75 from v group by k),
f as (select *, q25 - 1.5::double * (q75 - q25) as lf, q75 + 1.5::double * (q75 - q25) as uf from q)
select f.k as "{key_name}", f.n, round(q25, 6) as q25, round(q50, 6) as q50, round(q75, 6) as q75,
       round(lf, 6) as lower_fence, round(uf, 6) as upper_fence,
       round(min(x) filter (x between lf and uf), 6) as whisker_low,
       round(max(x) filter (x between lf and uf), 6) as whisker_high,
       count(*) filter (not (x between lf and uf)) as outliers
from v join f on f.k = v.k group by f.k, f.n, q25, q50, q75, lf, uf"""


def _trend(x: str) -> str:
    return f"""with {_PREDICTIONS},
r as (select corr(score, {x}) as r from predictions)
select model, regr_count(score, {x})::bigint as points, round(regr_slope(score, {x}), 6) as slope,
       round(regr_intercept(score, {x}), 6) as intercept, round(regr_r2(score, {x}), 6) as r2,
       round((select r from r), 6) as correlation
from predictions group by model"""


_CORR_CELLS = f"""{_PREDICTIONS},
one as (
  select corr(score, overlap) as so, corr(score, question_length) as sq, corr(score, context_length) as sc,
         corr(overlap, question_length) as oq, corr(overlap, context_length) as oc,
         corr(question_length, context_length) as qc from predictions),
upper_ as (
  select 'score' as var1, 'overlap' as var2, so as r, 1 as p1, 2 as p2 from one
  union all select 'score', 'question_length', sq, 1, 3 from one
  union all select 'score', 'context_length', sc, 1, 4 from one
  union all select 'overlap', 'question_length', oq, 2, 3 from one
  union all select 'overlap', 'context_length', oc, 2, 4 from one
  union all select 'question_length', 'context_length', qc, 3, 4 from one)"""


def _best_rows(order: str) -> str:
    return f"""with {_PREDICTIONS}, {_BEST}
select _id, model, question, answer, context, score, overlap from predictions
where model = (select model from best) order by score {order} nulls last, _id, model limit 10"""


def _row_best(models) -> str:
    scores = ", ".join(f"max(score) filter (model = '{m}') as {m}_score" for m in models)
    names = [f"{m}_score" for m in models]

    def holder(extreme):
        cases = " ".join(f"when {n} = {extreme} then '{m}'" for n, m in list(zip(names, models))[:-1])
        return f"case {cases} else '{models[-1]}' end"

    return f"""{_PREDICTIONS},
s as (select _id, {scores} from predictions group by _id),
e as (select *, greatest({', '.join(names)}) as best_score, least({', '.join(names)}) as worst_score from s),
row_best as (select *, {holder('best_score')} as best_score_model, {holder('worst_score')} as worst_score_model from e)"""


_GLOBAL = _row_best((_A, _B))
_TOP = "(select * from row_best order by best_score desc nulls last, _id limit 10)"
_BOTTOM = "(select * from row_best order by worst_score asc nulls last, _id limit 10)"


ORACLES = {
    "shard_catalog": "select distinct source || '.csv' as _shard from documents",
    "load_shards": f"""with {_QA}
select _id::varchar as _id,
       case when title = 'en' or title in ({_NULL_TOKENS}) then null else title end as title,
       case when context in ({_NULL_TOKENS}) then null else context end as context,
       case when question in ({_NULL_TOKENS}) then null else question end as question, _shard from qa""",
    "shard_select": f"with {_QA} select _id, _shard, question from qa where _shard like 'src1%' or _shard = 'src7.csv'",
    "shard_stems": "select distinct source as stem from documents where source like 'src1%'",
    "sample_cap": f"with {_QA} select _id, _shard, question, context from qa order by _shard, _id limit 100",
    "normalize_input": f"""with {_QA}
select _id, question, length(context)::integer as n, 'alias' as how from qa
union all select _id, question, length(context)::integer, 'fuzzy' from qa""",
    "normalize_results": f"with {_PREDICTIONS} select _id, model, question, answer, score, overlap from predictions",
    "latest_run": f"""with {_PREDICTIONS},
t as (select *, regexp_extract(_shard, '([0-9]+)', 1)::integer as k from predictions),
r as (select *, case when k = 0 then 'draft' else '202602' || lpad((k % 28 + 1)::varchar, 2, '0') || '_120000' end
      as run_id from t)
select run_id, _id, model, answer, score, overlap from r
where run_id = (select max(run_id) from r where regexp_matches(run_id, '^[0-9]{{8}}_[0-9]{{6}}$'))""",
    "run_timestamp": """with r as (
  select event_id, ts, case when event_type = 'click' then 'run-' || event_id::varchar
                            else strftime(ts, '%Y%m%d_%H%M%S') end as run_id from events)
select event_id, run_id,
       case when run_id like 'run-%' then run_id else strftime(ts, '%d/%m/%Y - %H:%M:%S') end as label from r""",
    "scan_results": f"""with {_PREDICTIONS}
select _id::varchar as _id, case when title not in ({_NULL_TOKENS}) then title end as title,
       case when context not in ({_NULL_TOKENS}) then context end as context,
       case when question not in ({_NULL_TOKENS}) then question end as question, _shard,
       context_length, question_length, model,
       case when answer not in ({_NULL_TOKENS}) then answer end as answer, score, overlap from predictions""",
    "consolidated": f"""with {_PREDICTIONS}
select _id::varchar as _id, title, context, question, _shard, context_length, question_length, model, answer, score,
       overlap, '' as error from predictions""",
    "metrics_json": _DOCUMENT,
    "metrics_document": _DOCUMENT,
    "metrics_summary_lines": f"""with {_PREDICTIONS},
o as (select count(*) as n, round(avg(overlap), 6) as a from predictions),
m as (select model, count(*) as n, round(avg(score), 6) as mean_score, round(quantile_cont(score, 0.5), 6) as median_score,
             round(avg(overlap), 6) as avg_overlap from predictions group by model),
l as (
  select '' as major, unnest(['# Metrics Summary', '', '## Overall', '- total_predictions: ' || n,
         '- avg_overlap: ' || a, '', '## Per Model']) as line, unnest(range(7)) as minor from o
  union all
  select 'm' || model, unnest(['### ' || model, '- count: ' || n, '- mean_score: ' || coalesce(mean_score::varchar, 'None'),
         '- median_score: ' || coalesce(median_score::varchar, 'None'), '- avg_overlap: ' || avg_overlap]),
         unnest(range(5)) from m)
select row_number() over (order by major, minor) as ord, line from l""",
    "wide_summary": f"""with {_WIDE}
select count(*) as total, round(avg(question_length), 6) as mean_question_length,
       round(avg(lexical_score), 6) as mean_lexical_score, round(avg(echo_score), 6) as mean_echo_score,
       round(avg(overlap_lexical), 6) as mean_overlap_lexical, round(avg(overlap_echo), 6) as mean_overlap_echo,
       count(*) filter (score_winner = 'lexical') as wins_lexical, count(*) filter (score_winner = 'echo') as wins_echo,
       count(*) filter (score_winner = 'tie') as ties from wide""",
    "model_select": f"""with {_PREDICTIONS}
select model, count(*) as rows, case model when 'echo' then 1 else 2 end::integer as position
from predictions where model in ('echo', 'lead') group by model""",
    "fanout_predict": f"""with {_PREDICTIONS}
select _id, model, answer, score, overlap, '' as error, context_length, question_length from predictions""",
    "predict_errors": f"""with {_QA}
select _id, 'strict' as model, case when length(context) > 2000 then '' else string_split(question, ' ')[1] end as answer,
       case when length(context) > 2000 then 0.0 else 1.0 end::double as score,
       case when length(context) > 2000 then 'context too long' else '' end as error from qa""",
    "model_failures": f"""with {_QA}
select 'broken' as model, 'weights are missing' as error, count(*) as rows from qa
union all select 'rescued', null, count(*) from qa
union all select 'echo', null, count(*) from qa""",
    "truncate_context": f"with {_QA} select _id, substring(context, 1, 512) as shown from qa",
    "overlap": f"with {_PREDICTIONS} select _id, model, overlap from predictions",
    "lengths": f"""with {_QA} select _id, length(context)::integer as context_length,
       length(question)::integer as question_length from qa""",
    "question_sizes": f"""with {_QA}
select _id, len(list_filter(string_split_regex(question, '\\s+'), lambda w: w <> ''))::integer as question_length_words,
       length(replace(question, ' ', ''))::integer as question_length_chars from qa""",
    "clean_text": f"with {_QA} select _id, {_CLEAN.format(x='context')} as cleaned from qa",
    "overlap_clean": f"""with {_PREDICTIONS},
c as (select _id, model, {_CLEAN.format(x='answer')} as a, {_CLEAN.format(x='context')} as c from predictions)
select _id, model, {_share('a', 'c')} as overlap from c""",
    "risk_band": f"with {_PREDICTIONS} select _id, model, {_RISK} as risk_band from predictions",
    "overlap_tier": f"with {_PREDICTIONS} select _id, model, {_TIER} as tier from predictions",
    "overlap_verdict": f"""with {_PREDICTIONS},
m as (select avg(overlap) filter (model = 'lexical') * 100 as a, avg(overlap) filter (model = 'echo') * 100 as b
      from predictions)
select round(a, 6) as lexical_pct, round(b, 6) as echo_pct, round((a + b) / 2, 6) as mean_pct,
       round(abs(b - a), 6) as difference_pp, {_verdict('a')} as lexical_verdict, {_verdict('b')} as echo_verdict from m""",
    "performance_tier": f"""with {_PREDICTIONS},
m as (select model, avg(score) as s from predictions group by model)
select model, round(s, 6) as mean_score,
       case when s >= 0.8 then 'excellent' when s >= 0.6 then 'good' when s >= 0.4 then 'average' else 'poor' end as tier
from m""",
    "coerce_numeric": f"""with {_PREDICTIONS}
select _id, model, case when title in ('de', 'es') then null else score end as score from predictions""",
    "preview": f"""with {_QA}
select _id, case when length(context) > 200 then substring(context, 1, 200) || '...' else context end as context_preview,
       case when length(question) > 80 then substring(question, 1, 80) || '...' else question end as question_preview
from qa""",
    "filter_home": f"""with {_PREDICTIONS}
select _id, model, score, overlap from predictions
where coalesce(score, 0) >= 0.1 and coalesce(overlap, 0) >= 0.2 and model in ('lead', 'lexical')
  and (contains(lower(question), 'tion') or coalesce(contains(lower(answer), 'tion'), false))""",
    "keyword_search": f"""with {_PREDICTIONS}
select _id, model, 'regex' as how from predictions
where regexp_matches(lower(question), 'th[ae]n?d ') or coalesce(regexp_matches(lower(answer), 'th[ae]n?d '), false)
union all
select _id, model, 'literal' from predictions
where contains(lower(question), 'on, ') or coalesce(contains(lower(answer), 'on, '), false)""",
    "filter_advanced": f"""with {_PREDICTIONS}
select _id, model, score, question_length from predictions
where score between 0.1 and 0.75 and question_length between 40 and 200 and model in ('echo', 'lexical')""",
    "filter_retention": f"""with {_PREDICTIONS}
select count(*) filter (score between 0.1 and 0.75 and question_length between 40 and 200) as kept, count(*) as total,
       round(count(*) filter (score between 0.1 and 0.75 and question_length between 40 and 200)::double
             / count(*) * 100, 6) as kept_pct from predictions""",
    "overall_metrics": f"""with {_PREDICTIONS}
select count(*) as total_predictions, round(avg(overlap), 6) as avg_overlap from predictions""",
    "per_model_metrics": f"""with {_PREDICTIONS}
select model, count(*) as count, round(avg(score), 6) as mean_score,
       round(quantile_cont(score, 0.5), 6) as median_score, round(avg(overlap), 6) as avg_overlap
from predictions group by model""",
    "agreement_groups": f"""with {_PREDICTIONS}
select {_PAIR} as pair_id, count(*) as n_predictions,
       (count(distinct answer) + max(case when answer is null then 1 else 0 end))::bigint as n_unique_answers
from predictions where question is not null and context is not null group by 1""",
    "avg_unique_answers": f"""with {_PREDICTIONS},
g as (select count(distinct answer) + max(case when answer is null then 1 else 0 end) as u
      from predictions group by question, context)
select round(avg(u), 6) as avg_unique_answers from g""",
    "risk_counts": f"with {_PREDICTIONS} select {_RISK} as risk_band, count(*) as count from predictions group by 1",
    "headline_metrics": f"""with {_PREDICTIONS}
select count(*) as total_rows,
       round(avg(len(list_filter(string_split_regex(question, '\\s+'), lambda w: w <> ''))), 6) as mean_question_words,
       round(avg(length(replace(question, ' ', ''))), 6) as mean_question_chars,
       round(avg(score), 6) as mean_score, round(avg(overlap), 6) as mean_overlap from predictions""",
    "model_stats": f"""with {_PREDICTIONS}
select model, round_even(avg(score), 4) as score_mean, count(score) as scored,
       round_even(stddev_samp(score), 4) as score_std, round_even(avg(overlap), 4) as overlap_mean,
       round_even(avg(len(list_filter(string_split_regex(question, '\\s+'), lambda w: w <> ''))), 4)
         as mean_question_words,
       round_even(avg(length(replace(question, ' ', ''))), 4) as mean_question_chars
from predictions where coalesce(score, 0) >= 0.05 and coalesce(overlap, 0) >= 0 group by model""",
    "score_describe": f"""with {_PREDICTIONS}
select model, count(score) as count, round_even(avg(score), 4) as mean, round_even(stddev_samp(score), 4) as std,
       round_even(min(score), 4) as min, round_even(quantile_cont(score, 0.25), 4) as q25,
       round_even(quantile_cont(score, 0.5), 4) as q50, round_even(quantile_cont(score, 0.75), 4) as q75,
       round_even(max(score), 4) as max from predictions group by model""",
    "best_model": f"""with {_PREDICTIONS}
select model, round(avg(overlap), 6) as mean_overlap from predictions group by model
order by avg(overlap) desc, model limit 1""",
    "overlap_by_confidence": f"""with {_PREDICTIONS}
select round(coalesce(avg(overlap) filter (score >= 0.8), 0), 6) as overlap_high_score,
       round(coalesce(avg(overlap) filter (score < 0.5), 0), 6) as overlap_low_score from predictions""",
    "corr_score_overlap": f"with {_PREDICTIONS} select round(corr(score, overlap), 6) as r from predictions",
    "corr_matrix": f"""with {_CORR_CELLS}
select var1, var2, round(r, 6) as r from upper_
union all select var2, var1, round(r, 6) from upper_
union all select unnest(['score', 'overlap', 'question_length', 'context_length']) as v,
                 unnest(['score', 'overlap', 'question_length', 'context_length']), 1.0::double""",
    "corr_pairs": f"""with {_CORR_CELLS}
select var1, var2, round(r, 6) as r,
       case when abs(r) > 0.5 then 'strong' when abs(r) > 0.3 then 'moderate' else 'weak' end as strength,
       case when r > 0 then 'positive' else 'negative' end as direction
from upper_ order by abs(r) desc nulls last, p1, p2 limit 6""",
    "score_histogram": _histogram("score", 40),
    "overlap_histogram": _histogram("overlap", 30),
    "score_box": _box("score", "model", "model"),
    "overlap_box": _box("overlap", "'all'", "group"),
    "score_density": f"""with {_PREDICTIONS},
v as (select model, score as x from predictions where score is not null),
b as (select min(x) as lo, max(x) as hi from v),
t as (select model, count(*) as n from v group by model),
c as (select model, least(floor((x - lo) / (hi - lo) * 40), 39)::integer as bin, count(*) as n from v, b group by 1, 2)
select t.model, g.bin::integer as bin, round(lo + g.bin * ((hi - lo) / 40), 6) as lower,
       coalesce(c.n, 0)::bigint as count, round(coalesce(c.n, 0) / (t.n * ((hi - lo) / 40)), 6) as density
from t cross join range(40) as g(bin) cross join b left join c on c.bin = g.bin and c.model = t.model""",
    "trend_qlen_score": _trend("question_length"),
    "trend_overlap_score": _trend("overlap"),
    "tier_distribution": f"""with {_PREDICTIONS},
names as (select unnest(['very_high', 'high', 'moderate', 'low', 'very_low', 'none']) as tier,
                 unnest([1, 2, 3, 4, 5, 6]) as tier_rank),
n as (select count(*) filter (model = 'lexical')::double as a, count(*) filter (model = 'echo')::double as b from predictions),
c as (select {_TIER} as tier, count(*) filter (model = 'lexical') as a, count(*) filter (model = 'echo') as b
      from predictions group by 1)
select tier_rank::integer as tier_rank, names.tier, coalesce(c.a, 0) as lexical_count,
       round(coalesce(c.a, 0) * 100.0::double / n.a, 6) as lexical_pct, coalesce(c.b, 0) as echo_count,
       round(coalesce(c.b, 0) * 100.0::double / n.b, 6) as echo_pct,
       round(coalesce(c.b, 0) * 100.0::double / n.b - coalesce(c.a, 0) * 100.0::double / n.a, 6) as difference_pp
from names cross join n left join c on c.tier = names.tier""",
    "risk_shares": f"""with {_PREDICTIONS},
s as (select model, count(*) as n, count(*) filter ({_TIER} in ('very_low', 'none')) as risky,
             count(*) filter ({_TIER} in ('very_high', 'high')) as explicit
      from predictions where model in ('lexical', 'echo') group by model),
p as (select max(risky * 100.0::double / n) filter (model = 'lexical') as a,
             max(risky * 100.0::double / n) filter (model = 'echo') as b from s)
select model, n, risky, round(risky * 100.0::double / n, 6) as risky_pct, explicit,
       round(explicit * 100.0::double / n, 6) as explicit_pct,
       case when a > b then 'echo' else 'lexical' end as safer_model, round(abs(a - b), 6) as safer_by_pp from s, p""",
    "win_counts": f"""with {_WIDE},
g as (select unnest(['score', 'score', 'score', 'overlap', 'overlap', 'overlap']) as criterion,
             unnest(['lexical', 'echo', 'tie', 'lexical', 'echo', 'tie']) as winner),
c as (select 'score' as criterion, score_winner as winner, count(*) as n from wide group by 2
      union all select 'overlap', overlap_winner, count(*) from wide group by 2)
select g.criterion, g.winner, coalesce(c.n, 0) as count
from g left join c on c.criterion = g.criterion and c.winner = g.winner""",
    "dataset_profile": f"""with {_QA}
select count(*) as rows, round(avg(length(context)), 6) as mean_context_length,
       max(length(context))::integer as max_context_length, round(avg(length(question)), 6) as mean_question_length,
       max(length(question))::integer as max_question_length from qa""",
    "sample_means": f"""with {_SAMPLE}
select count(*) as sampled, round(avg(lexical_score), 6) as mean_lexical_score,
       round(avg(echo_score), 6) as mean_echo_score, round(avg(overlap_lexical), 6) as mean_overlap_lexical,
       round(avg(overlap_echo), 6) as mean_overlap_echo, round(avg(question_length), 6) as mean_question_length,
       round(avg(context_length), 6) as mean_context_length from picked""",
    "sample_wins": f"""with {_SAMPLE}
select 'score' as criterion, score_winner as winner, count(*) as count from picked group by 2
union all select 'overlap', overlap_winner, count(*) from picked group by 2""",
    "topk_model_counts": f"""with {_GLOBAL}
select 'top' as list, best_score_model as model, count(*) as count from {_TOP} group by 2
union all select 'bottom', worst_score_model, count(*) from {_BOTTOM} group by 2""",
    "wide_compare": f"""with {_WIDE} select * from wide""",
    "best_worst": f"with {_row_best(('lead', 'lexical', 'echo'))} select * from row_best",
    "disagreement": f"with {_PAIRS} select pair_id, n_rows, n_models, n_answers, level from levels",
    "pair_members": f"""with {_PAIR_SAMPLE}
select pair_id, level, _id, model, answer, score, overlap from keyed join pairs using (pair_id)""",
    "side_by_side": f"""with {_PAIR_SAMPLE},
r as (select p.position, p.pair_id, p.level, k.*, row_number() over (partition by p.pair_id, k.model order by k._id) as rn
      from pairs p join keyed k on k.pair_id = p.pair_id)
select position, pair_id, level, model, question,
       case when length(context) > 200 then substring(context, 1, 200) || '...' else context end as context_preview,
       answer, score, overlap from r where rn = 1""",
    "top10_best_model": _best_rows("desc"),
    "bottom10_best_model": _best_rows("asc"),
    "top10_global": f"with {_GLOBAL} select * from {_TOP}",
    "bottom10_global": f"with {_GLOBAL} select * from {_BOTTOM}",
    "extreme_ids": f"""with {_EXTREMES}
select distinct _id from ranked where model in ('lexical', 'echo') and (t <= 10 or w <= 10)""",
    "extreme_rows": f"""with {_EXTREMES}
select _id, model, 'top' as "end", t::integer as rank, score from ranked where t <= 10
union all select _id, model, 'bottom', w::integer, score from ranked where w <= 10""",
    "disagreement_sample": f"""with {_PAIR_SAMPLE}
select p.position, p.pair_id, p.level, min(k.question) as question, min(k.context) as context
from pairs p join keyed k on k.pair_id = p.pair_id group by 1, 2, 3""",
    "disagree_sample": f"with {_SAMPLE} select * from picked",
    "wide_mixed_ids": f"with {_WIDE} select * replace (case when _id % 3 = 0 then null else _id % 50 end as _id) from wide",
    "extreme_mixed_ids": f"""with {_PREDICTIONS},
mixed as (select model, score, _id::varchar as row_id, case when _id % 3 = 0 then null else _id % 50 end as _id from predictions),
ranked as (
  select *, row_number() over (partition by model order by score desc nulls last, _id nulls first, row_id) as t,
            row_number() over (partition by model order by score asc nulls last, _id nulls first, row_id) as w from mixed)
select _id, model, 'top' as "end", t::integer as rank, score from ranked where t <= 10
union all select _id, model, 'bottom', w::integer, score from ranked where w <= 10""",
    "disagreement_edges": f"""with {_EDGES}
select case when complete then pair_id else '00' || pair_id end as pair_id, l.n_rows, l.n_models, l.n_answers, level
from levels l join classes using (pair_id)""",
    "skipped_shards": """with r as (select source || '.csv' as _shard, count(*) as n,
  count(*) filter (source in ('src3', 'src5') and doc_id % 7 = 0) as bad from documents group by source)
select _shard, case when bad > 0 then bad else n end as rows, case when bad > 0 then 'skipped' else 'loaded' end as state from r""",
    "run_metrics": _DOCUMENT,
    "merged_states": _DOCUMENT,
    "streamed_run": f"""with {_PREDICTIONS}
select 'before' as step, '20260101_000000' as run_id, 0::integer as batch, count(*) as rows from predictions where _id % 2 = 0
union all select 'after', '20260202_164950', (_id % 3)::integer, count(*) from predictions group by _id % 3""",
    "late_model_failure": """
select m as model, count(*) as rows, null::varchar as error from documents, unnest(['lead', 'lexical', 'echo']) t(m) group by m
union all select 'late', 0, 'weights are gone' union all select 'broken', 0, 'weights are missing'""",
}
ORACLES |= {
    "stored_agreement": ORACLES["agreement_groups"],
    "stored_disagreement": ORACLES["disagreement"],
    "stored_side_by_side": ORACLES["side_by_side"],
    "per_model_csv": ORACLES["per_model_metrics"],
    "wide_csv": f"""with {_WIDE}
select _id, score_winner, overlap_winner, round(lexical_score, 6) as lexical_score, round(overlap_lexical, 6) as overlap_lexical,
       round(echo_score, 6) as echo_score, round(overlap_echo, 6) as overlap_echo,
       round(score_difference, 6) as score_difference, round(overlap_difference, 6) as overlap_difference from wide""",
    "correlation_csv": f"""with {_CORR_CELLS}
select 'score' as metric, 1.0::double as score, round(so, 6) as overlap, round(sq, 6) as question_length, round(sc, 6) as context_length from one
union all select 'overlap', round(so, 6), 1.0::double, round(oq, 6), round(oc, 6) from one
union all select 'question_length', round(sq, 6), round(oq, 6), 1.0::double, round(qc, 6) from one
union all select 'context_length', round(sc, 6), round(oc, 6), round(qc, 6), 1.0::double from one""",
}


def _rows_of(panel: str, sql: str, item: str, *values: str) -> str:
    """The rows ``panel, item, metric, value`` of another query's result."""
    return " union all ".join(
        f"select '{panel}' as panel, {item} as item, '{v}' as metric, round(\"{v}\"::double, 6) as value from ({sql})" for v in values)


def _keeping(sql: str, condition: str) -> str:
    """The query on the predictions that meet a condition."""
    return sql.replace(_PREDICTIONS, f"{_PREDICTIONS.replace('predictions as (', 'every_prediction as (')},\npredictions as (select * from every_prediction where {condition})")


_HOME = "coalesce(score, 0) >= 0.05 and coalesce(overlap, 0) >= 0"
_RANGE = "score between 0.1 and 0.75 and question_length is not null"
ORACLES |= {
    "home_panels": " union all ".join([
        _rows_of("headline", ORACLES["headline_metrics"], "''", "total_rows", "mean_question_words", "mean_question_chars", "mean_score", "mean_overlap"),
        _rows_of("model_stats", ORACLES["model_stats"], "model", "scored", "score_mean"),
        _rows_of("performance", ORACLES["performance_tier"], "model", "mean_score"),
        _rows_of("score_histogram", _keeping(ORACLES["score_histogram"], _HOME), "bin::varchar", "count"),
        _rows_of("best_model", ORACLES["best_model"], "model", "mean_overlap")]),
    "advanced_panels": " union all ".join([
        _rows_of("describe", _keeping(ORACLES["score_describe"], _RANGE), "model", "count", "mean", "q50"),
        _rows_of("trend_overlap", _keeping(ORACLES["trend_overlap_score"], _RANGE), "model", "points", "slope"),
        _rows_of("overlap_histogram", _keeping(ORACLES["overlap_histogram"], _RANGE), "bin::varchar", "count"),
        _rows_of("overlap_by_confidence", _keeping(ORACLES["overlap_by_confidence"], _RANGE), "''", "overlap_high_score", "overlap_low_score"),
        _rows_of("correlation", _keeping(ORACLES["corr_score_overlap"], _RANGE), "''", "r")]),
    "study_panels": " union all ".join([
        _rows_of("summary", ORACLES["wide_summary"], "''", "total", "mean_lexical_score", "wins_lexical", "wins_echo", "ties"),
        _rows_of("tiers", ORACLES["tier_distribution"], "tier", "lexical_count", "echo_count"),
        _rows_of("risk", ORACLES["risk_shares"], "model", "risky", "explicit"),
        _rows_of("verdict", ORACLES["overlap_verdict"], "''", "lexical_pct", "echo_pct"),
        _rows_of("top10", ORACLES["top10_global"], "_id::varchar", "best_score"),
        _rows_of("sample_means", ORACLES["sample_means"], "''", "sampled", "mean_overlap_lexical")]),
}
