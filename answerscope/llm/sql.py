"""DuckDB SQL of the corpus queries, where SQL can express them; written independently of the Spark code."""

from __future__ import annotations

from .license_scan import NOTICES, PHRASES
from .quality_rules import BOILERPLATE

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FROM, _TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"


def _count(text: str, signs: str) -> str:
    """How many of some characters a text has."""
    return f"(length({text}) - length(translate({text}, '{signs}', '')))"


def _solid(text: str) -> str:
    """Length without white space."""
    return f"length(translate({text}, {_WHITE}, ''))"


_OP2 = f"""
with docs as (select doc_id, coalesce(text, '') as text, {_WORDS.format('text')} as w from documents),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from docs),
judged as (
  select doc_id, line, i, {_solid('line')} as solid, len({_WORDS.format('line')}) as words,
         translate(line, '{_FROM}', '{_TO}') as low from lines),
ruled as (
  select *, words > 0 and (10 * {_count('line', '#*$%&|<>{}[]~^_=+' + chr(92) + '@!')} > solid
         or (words >= 20 and {_count('line', '.,;:!?…')} = 0)
         or {_count('line', '|»›•·>')} >= 2
         or {' or '.join(f"contains(low, '{p}')" for p in BOILERPLATE)}) as failed
  from judged),
by_line as (
  select doc_id, sum(failed::int)::bigint as n_failed_lines, sum(case when failed then solid else 0 end)::bigint as failed_chars
  from ruled group by doc_id),
dups as (select doc_id, sum(n - 1)::bigint as n_dup_lines
         from (select doc_id, line, count(*) as n from judged where words > 0 group by doc_id, line) group by doc_id),
places as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from docs where len(w) >= 3),
windows as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from places),
marked as (select distinct doc_id, i + d as i from windows, (values (0), (1), (2)) t(d) where n > 1),
again as (select doc_id, count(*) as n_repeat_words from marked group by doc_id),
base as (
  select d.doc_id, len(w)::bigint as n_words, {_solid('text')}::bigint as word_chars,
         {_count('text', '#*$%&|<>')}::bigint as n_symbols,
         coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
         n_failed_lines, failed_chars
  from docs d join by_line using (doc_id) left join dups using (doc_id) left join again using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * failed_chars <= 30 * word_chars as kept,
       n_failed_lines, failed_chars
from base"""

_ALNUM = r"regexp_extract_all(translate(coalesce({0}, ''), '" + _FROM + "', '" + _TO + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TEMPLATES = ", ".join([f"({i}, '{label}', true, '{t}')" for i, (t, label) in enumerate(PHRASES.items())]
                       + [f"({i + len(PHRASES)}, '{label}', false, '{t}')" for i, (label, t) in enumerate(NOTICES.items())])

_OP5 = f"""
with t0 as (select id, label, phrase, {_ALNUM.format('t')} as w from (values {_TEMPLATES}) v(id, label, phrase, t)),
t as (select id, label, phrase, len(w) as size, p, w[p + 1] || ' ' || w[p + 2] as gram
      from (select *, unnest(range(0, len(w) - 1)) as p from t0)),
docs as (select doc_id, {_ALNUM.format('text')} as w from documents),
grams as (select doc_id, p, w[p + 1] || ' ' || w[p + 2] as gram
          from (select doc_id, w, unnest(range(0, len(w) - 1)) as p from docs)),
votes as (select doc_id, id, label, phrase, size, g.p - t.p as diagonal, list_distinct(list(t.p)) as places
          from grams g join t on t.gram = g.gram group by all),
whole as (select doc_id, label, true as phrase, diagonal as start, 1.0::double as share
          from votes where phrase and len(places) = size - 1),
stepped as (select *, case when diagonal - lag(diagonal) over o > 3 or lag(diagonal) over o is null then 1 else 0 end as new
            from votes where not phrase window o as (partition by doc_id, id order by diagonal)),
numbered as (select *, sum(new) over (partition by doc_id, id order by diagonal) as span from stepped),
points as (select doc_id, id, label, size, span, diagonal, unnest(places) as place from numbered),
merged as (select doc_id, id, label, size, span, min(diagonal) as start,
                  len(list_distinct(list_concat(list(place), list(place + 1)))) as words
           from points group by all),
found as (select * from whole union all
          select doc_id, label, false, start, words::double / size from merged where words::double / size >= 0.6),
by_doc as (select doc_id, count(*) filter (phrase) as n_base, min(start) filter (phrase) as first_word,
                  max(start) filter (phrase) as last_word,
                  string_agg(distinct label, ',' order by label) filter (phrase) as base_labels,
                  string_agg(distinct label, ',' order by label) as labels, max(share) as score
           from found group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from docs d left join by_doc b using (doc_id)"""

_OP3 = f"""
with items as (select item_id::varchar as item, {_ALNUM.format('text')} as w from benchmark),
windows as (
  select item, least(len(w), 10) as n, array_to_string(w[i + 1:i + 10], ' ') as said
  from (select item, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) as i from items where len(w) > 0)),
docs as (select doc_id, {_ALNUM.format('text')} as w from documents),
sizes as (select distinct n from windows),
places as (select doc_id, n, w, unnest(range(0, len(w) - n + 1)) as i from docs, sizes where len(w) >= n),
found as (select p.doc_id, p.i, p.n, x.item from places p join windows x on x.n = p.n and x.said = array_to_string(p.w[p.i + 1:p.i + p.n], ' ')),
hit as (select doc_id, count(distinct i + d) as n_hit from found, range(0, 10) t(d) where d < n group by doc_id),
named as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from found group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (doc_id) left join named using (doc_id)"""

_OP7 = f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
keyed as (select *, translate(trim(line, {_WHITE}), '{_FROM}', '{_TO}') as key from lines),
common as (select key from keyed where key <> '' group by key having count(distinct doc_id) >= 10),
marked as (select k.*, c.key is not null as gone from keyed k left join common c on c.key = k.key)
select doc_id, count(*)::bigint as n_lines, sum(gone::int)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from marked group by doc_id"""

_OP9 = """
with sizes as (select source, sum(length(text))::double as size from documents group by source),
rates as (select source, (sqrt(size) / sum(sqrt(size)) over ()) * sum(size) over () / size as rate from sizes where size > 0),
parts as (select source, ceil(rate / 16)::int as parts, rate / ceil(rate / 16) as mean from rates),
tables as (select source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) over (partition by source order by k) as below
           from parts, range(0, 97) t(k)),
draws as (
  select d.doc_id, md5(d.text) as body, d.source, j,
         ('0x' || substr(md5('9|' || coalesce(d.doc_id::varchar, '') || '|' || coalesce(md5(d.text), '') || '|' || j::varchar), 1, 13))::bigint / 4503599627370496.0::double as u
  from documents d join parts p on p.source is not distinct from d.source, range(1, 1000) t(j) where j <= p.parts),
counts as (select w.doc_id, w.body, w.source, sum((t.below <= w.u)::int) as n
           from draws w join tables t on t.source is not distinct from w.source group by w.doc_id, w.body, w.source)
select d.doc_id, d.source, d.lang, d.text, c.copy::bigint as copy,
       md5('order9|' || coalesce(d.doc_id::varchar, '') || '|' || coalesce(md5(d.text), '') || '|' || c.copy::varchar) as shuffle_key
from documents d join (select doc_id, body, source, unnest(range(1, n::bigint + 1)) as copy from counts where n > 0) c
  on c.doc_id is not distinct from d.doc_id and c.body is not distinct from md5(d.text) and c.source is not distinct from d.source"""

_OP10 = """
with turns as (
  select conv_id, role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn) as r,
         turn from (select distinct conv_id, turn, role, text from conversations where conv_id is not null)),
whole as (select conv_id, count(*) as n_turns, string_agg(coalesce(role, '-') || chr(2) || text, chr(1) order by r) || chr(1) as said
          from turns group by conv_id),
same as (select min(conv_id) as conv_id, n_turns, said, count(*) as copies from whole group by n_turns, said),
firsts as (
  select distinct r as n_turns, string_agg(coalesce(role, '-') || chr(2) || text, chr(1))
           over (partition by conv_id order by r rows unbounded preceding) || chr(1) as said, conv_id
  from turns),
proper as (select distinct f.n_turns, f.said from firsts f join whole w using (conv_id) where f.n_turns < w.n_turns),
chosen as (select * from same s where not exists (select 1 from proper p where p.n_turns = s.n_turns and p.said = s.said)),
rendered as (
  select c.conv_id, c.n_turns, c.copies, floor(t.turn / 256) as block, count(*) as part_turns,
         string_agg('<|im_start|>' || lower(coalesce(t.role, 'unknown')) || chr(10) || t.text || '<|im_end|>' || chr(10), '' order by t.r) as rendered
  from chosen c join turns t using (conv_id) group by all)
select conv_id, row_number() over (partition by conv_id order by block) - 1 as part, n_turns, copies, part_turns, rendered
from rendered"""

_OP12 = """
with sized as (select len(embedding) as d from embeddings where len(embedding) > 0 group by 1 order by count(*) desc, 1 limit 1),
rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda c: floor(256 * c::double)) as x
  from embeddings
  where vec_id is not null and label is not null and len(embedding) = (select d from sized)
    and len(list_filter(embedding, lambda c: c is not null and isfinite(c))) = len(embedding)),
scored as (
  select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id, b.label, list_dot_product(a.x, b.x)::bigint as score
  from rows a join rows b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
positives as (
  select * from scored where label = anchor_label
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id,
       (row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id))::integer as rank,
       n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and n.label <> p.label
where 100 * n.score between 50 * p.score and 95 * p.score
qualify row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id) <= 3"""

_OP13 = """
with recursive sized as (select len(embedding) as d from embeddings where len(embedding) > 0 group by 1 order by count(*) desc, 1 limit 1),
rows as (
  select vec_id, label, list_transform(embedding, lambda c: c::double) as x
  from embeddings
  where vec_id is not null and label is not null and len(embedding) = (select d from sized)
    and len(list_filter(embedding, lambda c: c is not null and isfinite(c))) = len(embedding)
    and len(list_filter(embedding, lambda c: c <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from rows a join rows b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.x, b.x) >= 0.98),
reached(vec_id, other) as (select vec_id, vec_id from embeddings union select r.vec_id, l.b from reached r join links l on l.a = r.other),
least as (select vec_id, min(other) as component_id from reached group by vec_id),
counts as (select a as vec_id, count(*) as n_links from links group by a)
select e.vec_id, coalesce(c.n_links, 0) as n_links, m.component_id, e.vec_id = m.component_id as kept
from embeddings e join least m using (vec_id) left join counts c using (vec_id)"""

ORACLES: dict[str, str] = {
    "op2_quality_rules": _OP2,
    "op3_decontaminate": _OP3,
    "op5_license_scan": _OP5,
    "op7_line_dedup": _OP7,
    "op9_mix_sources": _OP9,
    "op10_chat_format": _OP10,
    "op12_hard_negatives": _OP12,
    "op13_near_vectors": _OP13,
}
