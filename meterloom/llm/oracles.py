"""DuckDB SQL of the queries of this folder whose whole result SQL can express."""

from __future__ import annotations

OP11 = """
with vectors as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from vectors a join vectors b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.other_id)::int as rank,
       n.other_id as negative_id, p.positive_score, n.score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and not n.same
  and 80 * p.positive_score <= 100 * n.score and 100 * n.score <= 100 * p.positive_score
qualify rank <= 5
"""

OP12 = """
with terms as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
  from documents
), words as (
  select doc, lang, source, unnest(terms) as term from terms
), kept as (
  select lang, term, count(*)::hugeint as n from words group by all having count(distinct doc) >= 10
), langs as (
  select lang, count(term) as v, coalesce(sum(kept.n), 0)::hugeint as total from (select distinct lang from terms) left join kept using (lang) group by lang
), grps as (
  select distinct lang, source from terms
), counts as (
  select w.lang, w.source, w.term, count(*)::hugeint as n from words w join kept using (lang, term) group by all
), sized as (
  select g.lang, g.source, l.v, l.total as lang_total, coalesce(sum(c.n), 0)::hugeint as total
  from grps g join langs l using (lang) left join counts c using (lang, source) group by all
), priced as (
  select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (s.total + 2 * s.v) as p,
         1 + 1000000000 * (k.n + 2) // (s.lang_total + 2 * s.v) as q
  from sized s join kept k using (lang) left join counts c on c.lang = s.lang and c.source = s.source and c.term = k.term
), pairs as (
  select g.lang, g.source, 'pair' as part, h.source as item, coalesce(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)), 0)::bigint as value
  from grps g join grps h on g.lang = h.lang and g.source <> h.source
  left join priced a on a.lang = g.lang and a.source = g.source
  left join priced b on b.lang = h.lang and b.source = h.source and b.term = a.term
  where a.term is null or b.term is not null
  group by all
), own as (
  select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from priced where n > 0 and p > q
)
select *, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all
select *, row_number() over (partition by lang, source order by value desc, item)::int as rank from own qualify rank <= 10
"""

OP13 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select unnest([-7, -7]), unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
), escaped as (
  select *, len(regexp_extract_all(role, p)) + len(regexp_extract_all(text, p)) as escapes
  from turns, (select '<\\*(?:\|(?:start|message|end|im_start|im_end|endoftext)\|>|/?s>|</?SYS>>)|\[\\*/?INST\]' as p)
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length(role) + length(text) + escapes + 27)::bigint as formatted_chars
from escaped group by conv_id
"""

SQL = {"op11_negatives": OP11, "op12_audit": OP12, "op13_chat": OP13}
