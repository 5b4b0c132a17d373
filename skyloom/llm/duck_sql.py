"""DuckDB SQL of the queries that SQL can express on whole tables."""

SQL = {}

SQL["op1_exact_topk"] = """
with v as materialized (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e))
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 10
"""

SQL["op4_chat_tool_links"] = """
with recursive turns as (
  select conv_id, turn, role, text from conversations where conv_id is not null and turn is not null),
calls as (
  select conv_id, turn, min(case role when 'user' then 'answer' else 'configure' end) as tool, min(text) as text
  from turns where role in ('user', 'system') group by conv_id, turn),
results as (
  select conv_id, turn - 1 as turn, arg_min(text, turn) as content, count(*) as n from turns where role = 'assistant' group by conv_id, turn),
edges as (
  select c.conv_id, c.turn, p.turn as parent from calls c join calls p on p.conv_id = c.conv_id and p.turn in (c.turn - 1, c.turn - 2)),
paths(conv_id, turn, level) as (
  select conv_id, turn, 0 from calls
  union
  select e.conv_id, e.turn, p.level + 1 from paths p join edges e on e.conv_id = p.conv_id and e.parent = p.turn),
levels as (select conv_id, turn, max(level) as level from paths group by conv_id, turn),
joined as (
  select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.turn, r.turn) as turn, c.tool, c.text, l.level, r.content, r.n,
    c.turn is not null as is_call, r.turn is not null as is_result
  from calls c full join results r on c.conv_id = r.conv_id and c.turn = r.turn
  left join levels l on l.conv_id = c.conv_id and l.turn = c.turn),
checked as (
  select *, conv_id || '-' || turn as call_id,
    is_call and text is not null and (tool = 'configure' or length(text) <= 400) as valid
  from joined)
select conv_id, call_id, tool, level, valid, is_call and is_result as linked, coalesce(n, 0) as n_results,
  '{"arguments":' || case when is_call then '{"prompt":' || coalesce(cast(to_json(text) as varchar), 'null') || ',"turn":' || turn || '}' else 'null' end
  || ',"call_id":"' || call_id || '","level":' || coalesce(cast(level as varchar), 'null')
  || ',"parents":' || case when not is_call or turn < 1 then '[]' when turn = 1 then '["' || conv_id || '-0"]'
       else '["' || least(conv_id || '-' || (turn - 1), conv_id || '-' || (turn - 2)) || '","' || greatest(conv_id || '-' || (turn - 1), conv_id || '-' || (turn - 2)) || '"]' end
  || ',"result":' || coalesce(cast(to_json(content) as varchar), 'null')
  || ',"tool":' || case when is_call then '"' || tool || '"' else 'null' end
  || ',"valid":' || cast(valid as varchar) || '}' as json
from checked
"""

SQL["op6_line_dedup"] = r"""
with raw as materialized (
  select doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) as idx, unnest(string_split(text, chr(10))) as line
  from documents),
worded as (
  select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words,
    count(*) filter (regexp_matches(line, '[^\x20\x09-\x0D]')) over (partition by doc_id order by idx) as ord
  from raw),
l as materialized (
  select doc_id, ord, line, words, sum(words) over (partition by doc_id order by ord) as upto from worded where words > 0),
runs as (
  select s.doc_id, s.ord as a, min(e.ord) as b from l s join l e
    on e.doc_id = s.doc_id and e.ord >= s.ord and e.upto - s.upto + s.words >= 50 group by s.doc_id, s.ord
  union
  select e.doc_id, max(s.ord) as a, e.ord as b from l s join l e
    on e.doc_id = s.doc_id and e.ord >= s.ord and e.upto - s.upto + s.words >= 50 group by e.doc_id, e.ord),
content as (
  select r.doc_id, r.a, r.b, string_agg(l.line, chr(10) order by l.ord) as body
  from runs r join l on l.doc_id = r.doc_id and l.ord between r.a and r.b group by r.doc_id, r.a, r.b),
ranked as (select *, row_number() over (partition by body order by doc_id, a) as nth from content),
gone as (select distinct l.doc_id, l.ord from ranked r join l on l.doc_id = r.doc_id and l.ord between r.a and r.b where r.nth > 1),
left_over as (
  select w.doc_id, string_agg(w.line, chr(10) order by w.idx) as text, count(*) filter (w.words > 0) as n
  from worded w left join gone g on g.doc_id = w.doc_id and g.ord = w.ord where g.ord is null group by w.doc_id),
removed as (select doc_id, count(*) as n from gone group by doc_id)
select d.doc_id, case when d.text is null then null else coalesce(k.text, '') end as text,
  coalesce(r.n, 0) as removed_lines, coalesce(r.n, 0) > 0 and coalesce(k.n, 0) = 0 as emptied
from documents d left join left_over k on k.doc_id = d.doc_id left join removed r on r.doc_id = d.doc_id
"""

SQL["op9_ngram_jaccard_join"] = r"""
with recursive w as materialized (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents),
s as materialized (
  select distinct doc_id, unnest(case when words is null or len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_transform(generate_series(1, len(words) - 4), lambda i: array_to_string(words[i:i + 4], ' ')) end) as shingle
  from w),
sizes as materialized (select doc_id, count(*) as n from s group by doc_id),
pairs as materialized (
  select a.doc_id as x, b.doc_id as y, count(*) as shared
  from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as materialized (
  select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * shared >= 75 * (p.n + q.n - shared)),
both_ways as materialized (select x, y from links union all select y, x from links),
reach(doc_id, seen) as (
  select doc_id, doc_id from documents
  union
  select r.doc_id, b.y from reach r join both_ways b on b.x = r.seen)
select d.doc_id, coalesce(z.n, 0) as n_shingles, min(r.seen) as component_id
from documents d left join sizes z on z.doc_id = d.doc_id join reach r on r.doc_id = d.doc_id
group by d.doc_id, z.n
"""
