"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP6 = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents)
select doc_id,
       first_value(doc_id) over (partition by norm order by chars desc, doc_id asc nulls last) as keep_id,
       count(*) over (partition by norm) as group_size,
       doc_id is not distinct from first_value(doc_id) over (partition by norm order by chars desc, doc_id asc nulls last) as kept,
       sha256(norm) as text_sha256
from t
"""


OP4 = r"""
with recursive v as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
u as (
  select * from v
  where label is not null and v is not null and len(v) > 0
    and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
l as (
  select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.v, b.v) >= 0.93),
r as (select vec_id as a, vec_id as b from v union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as component_id from r group by a),
n as (select a, count(*) as n_links from l group by a)
select vec_id, cast(coalesce(n_links, 0) as bigint) as n_links, component_id, vec_id = component_id as kept
from v join c on c.a = vec_id left join n on n.a = vec_id
"""


OP2 = r"""
with p as (select page_id, url, encode(coalesce(html, '')) as payload from pages),
h as (select page_id, octet_length(payload) as payload_bytes, payload, sha1(payload) as hex, min(page_id) over (partition by payload) as original from p),
d as (
  select *, list_transform(range(8), lambda i: ('0x' || substr(hex, 5 * i + 1, 5))::bigint) as groups from h)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
       list_aggregate(list_transform(groups, lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g >> s) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') as payload_digest,
       case when page_id = original then 'response' else 'revisit' end as record_type,
       case when page_id <> original then original end as refers_to,
       true as intact
from d
"""


OP7 = r"""
with t as (
  select conv_id, turn, role, text from conversations
  union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from t),
e as (
  select *, replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') as safe,
         replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), chr(10), '\n') as safe_role
  from c)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(safe) + length(safe_role) + 17) as bigint) as formatted_chars,
       cast(0 as bigint) as n_rewrites, cast(0 as bigint) as n_unplaced
from e group by conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2, "op4_embeddings": OP4, "op6_exact_dedup": OP6, "op7_chat": OP7}
