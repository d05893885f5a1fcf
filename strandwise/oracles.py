"""SQL of the queries, for DuckDB over the same tables."""

from __future__ import annotations

from strandwise import evidence_queries, file_queries
from strandwise.queries import ASIA_PLAN, ASIA_QUESTION, QUERY_TEXTS, SETTINGS, SHAPES, SURFACES, TIES

_PUNCTUATION = r"[!-/:-@\[-`{-~]"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _key(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^0-9a-z_]+', ' ', 'g'))"


def _tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda z: z <> ''))"


def _lexical(a: str, b: str) -> str:
    x, y = _tokens(a), _tokens(b)
    return f"(case when len({x}) > 0 and len({y}) > 0 then len(list_intersect({x}, {y})) / sqrt(len({x}) * len({y})) else 0.0 end)"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _answer(x: str) -> str:
    # Articles go as tokens: the word boundaries of regular expressions are ASCII here.
    bare = f"regexp_replace(lower(coalesce({x}, '')), '{_PUNCTUATION}', '', 'g')"
    return f"array_to_string(list_filter(regexp_split_to_array({bare}, '\\s+'), lambda w: w not in ('', 'a', 'an', 'the')), ' ')"


def _plain(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g'))"


KG = f"""
kg_surface as (
  select 0 as kind, 'LOC' as type, cast(r_regionkey as bigint) as k, r_name as name from region
  union all select 1, 'LOC', n_nationkey, n_name from nation
  union all select 2, 'ORG', s_suppkey, s_name from supplier
  union all select 3, 'PERSON', c_custkey, c_name from customer
  union all select 4, 'OTHER', p_partkey, p_name from part
  union all select 5, 'ORG', p_partkey, p_brand from part
  union all select 6, 'OTHER', c_custkey, c_mktsegment from customer),
ent as (
  select row_number() over (order by kind, k) - 1 as id, name, type, nkey from (
    select *, row_number() over (partition by nkey order by kind, k) as rn from (select *, {_key("name")} as nkey from kg_surface)) where rn = 1),
kg_rel as (
  select 0 as src, cast(n_nationkey as bigint) as k, n_name as h, 'located in region' as r, r_name as t, 'nation' as title from nation join region on n_regionkey = r_regionkey
  union all select 1, s_suppkey, s_name, 'based in nation', n_name, 'supplier' from supplier join nation on s_nationkey = n_nationkey
  union all select 2, c_custkey, c_name, 'lives in nation', n_name, 'customer' from customer join nation on c_nationkey = n_nationkey
  union all select 3, c_custkey, c_name, 'belongs to segment', c_mktsegment, 'customer' from customer
  union all select 4, p_partkey, p_name, 'made by brand', p_brand, 'part' from part),
tri as (
  select row_number() over (order by src, k) - 1 as triple_id, h, t, r, title from (
    select src, k, a.id as h, b.id as t, r, title, row_number() over (partition by a.id, b.id, r, title order by src, k) as rn
    from kg_rel join ent a on a.nkey = {_key("kg_rel.h")} join ent b on b.nkey = {_key("kg_rel.t")}) where rn = 1),
ends as (select h as eid, triple_id from tri union select t, triple_id from tri)"""


def _retrieve(p: str, limit: float = TIES.neff_threshold) -> str:
    """CTEs of one pass, with the threshold ``limit``, over {p}task(qid, qi, inst, question, head, tail, variants) and {p}anchor(qid, qi, inst, eid)."""
    own = f"case when len(variants) > 0 then '(' || array_to_string(variants[1:3], ' | ') || ')' else '' end"
    asked = f"trim('question: ' || trim(question) || '  UnknownTriple: ' || concat_ws(' ', nullif(head, ''), nullif({own}, ''), nullif(tail, '')))"
    return f"""
{p}cand as (select distinct qid, qi, inst, triple_id from {p}anchor join ends using (eid)),
{p}scored as (
  select c.*, k.question, k.head, k.tail, k.variants, x.name as hn, y.name as tn, tri.h, tri.t, tri.r,
    coalesce(list_max(list_transform(k.variants, lambda v: {_lexical("v", "tri.r")})), 0.0) as relation_score
  from {p}cand c join {p}task k using (qid, qi, inst) join tri using (triple_id) join ent x on x.id = tri.h join ent y on y.id = tri.t),
{p}topk as (
  select *, row_number() over (partition by qid, qi, inst order by relation_score desc, triple_id desc) - 1 as pos from {p}scored
  qualify pos < 8),
{p}logit as (select *, {_lexical(asked, "concat_ws(' ', hn, r, tn)")} as logit from {p}topk),
{p}sel as (select *, row_number() over (partition by qid, qi, inst order by logit desc, pos desc) - 1 as sel from {p}logit qualify sel < 3),
{p}share as (
  select qid, qi, inst, sum(w) as z, sum(w * w) as s2 from (
    select *, case when min(logit) over g <= 0 then logit - min(logit) over g + 1e-6 else logit end as w from {p}sel window g as (partition by qid, qi, inst)) group by all),
{p}state as (select k.qid, k.qi, k.inst, coalesce(z * z / s2, cast('infinity' as double)) as neff, case when z * z / s2 <= {limit!r} then 'resolved' else 'unresolved' end as status from {p}task k left join {p}share using (qid, qi, inst)),
{p}across as (
  select s.*, case when a.eid is not null and b.eid is null then s.t when b.eid is not null and a.eid is null then s.h end as other
  from {p}sel s left join {p}anchor a on (a.qid, a.qi, a.inst, a.eid) = (s.qid, s.qi, s.inst, s.h) left join {p}anchor b on (b.qid, b.qi, b.inst, b.eid) = (s.qid, s.qi, s.inst, s.t)),
{p}var as (select qid, qi, inst, case when head like '?%' and tail not like '?%' then head when tail like '?%' and head not like '?%' then tail end as var from {p}task),
{p}induced as (
  select distinct qid, qi, inst, var, other as eid from {p}across join {p}var using (qid, qi, inst) join {p}state using (qid, qi, inst)
  where status = 'resolved' and other is not null and var is not null)"""


def _agree(sets: str, p: str) -> str:
    return f"""
{p}n as (select qid, var, count(distinct (qi, inst)) as n_sets from {sets} group by all),
{p}k as (select qid, var, eid, count(distinct (qi, inst)) as k, any_value(n_sets) as n_sets from {sets} join {p}n using (qid, var) group by qid, var, eid),
{p}agree as (
  select qid, var, eid, not (n_sets > 1 and meets) or k = n_sets as in_binding, n_sets > 1 and k = n_sets as in_intersection, n_sets,
    case when n_sets > 1 and meets then 'intersection' else 'union' end as method
  from (select *, bool_or(k = n_sets) over (partition by qid, var) as meets from {p}k))"""


_NATIONS = f"""
with {KG},
task as (
  select n_name as qid, qi, '' as inst, concat_ws(' ', 'Who is in', n_name, 'as', case when n_nationkey % 3 > 0 then c_name end) as question, '?x' as head, n_name as tail,
    case when qi = 0 then ['lives in nation'] when n_nationkey % 2 = 1 then ['based in nation'] else ['lives in nation', 'resident of nation'] end as variants
  from nation left join (select c_nationkey, max(c_name) as c_name from customer group by 1) on c_nationkey = n_nationkey, (values (0), (1)) v(qi)),
anchor as (select qid, qi, inst, id as eid from task join ent on nkey = {_key("qid")}),
{_retrieve("", SETTINGS.neff_threshold)},
{_agree("induced", "")}"""

_ASIA = f"""
with {KG},
ftask as (select 'asia' as qid, 0 as qi, '' as inst, {_q(ASIA_QUESTION)} as question, '?nation' as head, 'ASIA' as tail, {list(ASIA_PLAN[0][1])!r} as variants),
fanchor as (select 'asia' as qid, 0 as qi, '' as inst, id as eid from ent where name = 'ASIA'),
{_retrieve("f")},
{_agree("finduced", "f")},
value as (select eid, name from (select eid from fagree where in_binding and var = '?nation' order by eid limit 3) join ent on id = eid),
stask as (select 'asia' as qid, 1 as qi, format('{{:012d}}|', eid) as inst, {_q(ASIA_QUESTION)} as question, '?supplier' as head, name as tail, {list(ASIA_PLAN[1][1])!r} as variants from value),
sanchor as (select 'asia' as qid, 1 as qi, format('{{:012d}}|', eid) as inst, eid from value),
{_retrieve("s")},
allsets as (select * from finduced union all select * from sinduced),
{_agree("allsets", "a")}"""

_CONTAINED = f"contained as (select doc_id, item_id from documents join benchmark on contains({_plain('documents.text')}, {_plain('benchmark.text')}))"

_RECOVERY = f"""
item as (select row_number() over (order by item_id) - 1 as n, item_id, {_squeeze("text")} as q from benchmark),
line as (
  select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
unit as (select doc_id, row_number() over (partition by doc_id order by i) - 1 as sent_idx, trim(s, ' ' || chr(9) || chr(10) || chr(13)) as sent from line where trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
ctx as (select *, {_tokens("body")} as bt from (select *, 'd' || doc_id || ' ' || sent as body from unit)),
ask as (select *, {_tokens("q")} as qt from item),
sim as (select n, doc_id, sent_idx, body, q, len(list_intersect(qt, bt)) / sqrt(len(qt) * len(bt)) as score from ask, ctx),
loc as (select *, row_number() over (partition by n, doc_id order by score desc, sent_idx) as lr from sim qualify lr <= 80),
over20 as (select *, row_number() over (partition by n order by score desc, doc_id, lr) as cr from loc qualify cr <= 20),
fin as (select *, {_lexical("'constraint: ' || q", "body")} as logit from over20),
best as (select *, row_number() over (partition by n order by logit desc, cr) - 1 as place from fin qualify place < 3)"""


def _token_list(x: str) -> str:
    return f"list_filter(string_split({_answer(x)}, ' '), lambda z: z <> '')"


_PAIRS = f"""
pair as (
  select conv_id, turn, p, g, {_token_list("p")} as pt, {_token_list("g")} as gt, {_answer("p")} as pa, {_answer("g")} as ga from (
    select conv_id, turn, role, text as p, lead(role) over w as nr, lead(text) over w as g from conversations window w as (partition by conv_id order by turn))
  where role = 'user' and nr = 'assistant'),
tok as (select conv_id, turn, t, sum(a) as a, sum(b) as b from (
  select conv_id, turn, unnest(pt) as t, 1 as a, 0 as b from pair union all select conv_id, turn, unnest(gt), 0, 1 from pair) group by all),
same as (select conv_id, turn, sum(least(a, b)) as s from tok group by all),
scored as (
  select conv_id, turn, case when coalesce(g, '') = '' then 0.0 when pa = ga then 1.0 else 0.0 end as em,
    case when coalesce(g, '') = '' or len(pt) = 0 or len(gt) = 0 or coalesce(s, 0) = 0 then 0.0
      else 2 * (s / len(pt)) * (s / len(gt)) / (s / len(pt) + s / len(gt)) end as f1
  from pair left join same using (conv_id, turn))"""


def _texts(names: list[str]) -> str:
    return "[" + ", ".join(_q(n) for n in names) + "]::varchar[]"


def _values(rows: list[str]) -> str:
    return ", ".join(f"({r})" for r in rows)


_SHAPES = _values([f"{_q(a)}, {b}, {_q(c)}, {_q(d)}" for a, b, c, d in SHAPES])
_SURFACE_ROWS = _values([_q(s) for s in SURFACES])
_TEXT_ROWS = _values([f"{_q(i)}, {_texts(v)}, {_texts(h)}, {_texts(t)}" for i, v, h, t in QUERY_TEXTS])


def _once(x: str) -> str:
    """Trimmed texts of a list without empties, the first of each spelling whatever its case."""
    clean = f"list_filter(list_transform({x}, lambda a: trim(a)), lambda a: a <> '')"
    return f"list_filter({clean}, lambda a, i: list_position(list_transform({clean}, lambda b: lower(b)), lower(a)) = i)"


SQL = {
    "kg_entities": f"with {KG} select id, name, type, nkey from ent",
    "kg_triples": f"with {KG} select * from tri",
    "kg_one_hop": f"with {KG} select eid, triple_id from ends",
    "kg_degree": f"with {KG} select eid, count(*) as degree from ends group by eid",
    "title2entities": f"with {KG} select distinct title, eid from (select title, h as eid from tri union all select title, t from tri union all select 'nation', id from ent where type = 'LOC')",
    "title2triples": f"with {KG} select title, row_number() over (partition by title order by triple_id) - 1 as place, triple_id from tri",
    "anchor_candidates": f"with {KG} select surface, id as eid from (values {_SURFACE_ROWS}) s(surface), ent where len(list_intersect({_tokens('surface')}, {_tokens('name')})) > 0",
    "constraint_types": f"""with {KG},
      c as (select * from (values {_SHAPES}) c(qid, qi, head, tail)),
      f as (select c.*, exists (select 1 from ent where (head not like '?%' and len(list_intersect({_tokens('head')}, {_tokens('name')})) > 0) or (tail not like '?%' and len(list_intersect({_tokens('tail')}, {_tokens('name')})) > 0)) as anchored from c)
      select qid, qi, case when head like '?%' and tail like '?%' then 'double_var' when (head like '?%' or tail like '?%') and anchored then 'single_var_with_anchor'
        when head not like '?%' and tail not like '?%' and anchored then 'no_var_with_anchor' else 'no_anchor' end as triple_type from f""",
    "relation_topk": f"{_NATIONS} select qid, qi, triple_id, pos from topk",
    "rerank_select": f"{_NATIONS} select qid, qi, triple_id, pos, sel, round(relation_score, 6) as relation_score, round(logit, 6) as logit from sel",
    "neff": f"{_NATIONS} select qid, qi, round(neff, 6) as neff, status from state",
    "bindings_consolidated": f"{_NATIONS} select qid, var, eid, in_binding, in_intersection, n_sets, method from agree",
    "binding_filter": f"{_NATIONS} select qid, qi, triple_id from across join var using (qid, qi, inst) join agree on (agree.qid, agree.var, agree.eid) = (across.qid, var.var, across.other) where in_binding",
    "propagation": f"{_ASIA} select var, method, row_number() over (partition by var order by eid) - 1 as place, eid from aagree where in_binding",
    "evidence_assembly": f"""{_ASIA},
      sup as (
        select 0 as qi, triple_id, sel as place from fsel join fstate using (qid, qi, inst) where status = 'resolved'
          and triple_id in (select triple_id from facross join fagree on fagree.eid = other where in_binding and var = '?nation')
        union all select 1, triple_id, row_number() over (order by triple_id) - 1 from (select distinct triple_id from ssel) where exists (select 1 from sstate where status = 'resolved')),
      idx as (select triple_id, row_number() over (order by triple_id) - 1 as idx from (select distinct triple_id from sup))
      select qi, row_number() over (partition by qi order by place) - 1 as place, idx, triple_id, x.name as head, r as relation, y.name as tail
      from sup join idx using (triple_id) join tri using (triple_id) join ent x on x.id = h join ent y on y.id = t""",
    "query_texts": f"""with q as (select qid, {_once("variants")} as r, {_once("heads")} as h, {_once("tails")} as t from (values {_TEXT_ROWS}) v(qid, variants, heads, tails)),
      x as (select qid, unnest(r) as rel, generate_subscripts(r, 1) as i, case when len(h) > 0 then h else [''] end as h, case when len(t) > 0 then t else [''] end as t from q),
      y as (select qid, rel, i, unnest(h) as hh, generate_subscripts(h, 1) as j, t from x),
      z as (select qid, i, j, generate_subscripts(t, 1) as k, {_squeeze("concat_ws(' ', nullif(hh, ''), rel, nullif(unnest(t), ''))")} as query_text from y),
      o as (select *, row_number() over (partition by qid, lower(query_text) order by i, j, k) as rn from z)
      select qid, row_number() over (partition by qid order by i, j, k) - 1 as place, query_text from o where rn = 1""",
    "embedding_topk": """with v as (select vec_id, cast(embedding as double[]) as e from embeddings)
      select q.vec_id as query_id, v.vec_id, row_number() over (partition by q.vec_id order by list_dot_product(q.e, v.e) desc, v.vec_id) as rank, round(list_dot_product(q.e, v.e), 5) as score
      from v q, v where q.vec_id % 50 = 0 qualify rank <= 10""",
    "vector_cosine": "select a.vec_id, round(list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])), 5) as score from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
    "bound_tasks": f"""with {KG},
      r as (select id, name from ent where name in (select r_name from region) order by id limit 3), n as (select id, name from ent where name in (select n_name from nation) order by id limit 3)
      select 'both' as qid, 0 as qi, format('{{:012d}}|{{:012d}}', r.id, n.id) as inst, r.name as head, n.name as tail, r.id as head_id, n.id as tail_id from r, n
      union all select 'both', 1, format('{{:012d}}|', id), name, '?who', id, -1 from n union all select 'both', 2, format('|{{:012d}}', id), '?who', name, -1, id from r""",
    "text_provenance": f"with {_CONTAINED} select doc_id, item_id from contained",
    "text_recovery": f"with {_RECOVERY} select cast(n as varchar) as qid, place, doc_id, sent_idx, round(logit, 6) as similarity from best",
    "support_recall": f"""with {_CONTAINED}, {_RECOVERY},
      gold as (select distinct n, doc_id from contained join item using (item_id)),
      unit1 as (select n, doc_id, min(place) as place from best group by all),
      pred as (select n, doc_id, row_number() over (partition by n order by place) as pos from unit1),
      hit as (select n, count(*) filter (pos <= 2) as hits_2, count(*) as hits_all from pred join gold using (n, doc_id) group by n),
      tot as (select item.n, case when exists (select 1 from pred where pred.n = item.n) then (select count(*) from gold where gold.n = item.n) else 0 end as total_gold from item)
      select cast(n as varchar) as qid, total_gold, case when total_gold > 0 then coalesce(hits_2, 0) else 0 end as hits_2, case when total_gold > 0 then coalesce(hits_all, 0) else 0 end as hits_all,
        round(case when total_gold > 0 then coalesce(hits_2, 0) / total_gold else 0.0 end, 6) as recall_2, round(case when total_gold > 0 then coalesce(hits_all, 0) / total_gold else 0.0 end, 6) as recall_all
      from tot left join hit using (n)""",
    "chunk_pack": r"""with recursive para as (
        select doc_id, trim(s, ' ' || chr(9) || chr(13)) as p, row_number() over (partition by doc_id order by i) as k from (
          select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
        where trim(s, ' ' || chr(9) || chr(13)) <> ''),
      walk as (
        select doc_id, k, p as held, 0 as chunk_idx from para where k = 1
        union all
        select w.doc_id, para.k, case when length(held) + 2 + length(p) <= 1200 then held || chr(10) || chr(10) || p else p end,
          case when length(held) + 2 + length(p) <= 1200 then chunk_idx else chunk_idx + 1 end
        from walk w join para on para.doc_id = w.doc_id and para.k = w.k + 1)
      select doc_id, chunk_idx, length(held) as n_chars, md5(held) as digest from walk qualify row_number() over (partition by doc_id, chunk_idx order by k desc) = 1""",
    "em_f1": f"with {_PAIRS} select conv_id, turn, em, round(f1, 6) as f1 from scored",
    "answer_summary": f"with {_PAIRS} select count(*) as n, round(avg(em), 6) as em, round(avg(round(f1, 6)), 5) as f1 from scored",
    "entity_types": """select p_type, case when p_type in ('PERSON', 'ORG', 'LOC', 'EVENT', 'OTHER') then p_type when p_type like '%PER%' then 'PERSON' when p_type like '%GPE%' then 'LOC'
      when p_type like '%ORG%' or p_type like '%COMP%' then 'ORG' when p_type like '%LOC%' or p_type like '%PLACE%' or p_type like '%CITY%' or p_type like '%COUNTRY%' then 'LOC'
      when p_type like '%EVENT%' then 'EVENT' else 'OTHER' end as type, count(*) as n from part group by p_type""",
    "similar_names": f"""with a as (select distinct string_split(p_name, ' ')[1] || ' bolt' as asked from part), b as (select distinct p_name from part),
      p as (select asked, p_name, round({_lexical("asked", "p_name")}, 6) as score from a, b where len(list_intersect({_tokens("asked")}, {_tokens("p_name")})) > 0)
      select asked, p_name, score, row_number() over (partition by asked order by score desc, p_name) as rank from p qualify rank <= 3""",
} | file_queries.sql(KG, _key("name")) | evidence_queries.sql(_plain, _lexical, _squeeze, _answer, _token_list, _once)
