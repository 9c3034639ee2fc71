"""Query of the audit of filter orders."""

from tradewind.llm.filter_audit import audit_filters
from tradewind.llm.registry import query, table

_FAILS = [f"fails_{f}" for f in "abcde"]
_PLACE = ", ".join(f"case when {c} then strpos(filter_order, '{c[-1].upper()}') else 6 end" for c in _FAILS)
_AT_STEP = " ".join(f"when '{c[-1].upper()}' then {c}" for c in _FAILS)

_AUDIT_SQL = rf"""
with docs as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
marked as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
classes as (
  select part, fails_a, fails_b, fails_c, fails_d, fails_e, count(*) as n, count(*) filter (where good) as good,
         count(*) filter (where toxic) as toxic
  from (select part, len(w) < 100 as fails_a, 100 * len(list_distinct(w)) < 80 * len(w) as fails_b,
               100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) as fails_c,
               regexp_matches(text, '[#$%&*|]') as fails_d,
               coalesce(doc_id > min(doc_id) over (partition by text), false) as fails_e, good, toxic
        from docs left join marked using (doc_id)) group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
orders as (
  select p.f || q.f || r.f || s.f || t.f as filter_order from letters p join letters q on q.f <> p.f
  join letters r on r.f not in (p.f, q.f) join letters s on s.f not in (p.f, q.f, r.f)
  join letters t on t.f not in (p.f, q.f, r.f, s.f)),
placed as (
  select *, least({_PLACE}) as gone, {" + ".join(f"{c}::int" for c in _FAILS)} as failed from classes, orders),
steps as (
  select part, filter_order, step, n, good, toxic, gone, failed,
         case substr(filter_order, step, 1) {_AT_STEP} end as fails
  from placed, (select unnest(range(1, 6))::int as step))
select part, filter_order, step, coalesce(sum(n) filter (where gone > step), 0)::bigint as kept,
       coalesce(sum(n) filter (where gone = step), 0)::bigint as removed,
       coalesce(sum(n) filter (where fails and gone < step), 0)::bigint as redundant,
       coalesce(sum(n) filter (where fails and failed = 1), 0)::bigint as unique_fails,
       coalesce(sum(good) filter (where gone = step), 0)::bigint as good_lost,
       coalesce(sum(toxic) filter (where gone = step), 0)::bigint as toxic_lost,
       (sum(coalesce(sum(n) filter (where gone = step), 0)) over (partition by part, substr(filter_order, step, 1)))::bigint as shapley
from steps group by part, filter_order, step
"""


@query("op13_filter_audit", _AUDIT_SQL)
def op13_filter_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit_filters(docs, table(spark, sf_dir, "labels"))
