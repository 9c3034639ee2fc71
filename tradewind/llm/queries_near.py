"""Query of the near-duplicate join."""

from tradewind.llm.ngram_join import near_duplicates
from tradewind.llm.registry import query, table

_NEAR_SQL = r"""
with recursive docs as (
  select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] as w from documents),
shingles as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ') as s
  from (select doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) as i from docs where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
           group by a.doc_id, b.doc_id),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
          where 5 * shared.n >= 4 * (x.n + y.n - shared.n)),
reach as (select doc_id as a, doc_id as b from documents union select reach.a, links.b from reach join links on reach.b = links.a)
select doc_id, class_id, class_size, coalesce(n, 0) as n_links, doc_id = class_id as first_in_class
from (select a as doc_id, min(b) as class_id, count(*) as class_size from reach group by a)
left join (select a as doc_id, count(*) as n from links group by a) using (doc_id)
"""


@query("op6_ngram_join", _NEAR_SQL)
def op6_ngram_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
