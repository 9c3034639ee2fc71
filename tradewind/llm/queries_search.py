"""Query of the ranked lexical search."""

from tradewind.llm.lexical_search import search
from tradewind.llm.registry import query, table

_TERMS = r"""unnest([x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') if x <> ''])"""

_SEARCH_SQL = f"""
with found as (select doc_id, {_TERMS} as term from documents),
tfs as (select doc_id, term, count(*) as tf from found group by doc_id, term),
sizes as (select doc_id, count(*) as n from found group by doc_id),
totals as (select count(*) as docs, cast(sum(n) as bigint) as words from sizes),
weights as (select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / (2 * count(*) + 1))) as bigint) as w
            from tfs, totals group by term, docs),
wanted as (select item_id, term, count(*) as q from (select item_id, {_TERMS} as term from benchmark) group by item_id, term),
scores as (
  select item_id, doc_id, cast(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) as bigint) as score
  from wanted join weights using (term) join tfs using (term) join sizes using (doc_id), totals group by item_id, doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
"""


@query("op11_lexical_search", _SEARCH_SQL)
def op11_lexical_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
