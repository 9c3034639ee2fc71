"""Queries of the operators that mark spans of texts: benchmark passages."""

from pyspark.sql import functions as F

from tradewind.llm.decontaminate import find_hits
from tradewind.llm.registry import query, table

_WORDS = r"""[x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> '']"""

_HITS_SQL = f"""
with docs as (select doc_id, {_WORDS} as w from documents),
items as (select cast(item_id as varchar) as item_id, {_WORDS} as w from benchmark),
windows as (
  select distinct item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as key from (
    select item_id, w, least(len(w), 10) as size, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i
    from items where len(w) > 0)),
places as (
  select doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') as key from (
    select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i
    from docs, (select distinct size from windows) where len(w) >= size)),
found as (select doc_id, item_id, p.size, i from places p join windows n on p.key = n.key and p.size = n.size),
hit as (select doc_id, count(distinct place) as n from (select doc_id, unnest(range(i, i + size)) as place from found)
        group by doc_id),
ids as (select doc_id, count(*) as n, string_agg(item_id, ',' order by item_id) as listed
        from (select distinct doc_id, item_id from found) group by doc_id)
select doc_id, len(w) as n_words, coalesce(hit.n, 0) as n_hit, coalesce(ids.n, 0) as n_items,
       sha256(coalesce(listed, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated
from docs left join hit using (doc_id) left join ids using (doc_id)
"""


@query("op1_decontaminate", _HITS_SQL)
def op1_decontaminate(spark, sf_dir):
    found = find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
