"""Queries of the duplicate operators: exact copies, common lines, repeated windows."""

from pyspark.sql import functions as F

from tradewind.llm.exact_dedup import progressive_dedup
from tradewind.llm.line_dedup import drop_common_lines
from tradewind.llm.registry import query, table
from tradewind.llm.repeated_windows import drop_repeated_windows

_EXACT_SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""

_LINES_SQL = r"""
with lines as (
  select doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents)),
common as (select key from lines where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (where key in (from common)) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where key not in (from common)), ''))
         as kept_sha256
from lines group by doc_id
"""


@query("op5_exact_dedup", _EXACT_SQL)
def op5_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return progressive_dedup(docs, carry=["text_sha256"])


@query("op9_line_dedup", _LINES_SQL)
def op9_line_dedup(spark, sf_dir):
    found = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op10_repeated_windows")
def op10_repeated_windows(spark, sf_dir):
    found = drop_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
