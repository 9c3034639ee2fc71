"""Query of the quality classifier."""

from tradewind.llm.cotraining import score_quality
from tradewind.llm.registry import query, table


@query("op4_quality")
def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "p_quality", "p_toxic", "kept")
