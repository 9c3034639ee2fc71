"""Queries of the operators for personal data and secrets."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradewind.llm import personal_data, secret_scan
from tradewind.llm.registry import query, table


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: str, field: str, value: str) -> Column:
    return F.size(F.filter(spans, lambda s: s[field] == value)).cast("long").alias(f"n_{value}")


def _digest(found, spans: str, base_kinds: tuple[str, ...], *more: Column):
    base = F.filter(spans, lambda s: s["kind"].isin(*base_kinds))
    counts = [_count(spans, "kind", kind) for kind in base_kinds]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"),
                        _listed(F.col(spans)).alias("spans"), *more)


@query("op3_personal_data")
def op3_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _digest(personal_data.find_personal_data(docs, redacted=False), "pii_spans", personal_data.BASE_KINDS)


@query("op8_secret_scan")
def op8_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return _digest(secret_scan.find_secrets(docs), "secret_spans", secret_scan.BASE_KINDS,
                   *[_count("secret_spans", "verdict", v) for v in ("live", "example", "unclear")])
