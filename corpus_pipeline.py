"""The training-data pipeline: documents in, packed sequences out."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.common import bound_batches, stored
from tradewind.llm.cotraining import score_quality
from tradewind.llm.decontaminate import decontaminate
from tradewind.llm.line_dedup import drop_common_lines
from tradewind.llm.ngram_join import one_of_each
from tradewind.llm.packing import pack
from tradewind.llm.tokens import tokenizer_path


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """A stage in a session whose batches are bounded in bytes."""
    @wraps(function)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return function(spark, docs, sf_dir)

    return bounded


def _with_text(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """The columns of `docs` with another text and its length."""
    changed = {"text": F.col(text), "n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; the labels are the ones of the corpus."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels).filter("kept").select(*docs.columns)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many of them share. Copies are still there: they count as one document."""
    return _with_text(docs, drop_common_lines(docs, once_per_text=True), "kept_text")


@_stage
def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return one_of_each(docs)


@_stage
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those that are mostly such passages go."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _with_text(docs, found.filter("not dropped"), "clean_text")


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), drops_space=True, end_id=1)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("ngram_join", ngram_join),
          ("decontaminate", benchmark_passages), ("packing", packing)]
# A fitted classifier, a tokenizer and a packing have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
