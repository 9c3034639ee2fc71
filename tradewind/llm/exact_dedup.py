"""Exact duplicates by progressive refinement: length, then a prefix hash, then the full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import bit_filter, stored, with_filter

PREFIX_CHARS = 128


def _length_and_prefix(text: Column) -> list[Column]:
    return [F.octet_length(text).alias("_len"), F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("_prefix")]


def progressive_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per input row: id, the `carry` columns, `keep_id`, `group_size`, `kept`.

    Texts are equal when their bytes are; NULL counts as the empty text. The row with the largest id of a
    group stays; of rows that repeat that id as well, one stays. A NULL id is smaller than any other. Rows
    with a length of their own, or a prefix of their own among those of that length, are unique and their
    full content is never hashed. Empty tables give an empty result. Only `carry` passes on input columns, so
    extra columns cannot clash; result names win over carried ones.

    The length and prefix stages move narrow rows. Their survivors become a bit set of 1 MB which the second
    scan applies before it hashes full contents: a bit set by chance costs a hash, never a wrong result. The
    last stage groups by (length, prefix hash, SHA-256) with counts that combine in the map tasks, so that a
    group with a third of all rows is one row per task.
    """
    carried = [c for c in carry or [] if c.lower() not in {id_col.lower(), "keep_id", "group_size", "kept"}]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    narrow = df.select(*_length_and_prefix(text))
    by_prefix = narrow.groupBy("_len", "_prefix").agg(F.count("*").alias("n"))
    # a length of which there is one row is settled before its prefix matters
    by_prefix = stored(by_prefix, "dedup-prefixes")
    lengths = by_prefix.groupBy("_len").agg(F.sum("n").alias("n")).filter("n > 1").select("_len")
    survivors = by_prefix.filter("n > 1").join(lengths, "_len", "left_semi").select("_len", "_prefix")
    group = F.xxhash64("_len", "_prefix")
    words = stored(bit_filter(survivors.select(group.alias("group"))), "dedup-filter")

    rows = df.select(
        F.col(f"`{id_col}`").alias("_id"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carried)],
        text.alias("_text"), *_length_and_prefix(text))
    rows = (with_filter(rows, words, group, "_shared").withColumn("_full", F.when(F.col("_shared"), F.sha2("_text", 256)))
            .drop("_text", "_shared").withColumn("_row", F.monotonically_increasing_id()))
    rows = stored(rows, "dedup-rows")

    key = ["_len", "_prefix", "_full"]
    groups = stored(
        rows.filter("_full is not null").groupBy(*key)
        .agg(F.count("*").alias("_size"), F.max(F.struct(F.col("_id"), F.col("_row"))).alias("_last")).filter("_size > 1"),
        "dedup-groups")
    out = rows.join(groups, key, "left")
    return out.select(
        F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carried)],
        F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_last._id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("_size").isNull() | (F.col("_last._row") == F.col("_row"))).alias("kept"))
