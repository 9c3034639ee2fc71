"""Child rows as an array column of their parent."""

from pyspark.sql import Column, DataFrame, functions as F


def nest(lines: DataFrame, keys: list[str], element: list[Column | str], amount: str = "subtotal", placed: bool = False) -> DataFrame:
    """One row per parent: sorted items array, its length and its amount.

    A parent is always one row, whatever the number of its lines; whoever expects parents too large for one value
    reads the lines as rows instead. Collecting does not shrink anything before the shuffle, so the plain lines are
    shuffled and collected once behind it, instead of collecting in every map task and merging the pieces. Lines that
    come from a join on the keys lie there already (`placed`) and are not shuffled again.
    """
    return (lines if placed else lines.repartition(*keys)).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*element))).alias("items"),
        F.count(F.lit(1)).alias("item_count"),
        F.sum(amount).cast("decimal(22,2)").alias("items_total"),
    )


def attach(parents: DataFrame, nested: DataFrame, keys: list[str]) -> DataFrame:
    """Parents with their items; a parent without lines gets an empty array."""
    empty = F.array().cast(nested.schema["items"].dataType)
    return (
        parents.join(nested, keys, "left")
        .withColumn("items", F.coalesce("items", empty))
        .withColumn("item_count", F.coalesce("item_count", F.lit(0).cast("bigint")))
        .withColumn("items_total", F.coalesce("items_total", F.lit(0).cast("decimal(22,2)")))
    )
