"""Numbering rows in a given order without a single-partition sort."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpoint_dir

# monotonically_increasing_id() keeps the partition in the upper bits and the row in the lower 33.
_ROW_BITS = 33
_ROW_MASK = (1 << _ROW_BITS) - 1


def ordered_blocks(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds seq (rises with the given order) and block (the sort partition the row fell into).

    The order must be total. The result is checkpointed: the range bounds come from sampling, so a recomputed
    sort might number rows differently.
    """
    checkpoint_dir(df.sparkSession)
    return (
        df.orderBy(*order)
        .withColumn("seq", F.monotonically_increasing_id())
        .withColumn("block", F.shiftright("seq", _ROW_BITS).cast("int"))
        .checkpoint(eager=True)
    )


def dense_sequence(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds name = 1, 2, 3, ... over the whole DataFrame without a single-partition sort."""
    blocks = ordered_blocks(df, order)
    # one row per sort partition
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    start = F.sum("n").over(Window.orderBy("block")) - F.col("n")
    starts = sizes.select("block", start.alias("start"))
    position = F.col("start") + F.col("seq").bitwiseAND(F.lit(_ROW_MASK)) + 1
    return blocks.join(starts, "block").withColumn(name, position).drop("block", "seq", "start")
