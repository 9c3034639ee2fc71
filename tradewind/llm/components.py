"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the smallest of its neighbourhood."""
    both = stored(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "star-edges")
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them."""
    down = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star-edges")
    least = stored(down.groupBy("u").agg(F.min("v").alias("m")), "star-least")
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """`node`, `root` for every node of the edges (u, v); the root is the smallest node of its component.

    A round keeps at most as many edges as nodes and edges before; the number of rounds grows with the logarithm
    of the longest path. A node with very many neighbours is reduced by a partial minimum, and its rows are split
    by the adaptive join. Rounds are cut by tables in the shared folder. No edges give no rows.
    """
    edges = stored(edges.filter("u != v").select("u", "v"), "star-start")
    state = _state(edges)
    while True:
        edges = stored(_small_star(stored(_large_star(edges), "star-large")), "star-small")
        if (now := _state(edges)) == state:
            break
        state = now
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
