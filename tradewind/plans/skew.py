"""Look-ups that stay balanced when one key holds a large share of the rows."""

from contextvars import ContextVar
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

# A key named by more rows than this is spread over several tasks.
HOT_ROWS = 1_000_000
# At most this many keys can be hot, so their list may always be broadcast.
MOST_HOT_KEYS = 100_000
# Hash buckets of the cheap first check for hot keys.
BUCKETS = 65_536

# Rows of the batch that a change operator is working on. Its look-ups have no more, so that none of a batch up to
# HOT_ROWS can have a hot key, and the keys of a larger one are counted.
batch_rows: ContextVar[int | None] = ContextVar("batch_rows", default=None)


def look_up(requests: DataFrame, table: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS,
            from_batch: bool = False) -> DataFrame:
    """Requests with the columns of the table's row for their keys, NULL where there is none.

    The table must have one row per key. Unless it was made from the batch, it is first reduced to the keys that
    occur there: batches are small next to the tables, and AQE broadcasts a key list that it measures small.

    A change operator usually groups by the key it has looked up, so Spark keeps both in one task per key and
    does not split skewed ones. Therefore hot keys are found first. A key is hot
    from max(hot_rows, all rows / MOST_HOT_KEYS) rows on, which bounds the number of hot keys whatever the
    data. Their requests are spread by a salt and their table rows repeated per salt.
    """
    rows = table if from_batch else table.join(requests.select(*keys).distinct(), keys, "left_semi")
    known = batch_rows.get()
    if known is not None and known <= hot_rows:
        return requests.join(rows, keys, "left")
    # rows per hash bucket: a few numbers per map task, and never less than the rows of a key in the bucket
    buckets = requests.groupBy(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")).count()
    total, largest = buckets.agg(F.sum("count"), F.max("count")).first()
    if (largest or 0) <= hot_rows:
        return requests.join(rows, keys, "left")
    counts = requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    limit = max(hot_rows, total // MOST_HOT_KEYS)
    hot = F.broadcast(
        counts.filter(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / F.lit(limit)).cast("bigint").alias("_salts"))
    )
    spread = F.pmod(F.xxhash64("request_id"), F.coalesce("_salts", F.lit(1)))
    # a missing key matches nothing, so its requests may go anywhere
    nowhere = reduce(or_, [F.col(k).isNull() for k in keys])
    salt = F.when(nowhere, F.pmod(F.xxhash64("request_id"), F.lit(1000))).otherwise(spread)
    salted = requests.join(hot, keys, "left").withColumn("_salt", salt.cast("bigint")).drop("_salts")
    repeated = rows.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted.join(repeated, [*keys, "_salt"], "left").drop("_salt")


def merge_facts(keys: list[str], facts: dict[str, DataFrame]) -> DataFrame:
    """One row per key with one column per fact. Each DataFrame has the keys and the fact's column; of several
    values the smallest is kept."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts.values())
    return merged.groupBy(*keys).agg(*[F.min(name).alias(name) for name in facts])
