"""Judging a batch of requests and folding it per key."""

import inspect
from collections.abc import Callable
from functools import reduce, wraps
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordering import request_order
from ..session import checkpoint_dir, held
from .skew import batch_rows


class ChangeSet(NamedTuple):
    """What a batch does to one table: whole rows that are new or replace those with their key, and keys that go."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None


class Change(NamedTuple):
    """Result of a change operator: new tables by name, accepted requests, rejected requests with a reason.

    `sets` has the same change as rows and keys by table, which `merge_snapshot` writes where they belong.
    """

    tables: dict[str, DataFrame]
    accepted: DataFrame
    rejected: DataFrame
    sets: dict[str, ChangeSet] = {}


def once(requests: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(one row per request_id, rejections of the others), read from the work folder so that the batch is run once.

    A client's retry or a file delivered twice repeats an id. The earliest row by time counts, then the smallest by
    its columns in the order of their names, a missing value before any other. Ids that occur once, nearly always all
    of them, are found by counts that combine in the map tasks.
    """
    return _counted_once(requests)[:2]


def _counted_once(requests: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """`once`, with the number of rows."""
    checkpoint_dir(requests.sparkSession)
    batch = held(requests.withColumn("_row", F.monotonically_increasing_id()), "batch")
    ids = batch.groupBy("request_id").agg(F.count(F.lit(1)).alias("_copies"))
    twice = (F.col("_copies") > 1) & F.col("request_id").isNotNull()
    rows, repeated = ids.agg(F.sum("_copies"), F.count(F.when(twice, 1))).first()
    if not repeated:
        return batch.drop("_row"), None, rows or 0
    rest = sorted(c for c in requests.columns if c not in ("request_id", "request_ts"))
    first = F.min(F.struct("request_ts", *[F.col(f"`{c}`") for c in rest], "_row")).getField("_row")
    copies = batch.join(ids.filter(twice).select("request_id"), "request_id", "left_semi")
    firsts = copies.groupBy("request_id").agg(first.alias("_first"))
    later = F.coalesce(F.col("_row") != F.col("_first"), F.lit(False))
    marked = batch.join(firsts, "request_id", "left").withColumn("_later", later).select(*requests.columns, "_later")
    marked = held(marked, "batch")
    extra = marked.filter("_later").withColumn("reason", F.lit("duplicate_request"))
    return marked.filter("not _later").drop("_later"), rejections(extra), rows


def one_row_per_request(operator: Callable[..., Change]) -> Callable[..., Change]:
    """A change operator that gets its `requests` from `once`, and lists the repeated ones as rejected."""
    signature = inspect.signature(operator)

    @wraps(operator)
    def run(*args, **named) -> Change:
        bound = signature.bind(*args, **named)
        bound.arguments["requests"], repeated, rows = _counted_once(bound.arguments["requests"])
        before = batch_rows.set(rows)
        try:
            change = operator(*bound.args, **bound.kwargs)
        finally:
            batch_rows.reset(before)
        return change if repeated is None else change._replace(rejected=change.rejected.unionByName(repeated))

    return run


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Reason of the first check that holds, NULL when none does. A check that is NULL does not hold."""
    (condition, reason), *rest = checks
    return reduce(lambda chain, check: chain.when(check[0], F.lit(check[1])), rest, F.when(condition, F.lit(reason)))


def split(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of a DataFrame with a reason column."""
    accepted = judged.filter(F.col("reason").isNull()).drop("reason")
    return accepted, rejections(judged.filter(F.col("reason").isNotNull()))


def rejections(judged: DataFrame) -> DataFrame:
    return judged.select("request_id", "request_ts", "reason")


def last(column: Column | str, given: Column | None = None) -> Column:
    """Value of the latest request, of those where given holds. Combines map-side, so hot keys are safe."""
    order = request_order()
    return F.max_by(column, order if given is None else F.when(given, order))


def last_given(column: str) -> Column:
    """Latest value that is not NULL."""
    return last(column, F.col(column).isNotNull())


def named_in(table: DataFrame, requests: DataFrame, *keys: str) -> DataFrame:
    """Rows of a table whose key some request names. Batches are small next to the tables: the semi join lets AQE
    broadcast the measured-small key list instead of shuffling the table for the look-ups that follow."""
    return table.join(requests.select(*keys).distinct(), list(keys), "left_semi")


def new_id(kind: str, *parts: Column | str) -> Column:
    """Repeatable id: a recomputed task gives the same one."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws(":", F.lit(kind), *[c.cast("string") for c in columns]), 256)


def touch(df: DataFrame, changed: Column, as_of: Column) -> DataFrame:
    """Sets updated_at of the changed rows."""
    return df.withColumn("updated_at", F.when(changed, as_of).otherwise(F.col("updated_at")))
