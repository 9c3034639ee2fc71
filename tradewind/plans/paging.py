"""Pages of one list, and the same page of many lists at once."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpoint_dir
from .sequence import dense_sequence

DEFAULT_LIMIT = 12
MAX_LIMIT = 100
# Beyond this many rows a top-k held by one task is replaced by a distributed numbering.
DEEP_PAGE = 100_000
# Up to this many rows the start of a list is kept and broadcast for look-ups.
NEAR_PAGE = 5_000
# Up to this rank, the rows that map-side pruning leaves per key are few enough for one task.
PRUNED_RANK = 100
SALTS = 64


class Page(NamedTuple):
    page: int
    limit: int

    @property
    def first(self) -> int:
        return (self.page - 1) * self.limit

    @property
    def last(self) -> int:
        return self.page * self.limit


def page_of(page: int | None = None, limit: int | None = None) -> Page:
    """Clamped page request: page >= 1, limit 1..100, zero or missing means the default."""
    return Page(max(1, page or 1), min(MAX_LIMIT, max(1, limit or DEFAULT_LIMIT)))


def take_page(df: DataFrame, order: list[Column], page: int | None = None, limit: int | None = None,
              deep_page: int = DEEP_PAGE) -> DataFrame:
    """Rows of one page. The order must end in a key."""
    wanted = page_of(page, limit)
    if wanted.last <= deep_page:
        return df.orderBy(*order).offset(wanted.first).limit(wanted.limit)
    return _numbered_page(df, order, wanted)


def _numbered_page(df: DataFrame, order: list[Column], wanted: Page) -> DataFrame:
    numbered = dense_sequence(df, order, "_position")
    return numbered.filter(F.col("_position").between(wanted.first + 1, wanted.last)).orderBy("_position").drop("_position")


def page_with_parent(df: DataFrame, parents: DataFrame, key: str, order: list[Column], page: int | None = None,
                     limit: int | None = None) -> DataFrame:
    """One page of the rows whose key is found in parents."""
    return rows_with_parent(df, parents, key, order, page_of(page, limit))


def rows_with_parent(df: DataFrame, parents: DataFrame, key: str, order: list[Column], wanted: Page) -> DataFrame:
    """One page of the rows whose key is found in parents, without joining all rows.

    The first offset+limit rows are taken with a top-k. If all of them have a parent, as a declared reference
    promises, the page is among them and nothing was shuffled. If one has none, the rows are joined after all.
    Everything broadcast here is bounded by the page.
    """
    if wanted.last <= NEAR_PAGE:
        checkpoint_dir(df.sparkSession)
        first = df.orderBy(*order).limit(wanted.last).checkpoint()
        keys = first.select(key).distinct()
        found = parents.select(key).join(F.broadcast(keys), key, "left_semi").distinct()
        if first.join(F.broadcast(found), key, "left_anti").isEmpty():
            return first.orderBy(*order).offset(wanted.first).limit(wanted.limit)
    known = df.join(parents.select(key), key, "left_semi")
    if wanted.last <= DEEP_PAGE:
        return known.orderBy(*order).offset(wanted.first).limit(wanted.limit)
    return _numbered_page(known, order, wanted)


def _meta(wanted: Page) -> list[Column]:
    pages = F.ceil(F.col("total") / F.lit(wanted.limit)).cast("bigint")
    return [F.col("total"), F.lit(wanted.page).alias("page"), F.lit(wanted.limit).alias("limit"), pages.alias("total_pages")]


def key_meta(df: DataFrame, key: str, page: int | None = None, limit: int | None = None) -> DataFrame:
    """Per key: total, page, limit, total_pages. Counted with map-side combine, without ranking the rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("total")).select(key, *_meta(page_of(page, limit)))


def page_meta(df: DataFrame, page: int | None = None, limit: int | None = None) -> DataFrame:
    """One row: total, page, limit, total_pages. A separate count, so that the page itself stays a top-k."""
    wanted = page_of(page, limit)
    return df.agg(F.count(F.lit(1)).alias("total")).select(*_meta(wanted))


def page_per_key(df: DataFrame, key: str | list[str], order: list[Column], page: int | None = None,
                 limit: int | None = None, pruned_rank: int = PRUNED_RANK) -> DataFrame:
    """The same page of every key's list.

    The rank filter lets Spark keep only the first offset+limit rows per key in each map task, so a key with
    most of the rows does not reach one task whole. For deeper pages rows are first ranked within (key, salt):
    the wanted rows are among the first offset+limit of every salt.
    """
    keys = [key] if isinstance(key, str) else key
    wanted = page_of(page, limit)
    if wanted.last > pruned_rank:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
        by_salt = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted.withColumn("_rank", F.row_number().over(by_salt))
            .filter(F.col("_rank") <= wanted.last)
            .drop("_rank", "_salt")
        )
    by_key = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(by_key)).filter(F.col("_rank") <= wanted.last)
    return ranked.filter(F.col("_rank") > wanted.first).drop("_rank")
