"""Listings of pets and products, their ratings, and categories."""

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema
from ..functions import contains, newest_first
from ..plans.paging import key_meta, page_meta, page_per_key, page_with_parent
from .items import KINDS


@dataclass(frozen=True)
class ItemFilters:
    """Only the filters that are given take part; text filters are case-insensitive 'contains'."""

    search: str | None = None
    seller_id: object = None
    min_price: object = None
    max_price: object = None
    category_id: int | None = None
    species: str | None = None
    breed: str | None = None
    gender: str | None = None

    def conditions(self, kind: str) -> list[Column]:
        name = KINDS[kind][2]
        schema.require_allowed(self.gender or None, schema.GENDERS, "gender")
        found = []
        for column, needle in ((name, self.search), ("species", self.species), ("breed", self.breed)):
            if needle:
                found.append(contains(column, needle))
        for column, value in (("seller_id", self.seller_id), ("category_id", self.category_id),
                              ("gender", self.gender)):
            if value not in (None, ""):
                found.append(F.col(column) == F.lit(value))
        if self.min_price not in (None, ""):
            found.append(F.col("price") >= F.lit(self.min_price))
        if self.max_price not in (None, ""):
            found.append(F.col("price") <= F.lit(self.max_price))
        return found


def item_order(sort: str | None, key: str) -> list[Column]:
    """Order of a listing; an unknown name means newest first."""
    choices = {
        "price_asc": [F.col("price").asc_nulls_last(), F.col(key)],
        "price_desc": [F.col("price").desc_nulls_first(), F.col(key)],
        "rating": [F.col("avg_rating").desc_nulls_last(), F.col(key)],
    }
    return choices.get(sort, newest_first(key))


def rating_summary(reviews: DataFrame, kind: str) -> DataFrame:
    """Average rating (one decimal, halves away from zero) and review count per item."""
    key = KINDS[kind][1]
    average = F.round(F.avg(F.col("rating").cast("decimal(12,2)")), 1).cast("decimal(12,1)")
    return (
        reviews.filter(F.col(key).isNotNull()).groupBy(key)
        .agg(average.alias("avg_rating"), F.count(F.lit(1)).alias("review_count"))
    )


def _active(t: dict[str, DataFrame], kind: str, filters: ItemFilters | None = None) -> DataFrame:
    conditions = (filters or ItemFilters()).conditions(kind)
    return t[KINDS[kind][0]].filter(reduce(and_, conditions, F.col("is_active")))


def _seller(t: dict[str, DataFrame], *columns: str) -> DataFrame:
    names = {"name": "seller_name", "avatar_url": "seller_avatar", "phone": "seller_phone"}
    return t["users"].select(F.col("user_id").alias("seller_id"), *[F.col(c).alias(names[c]) for c in columns])


def _add_category(items: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    categories = t["categories"].select(
        "category_id", F.col("name").alias("category_name"), F.col("icon").alias("category_icon")
    )
    return items.join(categories, "category_id", "left")


def _add_rating(items: DataFrame, reviews: DataFrame, kind: str) -> DataFrame:
    """Reviews are reduced to one row per item before the join, so items are never multiplied."""
    return (
        items.join(rating_summary(reviews, kind), KINDS[kind][1], "left")
        .withColumn("review_count", F.coalesce("review_count", F.lit(0).cast("bigint")))
    )


_RATING = ["avg_rating", "review_count"]


def _listing(t, kind, filters, sort, page, limit, seller_columns=("name",)) -> DataFrame:
    key = KINDS[kind][1]
    items = _active(t, kind, filters)
    sellers = _seller(t, *seller_columns)

    def decorate(chosen: DataFrame, reviews: DataFrame) -> DataFrame:
        chosen = chosen.join(sellers, "seller_id")
        if kind == "product":
            chosen = _add_category(chosen, t)
        return _add_rating(chosen, reviews, kind)

    if page is None:
        return decorate(items, t["reviews"])
    order = item_order(sort, key)
    if sort == "rating":
        # the page is chosen on key, seller and rating; only its rows are fetched whole
        rated = _add_rating(items.select(key, "seller_id"), t["reviews"], kind)
        best = page_with_parent(rated, sellers, "seller_id", order, page, limit).select(key, *_RATING)
        chosen = items.join(F.broadcast(best), key).join(sellers, "seller_id")
        return (_add_category(chosen, t) if kind == "product" else chosen).orderBy(*order)
    # The order does not need ratings: choose the page first, then read only its sellers and reviews.
    # A page holds at most 100 rows, so it may be broadcast.
    chosen = page_with_parent(items, sellers, "seller_id", order, page, limit)
    its_reviews = t["reviews"].join(F.broadcast(chosen.select(key)), key, "left_semi")
    return decorate(F.broadcast(chosen), its_reviews).orderBy(*order)


def list_products(t, filters: ItemFilters | None = None, sort: str | None = None, page: int | None = 1,
                  limit: int | None = None) -> DataFrame:
    """Active products with category, seller and rating. page=None gives the whole list."""
    return _listing(t, "product", filters, sort, page, limit)


def list_pets(t, filters: ItemFilters | None = None, sort: str | None = None, page: int | None = 1,
              limit: int | None = None) -> DataFrame:
    return _listing(t, "pet", filters, sort, page, limit)


def _list_meta(t, kind, filters, page, limit) -> DataFrame:
    """Ratings and categories do not change the number of rows, so they are not read."""
    items = _active(t, kind, filters)
    return page_meta(items.join(_seller(t), "seller_id", "left_semi"), page, limit)


def list_products_meta(t, filters: ItemFilters | None = None, page: int | None = 1, limit: int | None = None) -> DataFrame:
    """Total and number of pages of list_products, and of admin_products."""
    return _list_meta(t, "product", filters, page, limit)


def list_pets_meta(t, filters: ItemFilters | None = None, page: int | None = 1, limit: int | None = None) -> DataFrame:
    return _list_meta(t, "pet", filters, page, limit)


def _detail(t, kind, ids) -> DataFrame:
    key = KINDS[kind][1]
    chosen = dict(t)
    if ids is not None:
        table = KINDS[kind][0]
        chosen[table] = t[table].filter(F.col(key).isin(list(ids)))
        chosen["reviews"] = t["reviews"].filter(F.col(key).isin(list(ids)))
    return _listing(chosen, kind, None, None, None, None, ("name", "avatar_url", "phone"))


def product_detail(t, ids=None) -> DataFrame:
    """Listing columns plus the seller's avatar and phone, active products only."""
    return _detail(t, "product", ids)


def pet_detail(t, ids=None) -> DataFrame:
    return _detail(t, "pet", ids)


def _of_seller(t, kind, page, limit, seller) -> DataFrame:
    key = KINDS[kind][1]
    items = _active(t, kind, ItemFilters(seller_id=seller))
    chosen = items if page is None else page_per_key(items, "seller_id", newest_first(key), page, limit)
    if kind == "product":
        chosen = _add_category(chosen, t)
    return _add_rating(chosen, t["reviews"], kind)


def seller_products(t, page: int | None = 1, limit: int | None = None, seller=None) -> DataFrame:
    """The same page of every seller's active products, newest first."""
    return _of_seller(t, "product", page, limit, seller)


def seller_pets(t, page: int | None = 1, limit: int | None = None, seller=None) -> DataFrame:
    return _of_seller(t, "pet", page, limit, seller)


def seller_products_meta(t, page: int | None = 1, limit: int | None = None, seller=None) -> DataFrame:
    """Total and number of pages of every seller's active products; sellers without any are absent."""
    return key_meta(_active(t, "product", ItemFilters(seller_id=seller)), "seller_id", page, limit)


def seller_pets_meta(t, page: int | None = 1, limit: int | None = None, seller=None) -> DataFrame:
    return key_meta(_active(t, "pet", ItemFilters(seller_id=seller)), "seller_id", page, limit)


def _administration(t, kind, filters, page, limit) -> DataFrame:
    items = _active(t, kind, filters)
    sellers = _seller(t, "name")
    order = newest_first(KINDS[kind][1])
    if page is not None:
        items = F.broadcast(page_with_parent(items, sellers, "seller_id", order, page, limit))
    rows = items.join(sellers, "seller_id")
    rows = _add_category(rows, t) if kind == "product" else rows
    return rows if page is None else rows.orderBy(*order)


def admin_products(t, filters: ItemFilters | None = None, page: int | None = 1,
                   limit: int | None = None) -> DataFrame:
    """Active products of all sellers, newest first, without ratings."""
    return _administration(t, "product", filters, page, limit)


def admin_pets(t, filters: ItemFilters | None = None, page: int | None = 1, limit: int | None = None) -> DataFrame:
    return _administration(t, "pet", filters, page, limit)


def category_counts(t) -> DataFrame:
    """All categories with their number of active products; products are counted before the join."""
    counts = (
        t["products"].filter(F.col("is_active") & F.col("category_id").isNotNull())
        .groupBy("category_id").agg(F.count(F.lit(1)).alias("product_count"))
    )
    return t["categories"].join(counts, "category_id", "left").withColumn(
        "product_count", F.coalesce("product_count", F.lit(0).cast("bigint"))
    )
