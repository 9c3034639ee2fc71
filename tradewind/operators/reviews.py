"""Review feeds, keys of reviewed items, and what may still be reviewed."""

from pyspark.sql import DataFrame, functions as F

from ..functions import newest_first
from ..plans.paging import key_meta, page_per_key
from .items import KINDS, item_id


def _of_items(t, kind: str, ids) -> tuple[DataFrame, DataFrame]:
    """Reviews of the items whose reviewer is known, and the reviewers."""
    key = KINDS[kind][1]
    reviews = t["reviews"].filter(F.col(key).isNotNull())
    if ids is not None:
        reviews = reviews.filter(F.col(key).isin(list(ids)))
    reviewers = t["users"].select(
        F.col("user_id").alias("reviewer_id"), F.col("name").alias("reviewer_name"),
        F.col("avatar_url").alias("reviewer_avatar"),
    )
    return reviews.join(reviewers.select("reviewer_id"), "reviewer_id", "left_semi"), reviewers


def item_reviews(t, kind: str, page: int | None = 1, limit: int | None = None, ids=None) -> DataFrame:
    """The same page of every item's reviews, newest first, with the reviewer's name and avatar; page=None: all."""
    known, reviewers = _of_items(t, kind, ids)
    if page is not None:
        known = page_per_key(known, KINDS[kind][1], newest_first("review_id"), page, limit)
    return known.join(reviewers, "reviewer_id")


def item_reviews_meta(t, kind: str, page: int | None = 1, limit: int | None = None, ids=None) -> DataFrame:
    """Total and number of pages of every item's reviews; items without reviews are absent."""
    return key_meta(_of_items(t, kind, ids)[0], KINDS[kind][1], page, limit)


def reviewed_keys(t, reviewer=None) -> DataFrame:
    """Text key of each review: order:<order id>:pet:<id> or order:<order id>:product:<id>; a missing id reads null."""
    reviews = t["reviews"] if reviewer is None else t["reviews"].filter(F.col("reviewer_id") == F.lit(reviewer))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    tail = (
        F.when(F.col("item_type") == "pet", F.concat(F.lit(":pet:"), text("pet_id")))
        .otherwise(F.concat(F.lit(":product:"), text("product_id")))
    )
    return reviews.select("reviewer_id", F.concat(F.lit("order:"), text("order_id"), tail).alias("review_key"))


def delivered_lines(t) -> DataFrame:
    """(buyer, order, item) of delivered orders, each once."""
    delivered = t["orders"].filter(F.col("status") == "delivered").select("order_id", "buyer_id")
    lines = t["order_items"].select("order_id", "item_type", "pet_id", "product_id").distinct()
    return lines.join(delivered, "order_id")


def review_eligibility(t) -> DataFrame:
    """Delivered lines that their buyer has not reviewed yet, once per order and item."""
    written = t["reviews"].select(
        F.col("reviewer_id").alias("buyer_id"), "order_id", "item_type", item_id()
    ).distinct()
    open_lines = delivered_lines(t).withColumn("item_id", item_id())
    return open_lines.join(written, ["buyer_id", "order_id", "item_type", "item_id"], "left_anti")
