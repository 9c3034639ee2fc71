"""Pets and products as one item view, so that a line needs one join instead of two."""

from pyspark.sql import Column, DataFrame, functions as F

KINDS = {"pet": ("pets", "pet_id", "pet_name"), "product": ("products", "product_id", "product_name")}
ITEM_KEY = ["item_type", "item_id"]


def item_view(t: dict[str, DataFrame]) -> DataFrame:
    def of(kind: str) -> DataFrame:
        table, key, name = KINDS[kind]
        return t[table].select(
            F.lit(kind).alias("item_type"), F.col(key).alias("item_id"), F.col(name).alias("name"),
            "price", "stock", "image_url", "is_active", F.col("seller_id").alias("item_seller_id"),
        )

    return of("pet").unionByName(of("product"))


def item_id() -> Column:
    """The id that goes with item_type."""
    return F.when(F.col("item_type") == "pet", F.col("pet_id")).otherwise(F.col("product_id")).alias("item_id")
