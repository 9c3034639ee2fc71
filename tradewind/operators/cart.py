"""Cart contents, totals and the price quote of a checkout."""

from pyspark.sql import DataFrame, functions as F

from ..functions.money import TOTAL, platform_fee, total_of
from .items import ITEM_KEY, item_id, item_view
from .people import setting


def cart_contents(t) -> DataFrame:
    """Cart lines with the name, price, image, stock and seller of their item; inactive items stay in the cart."""
    items = item_view(t).drop("is_active").withColumnRenamed("item_seller_id", "seller_id")
    lines = t["cart_items"].withColumnRenamed("item_id", "line_id").withColumn("item_id", item_id())
    return (
        lines.join(items, ITEM_KEY, "left")
        .select("cart_id", F.col("line_id").alias("item_id"), "item_type", "quantity", "pet_id", "product_id",
                "name", "price", "image_url", "stock", "seller_id", "created_at")
    )


def line_amount():
    return (F.coalesce("price", F.lit(0).cast("decimal(12,2)")) * F.col("quantity")).cast(TOTAL)


def cart_totals(t) -> DataFrame:
    """Per cart: value and number of lines (not pieces). Carts without lines are kept."""
    totals = cart_contents(t).groupBy("cart_id").agg(
        F.sum(line_amount()).cast(TOTAL).alias("total_price"), F.count(F.lit(1)).alias("item_count")
    )
    return (
        t["cart"].join(totals, "cart_id", "left")
        .select("cart_id", "buyer_id",
                F.coalesce("total_price", F.lit(0).cast(TOTAL)).alias("total_price"),
                F.coalesce("item_count", F.lit(0).cast("bigint")).alias("item_count"))
    )


def priced(df: DataFrame, t) -> DataFrame:
    """Adds shipping, fee, payout and total to rows with a subtotal."""
    fee = platform_fee(F.col("subtotal"), setting(t, "platform_fee_percent"))
    return (
        df.withColumn("shipping_cost", setting(t, "shipping_cost"))
        .withColumn("platform_fee", fee)
        .withColumn("seller_payout", (F.col("subtotal") - F.col("platform_fee")).cast(TOTAL))
        .withColumn("total_price", (F.col("subtotal") + F.col("shipping_cost")).cast(TOTAL))
    )


def checkout_quote(t) -> DataFrame:
    """What each non-empty cart would cost now, and whether every line alone is in stock."""
    in_stock = F.coalesce(F.min((F.col("stock") >= F.col("quantity"))), F.lit(False))
    unknown = F.max(F.col("price").isNull().cast("int")) == 1
    carts = cart_contents(t).groupBy("cart_id").agg(
        total_of(line_amount()).alias("subtotal"),
        F.count(F.lit(1)).alias("item_count"),
        (in_stock & ~unknown).alias("all_in_stock"),
    )
    return priced(carts, t)
