"""Seller and platform earnings. Lines are summed per order before they meet the orders."""

from pyspark.sql import DataFrame, functions as F

from .. import schema
from ..functions.money import TOTAL, platform_fee, seller_share, total_of
from .people import setting


def _order_sums(t, *keys: str, orders: DataFrame | None = None, orders_since=None) -> DataFrame:
    """Gross amount and lines per order (and seller): combined map-side, one row per group afterwards.

    With one row per order the later joins do not multiply rows and distinct orders become a plain count. Given
    `orders`, only their lines are read and summed: they meet on order_id, which the sums then need no exchange for.
    """
    lines = t["order_items"]
    if orders is not None and "month" in lines.columns:  # partition column of a written snapshot
        lines = lines.filter(F.col("month") >= orders_since) if orders_since is not None else lines
    lines = lines.select("order_id", *keys, "subtotal")
    if orders is not None:
        lines = lines.join(orders.select("order_id"), "order_id", "left_semi")
    return lines.groupBy("order_id", *keys).agg(
        F.sum("subtotal").cast(TOTAL).alias("gross"), F.count(F.lit(1)).alias("lines")
    )


def seller_stats_by_status(t) -> DataFrame:
    """Per seller and order status: gross amount and number of orders."""
    sums = _order_sums(t, "seller_id").join(t["orders"].select("order_id", "status"), "order_id")
    return sums.groupBy("seller_id", "status").agg(
        total_of("gross").alias("gross"), F.count(F.lit(1)).alias("order_count")
    )


def seller_stats(t) -> DataFrame:
    """Per seller: delivered and still running gross and net amounts, and all orders. Sellers without orders have zeros."""
    delivered = F.when(F.col("status") == "delivered", F.col("gross"))
    ongoing = F.when(F.col("status").isin(schema.ONGOING), F.col("gross"))
    stats = seller_stats_by_status(t).groupBy("seller_id").agg(
        total_of(delivered).alias("gross_delivered"),
        total_of(ongoing).alias("gross_on_going"),
        F.sum("order_count").cast("bigint").alias("total_orders"),
    )
    sellers = t["users"].filter(F.col("role") == "seller").select(F.col("user_id").alias("seller_id"))
    zero = F.lit(0).cast(TOTAL)
    percent = setting(t, "platform_fee_percent")
    return (
        sellers.join(stats, "seller_id", "left")
        .select(
            "seller_id",
            F.coalesce("gross_delivered", zero).alias("gross_delivered"),
            F.coalesce("gross_on_going", zero).alias("gross_on_going"),
            F.coalesce("total_orders", F.lit(0).cast("bigint")).alias("total_orders"),
        )
        .withColumn("fee_percent", percent)
        .withColumn("net_delivered", seller_share(F.col("gross_delivered"), percent))
        .withColumn("net_on_going", seller_share(F.col("gross_on_going"), percent))
    )


def earnings_by_status(t) -> DataFrame:
    """Per order status: order_count counts lines, distinct_orders counts orders; fee rounded per status."""
    sums = _order_sums(t).join(t["orders"].select("order_id", "status"), "order_id")
    return (
        sums.groupBy("status").agg(
            F.sum("lines").cast("bigint").alias("order_count"),
            F.count(F.lit(1)).alias("distinct_orders"),
            total_of("gross").alias("gross_subtotal"),
        )
        .withColumn("platform_fee", platform_fee(F.col("gross_subtotal"), setting(t, "platform_fee_percent")))
    )


def earnings_totals(t) -> DataFrame:
    """One row: fees of delivered and of running orders, as sums of the rounded fees per status."""
    status = F.col("status")
    return earnings_by_status(t).agg(
        total_of(F.when(status == "delivered", F.col("platform_fee"))).alias("total_fee_delivered"),
        F.coalesce(F.sum(F.when(status == "delivered", F.col("order_count"))), F.lit(0)).cast("bigint")
        .alias("total_orders_delivered"),
        total_of(F.when(status.isin(schema.ONGOING), F.col("platform_fee"))).alias("total_fee_on_going"),
    ).withColumn("fee_percent", setting(t, "platform_fee_percent")).withColumn(
        "shipping_cost", setting(t, "shipping_cost")
    )


def earnings_monthly(t, as_of: str) -> DataFrame:
    """Delivered orders of the 12 months before as_of, per month: orders and fee. Months without orders are absent."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 12 MONTHS")
    orders = t["orders"].filter((F.col("status") == "delivered") & (F.col("created_at") >= since))
    first = F.date_format(since, "yyyy-MM")
    if "month" in orders.columns:  # partition column of a written snapshot
        orders = orders.filter(F.col("month") >= first)
    orders = orders.select("order_id", F.date_format("created_at", "yyyy-MM").alias("month"))
    return (
        _order_sums(t, orders=orders, orders_since=first).join(orders, "order_id").groupBy("month").agg(
            F.count(F.lit(1)).alias("order_count"), total_of("gross").alias("gross_subtotal"),
        )
        .withColumn("platform_fee", platform_fee(F.col("gross_subtotal"), setting(t, "platform_fee_percent")))
    )
