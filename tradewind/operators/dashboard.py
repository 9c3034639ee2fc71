"""Counts and totals of the administration start page."""

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema
from ..functions import newest_first
from ..functions.money import total_of
from ..plans.paging import Page, rows_with_parent


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def dashboard_users(t) -> DataFrame:
    """One row: active users, in total and per role."""
    return t["users"].filter("is_active").agg(
        F.count("role").alias("total"),
        *[_count_if(F.col("role") == role).alias(f"{role}s") for role in schema.ROLES],
    )


def dashboard_inventory(t) -> DataFrame:
    """Active pets and products, and how many are in stock (NULL when there are none)."""
    def of(table: str) -> DataFrame:
        return t[table].filter("is_active").agg(
            F.lit(table).alias("kind"),
            F.count(F.lit(1)).alias("total"),
            F.sum(F.when(F.col("stock") > 0, 1).otherwise(0)).cast("bigint").alias("available"),
        )

    return of("pets").unionByName(of("products"))


def dashboard_orders(t) -> DataFrame:
    """Orders per status, and a row 'total'."""
    per_status = t["orders"].groupBy("status").agg(F.count(F.lit(1)).alias("order_count"))
    # the counts per status are summed, so that both parts share one scan and one exchange
    total = per_status.agg(F.coalesce(F.sum("order_count"), F.lit(0)).cast("bigint").alias("order_count"))
    return per_status.unionByName(total.select(F.lit("total").alias("status"), "order_count"))


def dashboard_revenue(t) -> DataFrame:
    """One row: amount of all payments and of the paid ones."""
    return t["payments"].agg(
        total_of("amount").alias("total"),
        total_of(F.when(F.col("status") == "paid", F.col("amount"))).alias("paid"),
    )


def recent_orders(t, n: int = 10) -> DataFrame:
    """The latest n orders with the buyer's name; the top-k runs before the names are fetched."""
    buyers = t["users"].select(F.col("user_id").alias("buyer_id"), F.col("name").alias("buyer_name"))
    rows = t["orders"].select("order_id", "buyer_id", "status", "total_price", "created_at")
    latest = rows_with_parent(rows, buyers, "buyer_id", newest_first("order_id"), Page(1, n))
    return latest.join(buyers, "buyer_id").drop("buyer_id").orderBy(*newest_first("order_id"))
