"""Order status changes and payment updates."""

from pyspark.sql import Column, DataFrame, functions as F

from ... import schema
from ...functions import blank
from ...plans.requests import Change, ChangeSet, first_reason, last, named_in, one_row_per_request, split, touch
from ...plans.skew import look_up


@one_row_per_request
def set_order_status(t, requests: DataFrame, as_of: Column) -> Change:
    """Admins set any status; sellers any but pending, on orders that hold a line of theirs. The last one counts."""
    admin = F.col("actor_role") == "admin"
    allowed = F.when(admin, F.col("status").isin(schema.ORDER_STATUS)).otherwise(
        F.col("status").isin(schema.SELLER_ORDER_STATUS)
    )
    # (order, seller) pairs of the orders that are named, distinct before they are looked up
    owners = named_in(t["order_items"].select("order_id", F.col("seller_id").alias("actor_id")), requests, "order_id")
    owners = owners.distinct().withColumn("_owns", F.lit(True))
    known = t["orders"].select("order_id", F.lit(True).alias("_known"))
    judged = (
        look_up(look_up(requests, known, ["order_id"]), owners, ["order_id", "actor_id"], from_batch=True)
        .withColumn("reason", first_reason(
            (~F.coalesce(F.col("actor_role").isin("admin", "seller"), F.lit(False)), "forbidden"),
            (~F.coalesce(allowed, F.lit(False)), "bad_enum"),
            (~admin & F.col("_owns").isNull(), "forbidden"),
            (F.col("_known").isNull(), "not_found"),
        )).drop("_owns", "_known")
    )
    accepted, rejected = split(judged)
    final = accepted.groupBy("order_id").agg(last("status").alias("_status"))
    orders = touch(t["orders"].join(final, "order_id", "left"), F.col("_status").isNotNull(), as_of)
    changed = F.col("_status").isNotNull()
    orders = orders.withColumn("status", F.coalesce("_status", "status"))
    columns = t["orders"].columns
    return Change({"orders": orders.select(*columns)}, accepted, rejected, {"orders": ChangeSet(orders.filter(changed).select(*columns))})


def judge_payments(requests: DataFrame, payments: DataFrame) -> DataFrame:
    """Adds the reason and the order of the payment to payment updates."""
    known = payments.select("payment_id", "order_id")
    return look_up(requests, known, ["payment_id"]).withColumn("reason", first_reason(
        (~F.coalesce(F.col("status").isin(schema.PAYMENT_STATUS), F.lit(False)), "bad_enum"),
        (F.col("order_id").isNull(), "not_found"),
    ))


def payment_fold() -> list[Column]:
    """State of a payment after its accepted updates. Every part is a maximum, so neither the order in which
    updates arrive nor repeated updates change it."""
    reference = F.col("reference_no")
    return [
        last("status").alias("_status"),
        last("reference_no", ~blank(reference)).alias("_reference"),
        F.max("request_ts").alias("_last_ts"),
        F.bool_or(F.col("status") == "paid").alias("_was_paid"),
    ]


def merge_payments(t, folded: DataFrame, as_of: Column) -> tuple[dict[str, DataFrame], dict[str, ChangeSet]]:
    """New payments and orders from one folded row per payment, and the rows of both that changed."""
    joined = t["payments"].join(folded, "payment_id", "left")
    changed = F.col("_status").isNotNull()
    paid_at = F.when(changed & (F.col("_status") == "paid"), F.col("_last_ts")).when(~changed, F.col("paid_at"))
    merged = touch(joined, changed, as_of).withColumn("_written", changed).withColumns({
        "reference_no": F.coalesce("_reference", "reference_no"),
        "paid_at": paid_at,
        "status": F.coalesce("_status", "status"),
    })
    paid_orders = (
        t["payments"].select("payment_id", "order_id").join(folded.filter("_was_paid"), "payment_id")
        .select("order_id").distinct().withColumn("_paid", F.lit(True))
    )
    moves = F.coalesce("_paid", F.lit(False)) & (F.col("status") == "pending")
    orders = touch(t["orders"].join(paid_orders, "order_id", "left"), moves, as_of).withColumn("_moves", moves)
    orders = orders.withColumn("status", F.when(moves, F.lit("processing")).otherwise(F.col("status")))
    of = lambda df, table: df.select(*t[table].columns)
    sets = {"payments": ChangeSet(of(merged.filter("_written"), "payments")),
            "orders": ChangeSet(of(orders.filter(F.col("_paid").isNotNull() & F.col("_moves")), "orders"))}
    return {"payments": of(merged, "payments"), "orders": of(orders, "orders")}, sets


@one_row_per_request
def apply_payments(t, requests: DataFrame, as_of: Column) -> Change:
    """Payment updates: the last status holds, a missing reference keeps the old one, paid_at is the time of the
    last update if that one is paid. A pending order moves to processing if any accepted update was paid."""
    accepted, rejected = split(judge_payments(requests, t["payments"]))
    folded = accepted.groupBy("payment_id").agg(*payment_fold())
    tables, sets = merge_payments(t, folded, as_of)
    return Change(tables, accepted, rejected, sets)
