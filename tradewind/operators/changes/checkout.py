"""Checkout of many carts at once, with the result of serving them one after the other."""

from pyspark.sql import Column, DataFrame, functions as F

from ... import schema
from ...functions import blank
from ...functions.money import MONEY, TOTAL
from ...plans.requests import Change, ChangeSet, first_reason, named_in, new_id, one_row_per_request, rejections, touch
from ...plans.sequence import ordered_blocks
from ...plans.serving import serve, short_of
from ...plans.skew import look_up, merge_facts
from ..cart import priced
from ..items import ITEM_KEY, KINDS, item_id, item_view
from ..people import setting
from .listings import breaks_rules


@one_row_per_request
def checkout(t, requests: DataFrame, as_of: Column) -> Change:
    """Turns carts, or the items named by a request, into orders, order lines and payments.

    Each request is all or nothing and they are served in batch order: an order takes its stock, a refused one
    takes none, and any accepted order empties its buyer's cart. Prices come from the catalogue. Only items
    named directly must be active; cart lines are not checked again. A request whose order is already there, from
    an earlier batch, is rejected as duplicate_request and takes nothing.
    """
    served = _not_yet_served(t, _prepare(requests))
    refused = served.filter("reason is not null")
    numbered = ordered_blocks(served.filter("reason is null").drop("reason"), [F.col("request_ts"), F.col("request_id")])
    sound, followers = _leaders(numbered.filter("doom is null").drop("doom"))
    lines = _lines(t, sound).checkpoint(eager=True)

    judged = _with_fixed_reason(t, sound, lines).checkpoint(eager=True)
    feasible = judged.filter("reason is null")
    accepted_ids = serve(feasible.select("request_id"), _demands(feasible, lines))

    decided = (
        judged.join(accepted_ids.withColumn("_accepted", F.lit(True)), "request_id", "left")
        .withColumn("_accepted", F.coalesce("_accepted", F.lit(False)))
    ).checkpoint(eager=True)
    accepted = decided.filter("_accepted")
    emptied = accepted.groupBy("actor_id").agg(F.min("seq").alias("_emptied"))
    lost = decided.filter("not _accepted")
    fates = merge_facts(["actor_id"], {
        "_emptied": emptied,
        "_leader_reason": lost.filter("not direct").select(
            "actor_id", F.coalesce("reason", F.lit("out_of_stock")).alias("_leader_reason")),
    })
    late = look_up(
        lost.select("request_id", "request_ts", "actor_id", "seq", "direct", "reason")
        .unionByName(followers.select("request_id", "request_ts", "actor_id", "seq", "direct"), allowMissingColumns=True),
        fates, ["actor_id"], from_batch=True,
    ).withColumn("reason", F.when(F.col("direct"), F.coalesce("reason", F.lit("out_of_stock")))
                 .when(F.col("_emptied") < F.col("seq"), F.lit("empty_cart")).otherwise(F.col("_leader_reason")))
    doomed = _doomed(t, numbered.filter("doom is not null"), accepted.select("request_id"), lines, emptied)
    rejected = rejections(refused).unionByName(rejections(late)).unionByName(rejections(doomed))

    sold = lines.join(accepted.select("request_id"), "request_id", "left_semi")
    orders = _new_orders(t, accepted, sold)
    added = {"orders": orders, "order_items": _new_order_items(sold), "payments": _new_payments(orders, accepted)}
    tables = {name: t[name].unionByName(rows, allowMissingColumns=True) for name, rows in added.items()}
    sets = {name: ChangeSet(rows) for name, rows in added.items()}
    emptied_carts = _emptied_carts(t, accepted)
    tables["cart_items"] = t["cart_items"].join(emptied_carts, "cart_id", "left_anti")
    sets["cart_items"] = ChangeSet(gone=t["cart_items"].join(emptied_carts, "cart_id", "left_semi").select("item_id"))
    for kind, (table, key, _) in KINDS.items():
        reduced = _reduced_stock(t[table], sold, kind, key, as_of)
        tables[table] = reduced.select(*t[table].columns)
        sets[table] = ChangeSet(reduced.filter(F.col("_sold").isNotNull()).select(*t[table].columns))
    return Change(tables, orders, rejected, sets)


def _not_yet_served(t, prepared: DataFrame) -> DataFrame:
    """Refuses requests whose order an earlier batch has written."""
    ids = prepared.withColumn("order_id", new_id("order", "request_id"))
    written = named_in(t["orders"].select("order_id"), ids, "order_id").withColumn("_written", F.lit(True))
    known = look_up(ids, written, ["order_id"], from_batch=True)
    reason = F.when(F.col("_written"), F.lit("duplicate_request")).otherwise(F.col("reason"))
    return known.withColumn("reason", reason).drop("order_id", "_written")


def _prepare(requests: DataFrame) -> DataFrame:
    for column in ("shipping_city", "shipping_postal", "notes", "payment_method"):
        if column not in requests.columns:
            requests = requests.withColumn(column, F.lit(None).cast("string"))
    if "items" not in requests.columns:
        requests = requests.withColumn(
            "items", F.lit(None).cast("array<struct<item_type:string,pet_id:string,product_id:string,quantity:int>>")
        )
    method = F.when(blank("payment_method"), F.lit("transfer")).otherwise(F.col("payment_method"))
    return (
        requests.withColumn("payment_method", method)
        .withColumn("direct", F.coalesce(F.size("items") > 0, F.lit(False)))
        .withColumn("reason", first_reason(
            (F.coalesce(F.col("actor_role") != "buyer", F.lit(True)), "forbidden"),
            (blank("shipping_address"), "missing_field"),
        ))
        # faults of the request itself that only show when the order, and then its payment, is written
        .withColumn("doom", first_reason(
            (breaks_rules("orders", ["shipping_city", "shipping_postal"]), "constraint"),
            (~F.col("payment_method").isin(schema.PAYMENT_METHODS), "bad_enum"),
        ))
    )


def _leaders(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests that compete, requests that cannot be accepted any more).

    Of a buyer's cart requests only the first can succeed: it either empties the cart, or fails for the stock,
    which never grows within a batch. So a buyer with many requests has the cart read once.
    """
    first = numbered.filter("not direct").groupBy("actor_id").agg(F.min("seq").alias("_first"))
    known = look_up(numbered, first, ["actor_id"], from_batch=True)
    follows = ~F.col("direct") & (F.col("seq") > F.col("_first"))
    marked = known.withColumn("_follows", F.coalesce(follows, F.lit(False))).drop("_first").checkpoint(eager=True)
    return marked.filter("not _follows").drop("_follows"), marked.filter("_follows").drop("_follows")


def _lines(t, sound: DataFrame) -> DataFrame:
    """What each request wants to buy, with price, stock and seller from the catalogue."""
    columns = ["request_id", "seq", "block", "direct", "line_key", "item_type", "pet_id", "product_id", "quantity"]
    named = (
        sound.filter("direct").select("request_id", "seq", "block", "direct", F.posexplode("items").alias("pos", "item"))
        .select("request_id", "seq", "block", "direct", F.col("pos").cast("string").alias("line_key"), "item.*")
        .select(*columns)
    )
    carted = (
        sound.filter("not direct").select("request_id", "seq", "block", "direct", F.col("actor_id").alias("buyer_id"))
        .join(t["cart"].select("buyer_id", "cart_id"), "buyer_id")
        .join(t["cart_items"].withColumnRenamed("item_id", "line_key"), "cart_id")
        .select(*columns)
    )
    items = item_view(t).drop("name", "image_url")
    return named.unionByName(carted).withColumn("item_id", item_id()).join(items, ITEM_KEY, "left")


def _with_fixed_reason(t, sound: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds the reasons that hold whatever the other requests do, since stock never grows within a batch."""
    per_item = lines.groupBy("request_id", *ITEM_KEY).agg(
        F.sum("quantity").alias("wanted"), F.min("quantity").alias("smallest"), F.max("stock").alias("stock"),
        F.sum(_wide_amount()).alias("amount"), F.max(_wide_amount()).alias("largest"),
        F.max(F.col("price").isNull() | (F.col("direct") & ~F.coalesce("is_active", F.lit(False)))).alias("unknown"),
    )
    per_request = per_item.groupBy("request_id").agg(
        F.max("unknown").alias("unknown"),
        F.max(F.col("wanted") > F.col("stock")).alias("short"),
        F.max(F.col("smallest").isNull() | (F.col("smallest") < 1)).alias("odd"),
        F.sum("amount").alias("amount"), F.max("largest").alias("largest"),
        F.count(F.lit(1)).alias("n"),
    )
    # what an order's or a line's money column takes; the fee is part of the subtotal
    most = F.lit(schema.MAX_MONEY).cast(_WIDE)
    total = F.col("amount") + F.coalesce(setting(t, "shipping_cost").cast(_WIDE), F.lit(0).cast(_WIDE))
    too_large = F.coalesce((F.col("largest") > most) | (total > most), F.lit(False))
    return sound.join(per_request, "request_id", "left").withColumn("reason", first_reason(
        (F.col("n").isNull(), "empty_cart"),
        (F.col("unknown"), "not_found"),
        (F.col("short"), "out_of_stock"),
        (F.col("odd") | too_large, "constraint"),
    )).drop("unknown", "short", "odd", "n", "amount", "largest")


def _doomed(t, doomed: DataFrame, accepted: DataFrame, lines: DataFrame, emptied: DataFrame) -> DataFrame:
    """Requests that cannot be written, with the reason that a one-by-one service comes to first.

    They take nothing, so they need not compete; what they find depends on the orders accepted before them.
    """
    if doomed.isEmpty():
        return doomed.withColumn("reason", F.col("doom"))
    wishes = _lines(t, doomed).checkpoint(eager=True)
    judged = _with_fixed_reason(t, doomed, wishes)
    need = lambda rows: rows.groupBy("request_id", "seq", "block", F.concat_ws(":", *ITEM_KEY).alias("resource")).agg(
        F.sum("quantity").alias("need"), F.max("stock").cast("bigint").alias("capacity"))
    short = short_of(need(wishes), need(lines.join(accepted, "request_id", "left_semi"))).withColumn("_short", F.lit(True))
    known = look_up(judged.join(short, "request_id", "left"), emptied, ["actor_id"], from_batch=True)
    early = F.col("reason").isin("empty_cart", "not_found")
    return known.withColumn("reason", first_reason(
        (~F.col("direct") & (F.col("_emptied") < F.col("seq")), "empty_cart"),
        (F.coalesce(early & (F.col("reason") == "empty_cart"), F.lit(False)), "empty_cart"),
        (F.coalesce(early, F.lit(False)), "not_found"),
        (F.col("_short") | (F.col("reason") == "out_of_stock"), "out_of_stock"),
        (F.col("reason").isNotNull() | (F.col("doom") == "constraint"), "constraint"),
        (F.col("doom").isNotNull(), "bad_enum"),
    ))


def _demands(feasible: DataFrame, lines: DataFrame) -> DataFrame:
    """What requests compete for: pieces of an item, and the one filling of a buyer's cart.

    A request that names its items takes the cart's filling too, but does not need it: that demand is soft.
    """
    pieces = (
        lines.join(feasible.select("request_id"), "request_id", "left_semi")
        .groupBy("request_id", "seq", "block", F.concat_ws(":", *ITEM_KEY).alias("resource"))
        .agg(F.sum("quantity").alias("need"), F.max("stock").cast("bigint").alias("capacity"))
        .withColumn("soft", F.lit(False))
    )
    fillings = feasible.select(
        "request_id", "seq", "block", F.concat(F.lit("cart:"), "actor_id").alias("resource"),
        F.lit(1).cast("bigint").alias("need"), F.lit(1).cast("bigint").alias("capacity"), F.col("direct").alias("soft"),
    )
    return pieces.unionByName(fillings)


_WIDE = "decimal(38,2)"


def _wide_amount() -> Column:
    """Price times quantity in a type that no catalogue price and quantity overflow."""
    return F.col("price").cast("decimal(20,2)") * F.col("quantity").cast("decimal(12,0)")


def _amount() -> Column:
    return (F.col("price") * F.col("quantity")).cast(TOTAL)


def _new_orders(t, accepted: DataFrame, sold: DataFrame) -> DataFrame:
    sums = sold.groupBy("request_id").agg(F.sum(_amount()).cast(TOTAL).alias("subtotal"))
    optional = lambda c: F.when(~blank(c), F.col(c)).alias(c)
    return priced(accepted.join(sums, "request_id"), t).select(
        new_id("order", "request_id").alias("order_id"), F.col("actor_id").alias("buyer_id"),
        F.lit("pending").alias("status"), F.col("total_price").cast(MONEY).alias("total_price"), "shipping_cost",
        F.col("platform_fee").cast(MONEY).alias("platform_fee"),
        F.col("seller_payout").cast(MONEY).alias("seller_payout"),
        "shipping_address", optional("shipping_city"), optional("shipping_postal"), optional("notes"),
        F.col("request_ts").alias("created_at"), F.col("request_ts").alias("updated_at"),
    )


def _new_order_items(sold: DataFrame) -> DataFrame:
    return sold.select(
        new_id("order_item", "request_id", "line_key").alias("order_item_id"),
        new_id("order", "request_id").alias("order_id"), "item_type", "pet_id", "product_id",
        F.col("item_seller_id").alias("seller_id"), F.col("quantity").cast("int").alias("quantity"),
        F.col("price").alias("unit_price"), _amount().cast(MONEY).alias("subtotal"),
    )


def _new_payments(orders: DataFrame, accepted: DataFrame) -> DataFrame:
    methods = accepted.select(
        new_id("order", "request_id").alias("order_id"), new_id("payment", "request_id").alias("payment_id"),
        F.col("payment_method").alias("method"),
    )
    return orders.select("order_id", F.col("total_price").alias("amount"), "created_at", "updated_at").join(
        methods, "order_id"
    ).withColumn("status", F.lit("unpaid"))


def _emptied_carts(t, accepted: DataFrame) -> DataFrame:
    return t["cart"].join(accepted.select(F.col("actor_id").alias("buyer_id")), "buyer_id", "left_semi").select("cart_id")


def _reduced_stock(items: DataFrame, sold: DataFrame, kind: str, key: str, as_of: Column) -> DataFrame:
    """Items with `_sold`, NULL for those of which nothing was sold."""
    pieces = (
        sold.filter(F.col("item_type") == kind).groupBy(F.col("item_id").alias(key))
        .agg(F.sum("quantity").cast("int").alias("_sold"))
    )
    joined = touch(items.join(pieces, key, "left"), F.col("_sold").isNotNull(), as_of)
    left = (F.col("stock") - F.coalesce("_sold", F.lit(0))).cast("int")
    return joined.withColumn("stock", left)
