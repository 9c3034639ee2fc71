"""Adding to and editing carts."""

from pyspark.sql import DataFrame, functions as F

from ... import schema
from ...functions.ordering import request_order
from ...plans.requests import Change, ChangeSet, first_reason, last, new_id, one_row_per_request, split
from ...plans.sequence import ordered_blocks
from ...plans.serving import serve
from ...plans.skew import look_up
from ...session import held
from ..items import ITEM_KEY, item_id, item_view


@one_row_per_request
def add_to_cart(t, requests: DataFrame) -> Change:
    """Adds quantities of items to the buyers' carts, creating carts and lines where they are missing.

    Stock is compared with the single request, not with what the cart already holds, so accepted requests for a
    line simply add up. A quantity below 1 is refused.
    """
    typed = (
        requests.withColumn("quantity", F.coalesce("quantity", F.lit(1)))
        .withColumn("item_id", item_id())
    )
    items = item_view(t).select(*ITEM_KEY, "stock", "is_active")
    both = F.col("pet_id").isNotNull() & F.col("product_id").isNotNull()
    judged = look_up(typed, items, ITEM_KEY).withColumn("reason", first_reason(
        (F.coalesce(F.col("actor_role") != "buyer", F.lit(True)), "forbidden"),
        (~F.coalesce(F.col("item_type").isin(schema.ITEM_TYPES), F.lit(False)), "bad_enum"),
        (F.col("item_id").isNull(), "missing_field"),
        (~F.coalesce("is_active", F.lit(False)), "not_found"),
        (F.col("stock") < F.col("quantity"), "out_of_stock"),
        ((F.col("quantity") < 1) | both, "constraint"),
    )).drop("stock", "is_active")
    # read by the sums below, by the rejected requests and by each table's new rows
    judged = _within_int(t, held(judged, "judged"))
    accepted, rejected = split(judged)

    # one row per buyer and item, summed map-side, before anything is joined
    added = accepted.groupBy(F.col("actor_id").alias("buyer_id"), *ITEM_KEY).agg(
        F.sum("quantity").cast("int").alias("added"), F.min(request_order()).alias("first"),
        F.max("pet_id").alias("pet_id"), F.max("product_id").alias("product_id"),
    )
    owners = t["cart"].select("buyer_id", "cart_id")
    placed = held(added.join(owners, "buyer_id", "left").withColumn(
        "cart_id", F.coalesce("cart_id", new_id("cart", "buyer_id"))
    ), "placed")
    new_carts = (
        accepted.groupBy(F.col("actor_id").alias("buyer_id")).agg(F.min("request_ts").alias("created_at"))
        .join(owners, "buyer_id", "left_anti")
        .select(new_id("cart", "buyer_id").alias("cart_id"), "buyer_id", "created_at",
                F.col("created_at").alias("updated_at"))
    )
    lines = t["cart_items"]
    existing = lines.withColumnRenamed("item_id", "line_id").withColumn("item_id", item_id())
    keys = ["cart_id", *ITEM_KEY]
    both_lines = existing.join(placed.select(*keys, "added"), keys, "left")
    line = [F.col("line_id").alias("item_id"), "cart_id", "item_type", "pet_id", "product_id",
            (F.col("quantity") + F.coalesce("added", F.lit(0))).alias("quantity"), "created_at"]
    merged, grown = both_lines.select(*line), both_lines.filter(F.col("added").isNotNull()).select(*line)
    new_lines = placed.join(existing.select(*keys), keys, "left_anti").select(
        new_id("line", "cart_id", "item_type", "item_id").alias("item_id"),
        "cart_id", "item_type", "pet_id", "product_id", F.col("added").alias("quantity"),
        F.col("first.request_ts").alias("created_at"),
    )
    tables = {
        "cart": t["cart"].unionByName(new_carts, allowMissingColumns=True),
        "cart_items": merged.unionByName(new_lines),
    }
    return Change(tables, accepted, rejected, {"cart": ChangeSet(new_carts), "cart_items": ChangeSet(grown.unionByName(new_lines))})


def _within_int(t, judged: DataFrame) -> DataFrame:
    """Refuses, in batch order, requests that would take a line beyond the largest quantity.

    Lines whose accepted requests fit together, in practice all, are settled by one sum. Of the others each request is
    served while it fits; one that does not takes nothing, as a failed insert does.
    """
    keys = ["actor_id", *ITEM_KEY]
    held = (
        t["cart_items"].withColumn("item_id", item_id()).join(t["cart"].select("cart_id", "buyer_id"), "cart_id")
        .groupBy(F.col("buyer_id").alias("actor_id"), *ITEM_KEY).agg(F.sum("quantity").alias("_held"))
    )
    sums = judged.filter("reason is null").groupBy(*keys).agg(F.sum("quantity").alias("_wanted"), F.count(F.lit(1)).alias("_n"))
    over = (
        sums.join(held.join(sums.select(*keys), keys, "left_semi"), keys, "left")
        .withColumn("_held", F.coalesce("_held", F.lit(0)))
        .filter(F.col("_held") + F.col("_wanted") > schema.MAX_INT).select(*keys, "_held").checkpoint()
    )
    if over.isEmpty():
        return judged
    competing = judged.filter("reason is null").join(over, keys)
    order = [F.col("request_ts"), F.col("request_id")]
    demands = ordered_blocks(competing, order).select(
        "request_id", "seq", "block", F.concat_ws(":", *keys).alias("resource"), F.col("quantity").cast("bigint").alias("need"),
        (F.lit(schema.MAX_INT) - F.col("_held")).cast("bigint").alias("capacity"), F.lit(False).alias("soft"))
    served = serve(competing.select("request_id"), demands).withColumn("_served", F.lit(True))
    lost = competing.select("request_id").join(served, "request_id", "left_anti").withColumn("_lost", F.lit(True)).checkpoint()
    refused = F.coalesce(F.col("reason"), F.when(F.col("_lost"), F.lit("constraint")))
    return judged.join(lost, "request_id", "left").withColumn("reason", refused).drop("_lost")


@one_row_per_request
def edit_cart(t, requests: DataFrame) -> Change:
    """Set a line's quantity, remove a line, or clear the cart; a buyer without a cart gets an empty one.

    In batch order: a line is gone from its first removal or from the first clearing of its cart on, and later
    requests for it are not_found; before that the last quantity holds. Both limits are map-side minima.
    """
    ordered = look_up(
        requests.withColumn("_order", request_order()),
        t["cart"].select(F.col("buyer_id").alias("actor_id"), "cart_id"), ["actor_id"],
    )
    op = F.col("op")
    # whatever a buyer asks of a cart, one is made if there is none
    new_carts = (
        ordered.filter((F.col("actor_role") == "buyer") & F.col("actor_id").isNotNull() & F.col("cart_id").isNull())
        .groupBy(F.col("actor_id").alias("buyer_id")).agg(F.min("request_ts").alias("created_at"))
        .select(new_id("cart", "buyer_id").alias("cart_id"), "buyer_id", "created_at", F.col("created_at").alias("updated_at"))
    )
    ordered = ordered.withColumn("reason", first_reason(
        (F.coalesce(F.col("actor_role") != "buyer", F.lit(True)), "forbidden"),
        (~F.coalesce(op.isin("set", "remove", "clear"), F.lit(False)), "bad_enum"),
        ((op == "set") & (F.col("quantity").isNull() | (F.col("quantity") < 1)), "out_of_range"),
    ))
    lines = t["cart_items"].select("item_id", F.col("cart_id").alias("line_cart"))
    sound = look_up(ordered.filter("reason is null"), lines, ["item_id"])
    in_cart = F.coalesce(F.col("line_cart") == F.col("cart_id"), F.lit(False))
    removed = (
        sound.filter((op == "remove") & in_cart).groupBy("item_id").agg(F.min("_order").alias("_removed"))
    )
    cleared = (
        ordered.filter((op == "clear") & F.col("reason").isNull()).groupBy("cart_id")
        .agg(F.min("_order").alias("_cleared"))
    )
    limits = look_up(look_up(sound, removed, ["item_id"], from_batch=True), cleared, ["cart_id"], from_batch=True)
    too_late = (
        (F.col("_order") > F.coalesce("_removed", "_order")) | (F.col("_order") > F.coalesce("_cleared", "_order"))
    )
    judged = limits.withColumn("reason", first_reason(((op != "clear") & (~in_cart | too_late), "not_found")))
    kept = [*requests.columns, "reason"]
    accepted, late = split(judged.select(*kept))
    refused = ordered.filter("reason is not null").select("request_id", "request_ts", "reason")

    edits = accepted.filter(op != "clear").groupBy("item_id").agg(
        last("quantity", op == "set").alias("_quantity"), F.max(op == "remove").alias("_gone")
    )
    marked = (
        t["cart_items"].join(edits, "item_id", "left")
        .join(cleared.select("cart_id", F.lit(True).alias("_emptied")), "cart_id", "left")
    )
    stays = ~F.coalesce("_gone", F.lit(False)) & F.col("_emptied").isNull()
    state = marked.filter(stays).withColumn("quantity", F.coalesce("_quantity", "quantity"))
    written = ChangeSet(state.filter(F.col("_quantity").isNotNull()).select(*t["cart_items"].columns),
                        marked.filter(F.col("_gone") | F.col("_emptied")).select("item_id"))
    tables = {
        "cart": t["cart"].unionByName(new_carts, allowMissingColumns=True),
        "cart_items": state.select(*t["cart_items"].columns),
    }
    return Change(tables, accepted, late.unionByName(refused), {"cart": ChangeSet(new_carts), "cart_items": written})
