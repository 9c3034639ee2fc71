"""Order histories and payment look-ups."""

from pyspark.sql import DataFrame, functions as F

from .. import schema
from ..functions import newest_first
from ..plans.nesting import attach, nest
from ..plans.paging import key_meta, page_meta, page_per_key, page_with_parent
from .items import ITEM_KEY, item_id, item_view

_BUYER = {"name": "buyer_name", "email": "buyer_email", "phone": "buyer_phone"}


def _orders(t, status: str | None = None) -> DataFrame:
    schema.require_allowed(status or None, schema.ORDER_STATUS, "status")
    declared = [field.name for field in schema.TABLES["orders"]]
    orders = t["orders"].select(*[c for c in declared if c in t["orders"].columns])
    return orders.filter(F.col("status") == status) if status else orders


def _buyers(t) -> DataFrame:
    return t["users"].select(F.col("user_id").alias("buyer_id"), *[F.col(c).alias(a) for c, a in _BUYER.items()])


def _payments(t, *extra: str) -> DataFrame:
    return t["payments"].select(
        "order_id", F.col("status").alias("payment_status"), F.col("method").alias("payment_method"), *extra
    )


def _named(lines: DataFrame, t) -> DataFrame:
    """Lines with the name and image of their item."""
    items = item_view(t).select(*ITEM_KEY, "name", "image_url")
    return lines.withColumn("item_id", item_id()).join(items, ITEM_KEY, "left")


# Sellers up to this number are counted first and broadcast, so that lines are not shuffled for a name.
NEAR_SELLERS = 500_000


def _with_sellers(lines: DataFrame, t) -> DataFrame:
    """Lines with the name of their seller."""
    sellers = t["users"].select(F.col("user_id").alias("seller_id"), F.col("name").alias("seller_name"))
    ids = t["order_items"].select("seller_id").distinct()
    sellers = sellers.join(ids, "seller_id", "left_semi")
    return lines.join(F.broadcast(sellers) if sellers.count() <= NEAR_SELLERS else sellers, "seller_id", "left")


_LINE = ["order_item_id", "item_type", "pet_id", "product_id", "quantity", "unit_price", "subtotal", "name", "image_url"]


def order_lines(t, ids=None) -> DataFrame:
    """All lines as rows, with the name and image of the item and the name of the seller."""
    lines = t["order_items"]
    if ids is not None:
        lines = lines.filter(F.col("order_id").isin(list(ids)))
    return _with_sellers(_named(lines, t), t).select("order_id", *_LINE, "seller_id", "seller_name")


def _of_buyer(t, status: str | None, buyer) -> DataFrame:
    orders = _orders(t, status)
    return orders if buyer is None else orders.filter(F.col("buyer_id") == F.lit(buyer))


def buyer_orders(t, status: str | None = None, page: int | None = 1, limit: int | None = None, buyer=None) -> DataFrame:
    """The same page of every buyer's orders, newest first, with payment and nested lines.

    Orders are paged before any line is read. An order is one row, with all its lines. Pages of all buyers want most
    lines: those are named first, so that the join with the chosen orders leaves them where they are nested.
    """
    orders = _of_buyer(t, status, buyer)
    chosen = orders if page is None else page_per_key(orders, "buyer_id", newest_first("order_id"), page, limit)
    if buyer is None:
        lines = _named(t["order_items"], t).join(chosen.select("order_id").distinct(), "order_id")
        nested = nest(lines, ["order_id"], _LINE, placed=True)
    else:
        lines = t["order_items"].join(chosen.select("order_id"), "order_id", "left_semi")
        nested = nest(_named(lines, t), ["order_id"], _LINE)
    return attach(chosen.join(_payments(t), "order_id", "left"), nested, ["order_id"])


def buyer_orders_meta(t, status: str | None = None, page: int | None = 1, limit: int | None = None, buyer=None) -> DataFrame:
    """Total and number of pages of every buyer's orders; buyers without orders are absent."""
    return key_meta(_of_buyer(t, status, buyer), "buyer_id", page, limit)


def order_detail(t, ids=None) -> DataFrame:
    """Orders with buyer contact, payment and nested lines including the seller's name."""
    orders = _orders(t)
    if ids is not None:
        orders = orders.filter(F.col("order_id").isin(list(ids)))
    nested = nest(order_lines(t, ids), ["order_id"], [*_LINE, "seller_id", "seller_name"])
    heads = orders.join(_buyers(t), "buyer_id").join(_payments(t, "reference_no", "paid_at"), "order_id", "left")
    return attach(heads, nested, ["order_id"])


def _of_seller(t, wanted: DataFrame, seller) -> tuple[DataFrame, DataFrame]:
    """The sellers' lines, and (seller, order) with its date of the wanted orders whose buyer is known."""
    lines = t["order_items"]
    if seller is not None:
        lines = lines.filter(F.col("seller_id") == F.lit(seller))
    pairs = lines.select("seller_id", "order_id").distinct()
    sortable = wanted.join(t["users"].select(F.col("user_id").alias("buyer_id")), "buyer_id", "left_semi")
    return lines, pairs.join(sortable.select("order_id", "created_at"), "order_id")


def seller_orders_meta(t, status: str | None = None, page: int | None = 1, limit: int | None = None, seller=None) -> DataFrame:
    """Total and number of pages of every seller's orders, each order once; sellers without orders are absent."""
    return key_meta(_of_seller(t, _orders(t, status), seller)[1], "seller_id", page, limit)


def seller_orders(t, status: str | None = None, page: int | None = 1, limit: int | None = None, seller=None) -> DataFrame:
    """The same page of every seller's orders: only that seller's lines, but the total of the whole order."""
    keys = ["seller_id", "order_id"]
    wanted = _orders(t, status).select(
        "order_id", "buyer_id", "status", "total_price", "created_at",
        "shipping_address", "shipping_city", "shipping_postal", "notes",
    )
    # page on the narrow columns, then fetch the rest for the chosen orders
    lines, chosen = _of_seller(t, wanted, seller)
    if page is not None:
        chosen = page_per_key(chosen, "seller_id", newest_first("order_id"), page, limit)
    chosen = chosen.select(*keys)
    nested = nest(_named(lines.join(chosen, keys, "left_semi"), t), keys, ["item_type", "quantity", "unit_price", "subtotal", "name"])
    method = t["payments"].select("order_id", F.col("method").alias("payment_method"))
    heads = (
        chosen.join(wanted, "order_id").join(_buyers(t), "buyer_id").drop("buyer_id")
        .join(method, "order_id", "left")
    )
    return heads.join(nested, keys)


def admin_orders_meta(t, status: str | None = None, page: int | None = 1, limit: int | None = None) -> DataFrame:
    """Total and number of pages of admin_orders."""
    known = _orders(t, status).join(t["users"].select(F.col("user_id").alias("buyer_id")), "buyer_id", "left_semi")
    return page_meta(known, page, limit)


def admin_orders(t, status: str | None = None, page: int | None = 1, limit: int | None = None) -> DataFrame:
    """All orders with buyer and payment, newest first."""
    orders, order = _orders(t, status), newest_first("order_id")
    if page is None:
        return orders.join(_buyers(t), "buyer_id").join(_payments(t), "order_id", "left")
    # at most 100 rows: their buyers and payments are found by broadcasting the page, not by shuffling the tables
    chosen = F.broadcast(page_with_parent(orders, _buyers(t), "buyer_id", order, page, limit))
    payments = _payments(t).join(F.broadcast(chosen.select("order_id")), "order_id", "left_semi")
    return chosen.join(_buyers(t), "buyer_id").join(payments, "order_id", "left").orderBy(*order)


def payment_lookup(t, payment_ids=None, order_ids=None) -> DataFrame:
    """Payments with the buyer, total and status of their order."""
    payments = t["payments"]
    if payment_ids is not None:
        payments = payments.filter(F.col("payment_id").isin(list(payment_ids)))
    if order_ids is not None:
        payments = payments.filter(F.col("order_id").isin(list(order_ids)))
    orders = t["orders"].select("order_id", "buyer_id", "total_price", F.col("status").alias("order_status"))
    return payments.join(orders, "order_id")
