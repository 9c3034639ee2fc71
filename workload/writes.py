"""Batches merged into a written snapshot, batches that repeat requests, reports moved on by batches, pages by cursor."""

from pyspark.sql import DataFrame, functions as F

from tradewind.operators import changes, standing, standing_audit
from tradewind.plans.cursor import cursor_of, newest, page_after
from tradewind.plans.requests import ChangeSet
from tradewind.session import held, work_folder
from tradewind.sources import RequestLedger, apply_once, commit, load_marketplace, merge_snapshot, write_snapshot

from .batches import (_ADD, _EDIT, _EVENT, _PAY, _PAY_STATE, _REVIEW, _STATUS, _add_requests, _edit, _now, _payment_state,
                      _payment_updates, _review, _status)
from .registry import query
from .reports import audit_sql, orphan_sql
from .star import marketplace, sql


def _written(spark, sf_dir, *names):
    """Some tables as a snapshot, the others as they are."""
    t = marketplace(spark, sf_dir)
    folder = work_folder(spark, "snapshot")
    write_snapshot({name: t[name] for name in names}, folder)
    return t, folder


def _loaded(spark, t, folder, *names):
    found = load_marketplace(spark, folder, tables=names)
    return {**{name: t[name] for name in t}, **found}


@query("merge_snapshot", sql(_PAY_STATE, **_PAY))
def merged_payments(spark, sf_dir) -> DataFrame:
    """Payment updates applied to a written snapshot: only the changed rows are merged into their months, then read back."""
    names = ("orders", "payments")
    t, folder = _written(spark, sf_dir, *names)
    tables = _loaded(spark, t, folder, *names)
    change = changes.apply_payments(tables, _payment_updates(t.raw("events")), _now())
    merge_snapshot(spark, change.sets, folder)
    return _payment_state(load_marketplace(spark, folder, tables=names))


@query("merge_snapshot_removals", sql("""SELECT l.item_id, l.cart_id, CAST(coalesce(f.quantity, l.quantity) AS INTEGER) AS quantity, l.created_at
  FROM m_cart_items l LEFT JOIN (SELECT item_id, last(quantity ORDER BY request_ts, request_id) AS quantity FROM judged
  WHERE reason IS NULL AND op = 'set' GROUP BY item_id) f ON f.item_id = l.item_id
  WHERE l.item_id NOT IN (SELECT item_id FROM ended)""", **_EDIT))
def merged_cart_edits(spark, sf_dir) -> DataFrame:
    """Edits that change and remove cart lines, merged into a written snapshot and read back."""
    names = ("cart", "cart_items")
    _, folder = _written(spark, sf_dir, *names)
    merge_snapshot(spark, _edit(spark, sf_dir).sets, folder)
    return load_marketplace(spark, folder, tables=names)["cart_items"].select("item_id", "cart_id", "quantity", "created_at")


def _in_two_batches(spark, sf_dir):
    """Views as one batch, then all events as another that repeats them: the second change and the tables after both."""
    names = ("cart", "cart_items")
    t, folder = _written(spark, sf_dir, *names)
    ledger = RequestLedger(spark, work_folder(spark, "ledger"))
    requests = _add_requests(t)
    change = None
    for batch, mine in (("views", requests.filter("is_view")), ("all", requests)):
        mine = mine.drop("is_view")
        change = apply_once(ledger, "add_to_cart", changes.add_to_cart, _loaded(spark, t, folder, *names), mine)
        rejected = held(change.rejected, "rejected")  # made from the tables that the commit replaces
        commit(spark, folder, ledger, "add_to_cart", batch, mine, change)
    return rejected, load_marketplace(spark, folder, tables=names)


@query("ledger_state", sql("""SELECT coalesce(l.cart_id, a.cart_id) AS cart_id,
  coalesce(l.item_id, sha256('line:' || a.cart_id || ':' || a.item_type || ':' || a.item_id)) AS item_id,
  coalesce(l.item_type, a.item_type) AS item_type, coalesce(l.pet_id, l.product_id, a.item_id) AS listing_id,
  CAST(coalesce(l.quantity, 0) + coalesce(a.quantity, 0) AS INTEGER) AS quantity
  FROM m_cart_items l FULL JOIN added a ON a.cart_id = l.cart_id AND a.item_type = l.item_type
  AND a.item_id = coalesce(l.pet_id, l.product_id)""", **_ADD))
def ledger_state(spark, sf_dir) -> DataFrame:
    """Carts after a batch and another that repeats it among new requests: as if each request had come once."""
    _, tables = _in_two_batches(spark, sf_dir)
    return tables["cart_items"].select("cart_id", "item_id", "item_type", F.coalesce("pet_id", "product_id").alias("listing_id"), "quantity")


@query("ledger_rejected", sql("""SELECT j.request_id, j.request_ts, CASE WHEN event_type = 'view' THEN 'duplicate_request' ELSE reason END AS reason
  FROM judged j JOIN e USING (request_id) WHERE reason IS NOT NULL OR event_type = 'view'""", **{**_ADD, "e": _EVENT}))
def ledger_rejected(spark, sf_dir) -> DataFrame:
    """What the repeating batch is refused: every request that came before, and what is refused anyway."""
    return _in_two_batches(spark, sf_dir)[0]


# --- reports kept up to date

def _advanced(t, change, *names) -> dict:
    """The sums before a batch, moved on by what the batch changed."""
    return standing.advance(standing.standing_state(t, names), standing.standing_delta(t, change.sets, names))


_MOVED = {**_STATUS, "moved": """SELECT o.order_id, coalesce(f.status, o.status) AS status FROM m_orders o LEFT JOIN (
  SELECT order_id, last(status ORDER BY request_ts, request_id) AS status FROM judged WHERE reason IS NULL GROUP BY order_id) f
  ON f.order_id = o.order_id"""}


@query("standing_seller_stats", sql("""SELECT seller_id, status, CAST(sum(subtotal) AS DECIMAL(22,2)) AS gross,
  count(DISTINCT order_id) AS order_count FROM m_order_items JOIN moved USING (order_id) GROUP BY seller_id, status""", **_MOVED))
def standing_seller_stats(spark, sf_dir) -> DataFrame:
    """Sellers' sales by status after a batch of status changes, without reading all orders again."""
    t = marketplace(spark, sf_dir)
    return standing.seller_stats_by_status(_advanced(t, _status(spark, sf_dir), "seller_sales"))


@query("standing_earnings", sql("""SELECT status, count(*) AS order_count, count(DISTINCT order_id) AS distinct_orders,
  CAST(sum(subtotal) AS DECIMAL(22,2)) AS gross_subtotal FROM m_order_items JOIN moved USING (order_id) GROUP BY status""", **_MOVED))
def standing_earnings(spark, sf_dir) -> DataFrame:
    t = marketplace(spark, sf_dir)
    return standing.earnings_by_status(_advanced(t, _status(spark, sf_dir), "status_sales"), t).drop("platform_fee")


@query("standing_ratings", sql("""SELECT product_id, CAST(round(avg(CAST(rating AS DECIMAL(12,2))), 1) AS DECIMAL(12,1)) AS avg_rating,
  count(*) AS review_count FROM (SELECT product_id, rating FROM m_reviews WHERE product_id IS NOT NULL
  UNION ALL SELECT item_id, CAST(rating AS SMALLINT) FROM judged WHERE reason IS NULL AND item_type = 'product') GROUP BY product_id""", **_REVIEW))
def standing_ratings(spark, sf_dir) -> DataFrame:
    """Ratings after a batch of new reviews."""
    t = marketplace(spark, sf_dir)
    return standing.rating_summary(_advanced(t, _review(spark, sf_dir), "ratings"), "product")


@query("standing_dashboard", sql("""SELECT 'order' AS kind, status, count(*) AS n, CAST(0 AS DECIMAL(22,2)) AS amount FROM new_orders GROUP BY status
  UNION ALL SELECT 'payment', p.status, count(*), CAST(sum(o.amount) AS DECIMAL(22,2)) FROM new_payments p
  JOIN m_payments o ON o.payment_id = p.payment_id GROUP BY p.status""", **_PAY))
def standing_dashboard(spark, sf_dir) -> DataFrame:
    """Orders and payment amounts by status after a batch of payment updates."""
    t = marketplace(spark, sf_dir)
    change = changes.apply_payments(t, _payment_updates(t.raw("events")), _now())
    state = _advanced(t, change, "order_statuses", "revenue")
    orders = state["order_statuses"].select(F.lit("order").alias("kind"), "status", "n", F.lit(0).cast("decimal(22,2)").alias("amount"))
    return orders.unionByName(state["revenue"].select(F.lit("payment").alias("kind"), "status", "n", "amount"))


_FAULTY = {
    "left_users": "SELECT * FROM m_users WHERE role <> 'buyer' OR CAST(substr(user_id, 2) AS BIGINT) % 3 <> 0",
    "left_products": """SELECT * REPLACE (CASE WHEN price > 1500 THEN -stock ELSE stock END AS stock,
  CASE WHEN price > 1500 THEN 'X' || seller_id ELSE seller_id END AS seller_id) FROM m_products""",
}


@query("standing_audit", sql(f"""SELECT table_name, rule, column_name, CAST(NULL AS VARCHAR) AS parent_table, violations AS n FROM ({audit_sql(_FAULTY)})
  UNION ALL SELECT table_name, 'reference', column_name, parent_table, orphans FROM ({orphan_sql(_FAULTY)})""", **_FAULTY))
def standing_audit_counts(spark, sf_dir) -> DataFrame:
    """Both audits after a batch that breaks rules: a third of the buyers goes without what refers to them, dear
    products get a negative stock and sellers that are nobody. Only what the batch names is checked again."""
    t = marketplace(spark, sf_dir)
    dear = t["products"].filter("price > 1500").withColumns({"stock": (-F.col("stock")).cast("int"), "seller_id": F.concat(F.lit("X"), F.col("seller_id"))})
    buyers = t["users"].filter("role = 'buyer' AND bigint(substr(user_id, 2)) % 3 = 0").select("user_id")
    state = standing_audit.find_violations(t)
    state = standing_audit.advance_violations(state, t, {"users": ChangeSet(gone=buyers), "products": ChangeSet(dear)}).checkpoint()
    rules = standing_audit.constraint_counts(state).withColumnRenamed("violations", "n")
    orphans = standing_audit.orphan_counts(state).withColumnRenamed("orphans", "n").withColumn("rule", F.lit("reference"))
    return rules.unionByName(orphans, allowMissingColumns=True)


# --- pages by cursor

_NEWEST = newest("product_id")


@query("products_after", sql("""SELECT product_id, product_name, price, created_at FROM m_products WHERE is_active
  ORDER BY created_at DESC NULLS FIRST, product_id LIMIT 100 OFFSET 200"""))
def products_after(spark, sf_dir) -> DataFrame:
    """The third page of active products, each page found by the last row of the one before."""
    rows = marketplace(spark, sf_dir)["products"].filter("is_active").select("product_id", "product_name", "price", "created_at")
    cursor = None
    for _ in range(2):
        page = page_after(rows, _NEWEST, cursor, 100).collect()
        cursor = cursor_of(page[-1], _NEWEST) if page else cursor
    return page_after(rows, _NEWEST, cursor, 100)
