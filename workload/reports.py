"""Reports, listings and audits over the whole tables."""

from pyspark.sql import DataFrame, functions as F

from tradewind import schema
from tradewind.functions import newest_first
from tradewind.operators import cart, catalog, dashboard, earnings, orders, people, quality, reviews
from tradewind.plans.paging import page_meta, page_per_key, take_page

from .registry import query
from .star import AS_OF, marketplace, sql

# --- catalogue and ratings

_RATING = """SELECT {key}, CAST(round(avg(CAST(rating AS DECIMAL(12,2))), 1) AS DECIMAL(12,1)) AS avg_rating,
  count(*) AS review_count FROM m_reviews WHERE {key} IS NOT NULL GROUP BY {key}"""
_RATED = {"r_pet": _RATING.format(key="pet_id"), "r_product": _RATING.format(key="product_id")}
_PRODUCT = """p.product_id, p.seller_id, p.category_id, p.product_name, p.price, p.stock, p.image_url,
  p.created_at, c.name AS category_name"""
_PET = "p.pet_id, p.seller_id, p.pet_name, p.species, p.breed, p.age_month, p.gender, p.price, p.stock, p.created_at"
_PRODUCT_COLUMNS = ["product_id", "seller_id", "category_id", "product_name", "price", "stock", "image_url",
                    "created_at", "category_name"]
_PET_COLUMNS = ["pet_id", "seller_id", "pet_name", "species", "breed", "age_month", "gender", "price", "stock",
                "created_at"]
_RATING_COLUMNS = ["avg_rating", "review_count"]


@query("rating_summary", sql("""SELECT 'pet' AS item_type, pet_id AS item_id, avg_rating, review_count FROM r_pet
  UNION ALL SELECT 'product', product_id, avg_rating, review_count FROM r_product""", **_RATED))
def rating_summary(spark, sf_dir) -> DataFrame:
    t = marketplace(spark, sf_dir)
    of = lambda kind, key: catalog.rating_summary(t["reviews"], kind).select(
        F.lit(kind).alias("item_type"), F.col(key).alias("item_id"), *_RATING_COLUMNS)
    return of("pet", "pet_id").unionByName(of("product", "product_id"))


@query("list_products", sql(f"""SELECT {_PRODUCT}, u.name AS seller_name, r.avg_rating,
  coalesce(r.review_count, 0) AS review_count
  FROM m_products p JOIN m_users u ON u.user_id = p.seller_id
  LEFT JOIN m_categories c ON c.category_id = p.category_id LEFT JOIN r_product r ON r.product_id = p.product_id
  WHERE p.is_active""", **_RATED))
def list_products(spark, sf_dir) -> DataFrame:
    rows = catalog.list_products(marketplace(spark, sf_dir), page=None)
    return rows.select(*_PRODUCT_COLUMNS, "seller_name", *_RATING_COLUMNS)


@query("list_products_filtered", sql(f"""SELECT {_PRODUCT}, u.name AS seller_name, r.avg_rating,
  coalesce(r.review_count, 0) AS review_count
  FROM m_products p JOIN m_users u ON u.user_id = p.seller_id
  LEFT JOIN m_categories c ON c.category_id = p.category_id LEFT JOIN r_product r ON r.product_id = p.product_id
  WHERE p.is_active AND p.category_id = 3 AND p.product_name ILIKE '%RED%' AND p.price >= 910 AND p.price <= 990""",
    **_RATED))
def list_products_filtered(spark, sf_dir) -> DataFrame:
    wanted = catalog.ItemFilters(category_id=3, search="RED", min_price=910, max_price=990)
    rows = catalog.list_products(marketplace(spark, sf_dir), wanted, page=None)
    return rows.select(*_PRODUCT_COLUMNS, "seller_name", *_RATING_COLUMNS)


@query("list_products_best_rated", sql(f"""SELECT {_PRODUCT}, u.name AS seller_name, r.avg_rating,
  coalesce(r.review_count, 0) AS review_count
  FROM m_products p JOIN m_users u ON u.user_id = p.seller_id
  LEFT JOIN m_categories c ON c.category_id = p.category_id LEFT JOIN r_product r ON r.product_id = p.product_id
  WHERE p.is_active ORDER BY r.avg_rating DESC NULLS LAST, p.product_id LIMIT 100 OFFSET 100""", **_RATED))
def list_products_best_rated(spark, sf_dir) -> DataFrame:
    rows = catalog.list_products(marketplace(spark, sf_dir), sort="rating", page=2, limit=100)
    return rows.select(*_PRODUCT_COLUMNS, "seller_name", *_RATING_COLUMNS)


@query("list_products_newest", sql(f"""SELECT {_PRODUCT}, u.name AS seller_name, r.avg_rating,
  coalesce(r.review_count, 0) AS review_count
  FROM m_products p JOIN m_users u ON u.user_id = p.seller_id
  LEFT JOIN m_categories c ON c.category_id = p.category_id LEFT JOIN r_product r ON r.product_id = p.product_id
  WHERE p.is_active ORDER BY p.created_at DESC NULLS FIRST, p.product_id LIMIT 100""", **_RATED))
def list_products_newest(spark, sf_dir) -> DataFrame:
    rows = catalog.list_products(marketplace(spark, sf_dir), sort="newest", page=1, limit=100)
    return rows.select(*_PRODUCT_COLUMNS, "seller_name", *_RATING_COLUMNS)


@query("list_pets", sql(f"""SELECT {_PET}, u.name AS seller_name, r.avg_rating,
  coalesce(r.review_count, 0) AS review_count
  FROM m_pets p JOIN m_users u ON u.user_id = p.seller_id LEFT JOIN r_pet r ON r.pet_id = p.pet_id
  WHERE p.is_active""", **_RATED))
def list_pets(spark, sf_dir) -> DataFrame:
    rows = catalog.list_pets(marketplace(spark, sf_dir), page=None)
    return rows.select(*_PET_COLUMNS, "seller_name", *_RATING_COLUMNS)


@query("list_pets_filtered", sql(f"""SELECT {_PET}, u.name AS seller_name, r.avg_rating,
  coalesce(r.review_count, 0) AS review_count
  FROM m_pets p JOIN m_users u ON u.user_id = p.seller_id LEFT JOIN r_pet r ON r.pet_id = p.pet_id
  WHERE p.is_active AND p.species ILIKE '%arg%' AND p.gender = 'Betina' AND p.breed ILIKE '%brand#1%'
  ORDER BY p.price DESC, p.pet_id LIMIT 100""", **_RATED))
def list_pets_filtered(spark, sf_dir) -> DataFrame:
    wanted = catalog.ItemFilters(species="arg", gender="Betina", breed="brand#1")
    rows = catalog.list_pets(marketplace(spark, sf_dir), wanted, sort="price_desc", limit=100)
    return rows.select(*_PET_COLUMNS, "seller_name", *_RATING_COLUMNS)


@query("product_detail", sql(f"""SELECT {_PRODUCT}, u.name AS seller_name, u.avatar_url AS seller_avatar,
  u.phone AS seller_phone, r.avg_rating, coalesce(r.review_count, 0) AS review_count
  FROM m_products p JOIN m_users u ON u.user_id = p.seller_id
  LEFT JOIN m_categories c ON c.category_id = p.category_id LEFT JOIN r_product r ON r.product_id = p.product_id
  WHERE p.is_active""", **_RATED))
def product_detail(spark, sf_dir) -> DataFrame:
    return catalog.product_detail(marketplace(spark, sf_dir)).select(
        *_PRODUCT_COLUMNS, "seller_name", "seller_avatar", "seller_phone", *_RATING_COLUMNS)


@query("pet_detail", sql(f"""SELECT {_PET}, u.name AS seller_name, u.avatar_url AS seller_avatar,
  u.phone AS seller_phone, r.avg_rating, coalesce(r.review_count, 0) AS review_count
  FROM m_pets p JOIN m_users u ON u.user_id = p.seller_id LEFT JOIN r_pet r ON r.pet_id = p.pet_id
  WHERE p.is_active""", **_RATED))
def pet_detail(spark, sf_dir) -> DataFrame:
    return catalog.pet_detail(marketplace(spark, sf_dir)).select(
        *_PET_COLUMNS, "seller_name", "seller_avatar", "seller_phone", *_RATING_COLUMNS)


def _ranked(view: str, keys: str, order: str, first: int, last: int, where: str = "true") -> str:
    return f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn
  FROM {view} WHERE {where}) WHERE rn BETWEEN {first} AND {last}"""


@query("seller_products", sql(f"""SELECT {_PRODUCT}, r.avg_rating, coalesce(r.review_count, 0) AS review_count
  FROM paged p LEFT JOIN m_categories c ON c.category_id = p.category_id
  LEFT JOIN r_product r ON r.product_id = p.product_id""", **_RATED,
    paged=_ranked("m_products", "seller_id", "created_at DESC NULLS FIRST, product_id", 1, 12, "is_active")))
def seller_products(spark, sf_dir) -> DataFrame:
    return catalog.seller_products(marketplace(spark, sf_dir)).select(*_PRODUCT_COLUMNS, *_RATING_COLUMNS)


@query("seller_pets", sql(f"""SELECT {_PET}, r.avg_rating, coalesce(r.review_count, 0) AS review_count
  FROM paged p LEFT JOIN r_pet r ON r.pet_id = p.pet_id""", **_RATED,
    paged=_ranked("m_pets", "seller_id", "created_at DESC NULLS FIRST, pet_id", 3, 4, "is_active")))
def seller_pets(spark, sf_dir) -> DataFrame:
    return catalog.seller_pets(marketplace(spark, sf_dir), page=2, limit=2).select(*_PET_COLUMNS, *_RATING_COLUMNS)


@query("admin_products", sql(f"""SELECT {_PRODUCT}, u.name AS seller_name FROM m_products p
  JOIN m_users u ON u.user_id = p.seller_id LEFT JOIN m_categories c ON c.category_id = p.category_id
  WHERE p.is_active AND p.product_name ILIKE '%e%'"""))
def admin_products(spark, sf_dir) -> DataFrame:
    rows = catalog.admin_products(marketplace(spark, sf_dir), catalog.ItemFilters(search="e"), page=None)
    return rows.select(*_PRODUCT_COLUMNS, "seller_name")


@query("admin_pets", sql(f"""SELECT {_PET}, u.name AS seller_name FROM m_pets p
  JOIN m_users u ON u.user_id = p.seller_id WHERE p.is_active"""))
def admin_pets(spark, sf_dir) -> DataFrame:
    return catalog.admin_pets(marketplace(spark, sf_dir), page=None).select(*_PET_COLUMNS, "seller_name")


@query("category_counts", sql("""SELECT c.category_id, c.name, count(p.product_id) AS product_count
  FROM m_categories c LEFT JOIN m_products p ON p.category_id = c.category_id AND p.is_active
  GROUP BY c.category_id, c.name"""))
def category_counts(spark, sf_dir) -> DataFrame:
    return catalog.category_counts(marketplace(spark, sf_dir)).select("category_id", "name", "product_count")


# --- carts

_CONTENTS = """SELECT l.cart_id, l.item_id, l.item_type, l.quantity, l.pet_id, l.product_id, i.name, i.price,
  i.image_url, i.stock, i.seller_id, l.created_at FROM m_cart_items l
  LEFT JOIN m_items i ON i.item_type = l.item_type AND i.item_id = coalesce(l.pet_id, l.product_id)"""


@query("cart_contents", sql("SELECT * FROM contents", contents=_CONTENTS))
def cart_contents(spark, sf_dir) -> DataFrame:
    return cart.cart_contents(marketplace(spark, sf_dir))


@query("cart_totals", sql("""SELECT c.cart_id, c.buyer_id,
  CAST(coalesce(sum(coalesce(l.price, 0) * l.quantity), 0) AS DECIMAL(22,2)) AS total_price, count(l.item_id) AS item_count
  FROM m_cart c LEFT JOIN contents l ON l.cart_id = c.cart_id GROUP BY c.cart_id, c.buyer_id""", contents=_CONTENTS))
def cart_totals(spark, sf_dir) -> DataFrame:
    return cart.cart_totals(marketplace(spark, sf_dir))


@query("checkout_quote", sql("""SELECT *, CAST(subtotal - platform_fee AS DECIMAL(22,2)) AS seller_payout FROM (
  SELECT cart_id, CAST(sum(coalesce(price, 0) * quantity) AS DECIMAL(22,2)) AS subtotal, count(*) AS item_count,
  bool_and(stock >= quantity) AS all_in_stock, CAST(15 AS DECIMAL(12,2)) AS shipping_cost,
  CAST(floor(sum(coalesce(price, 0) * quantity) * 0.1 + 0.5) AS DECIMAL(22,2)) AS platform_fee,
  CAST(sum(coalesce(price, 0) * quantity) + 15 AS DECIMAL(22,2)) AS total_price
  FROM contents GROUP BY cart_id)""", contents=_CONTENTS))
def checkout_quote(spark, sf_dir) -> DataFrame:
    return cart.checkout_quote(marketplace(spark, sf_dir))


# --- orders and payments; nested lines are compared as count, amount and sorted text

def _flat(rows: DataFrame, *fields: str) -> DataFrame:
    line = lambda item: F.concat_ws("/", *[item[f].cast("string") for f in fields])
    text = F.array_join(F.array_sort(F.transform("items", line)), ";")
    return rows.withColumn("items_text", text).drop("items")


_NAMED = """SELECT l.*, i.name, i.image_url FROM m_order_items l
  LEFT JOIN m_items i ON i.item_type = l.item_type AND i.item_id = coalesce(l.pet_id, l.product_id)"""
_LINES = """SELECT {keys}, count(*) AS n, sum(subtotal) AS amount, string_agg({text}, ';' ORDER BY {text}) AS lines
  FROM named GROUP BY {keys}"""
_AGGREGATES = """coalesce(g.n, 0) AS item_count, CAST(coalesce(g.amount, 0) AS DECIMAL(22,2)) AS items_total,
  coalesce(g.lines, '') AS items_text"""


def _line_text(*columns: str) -> str:
    return "concat_ws('/', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in columns) + ")"


@query("buyer_orders", sql(f"""SELECT o.*, p.status AS payment_status, p.method AS payment_method, {_AGGREGATES}
  FROM paged o LEFT JOIN m_payments p ON p.order_id = o.order_id LEFT JOIN grouped g ON g.order_id = o.order_id""",
    paged=_ranked("m_orders", "buyer_id", "created_at DESC NULLS FIRST, order_id", 1, 12),
    named=_NAMED, grouped=_LINES.format(keys="order_id", text=_line_text(
        "order_item_id", "item_type", "quantity", "unit_price", "subtotal", "name", "image_url"))))
def buyer_orders(spark, sf_dir) -> DataFrame:
    return _flat(orders.buyer_orders(marketplace(spark, sf_dir)), "order_item_id", "item_type", "quantity",
                 "unit_price", "subtotal", "name", "image_url")


@query("order_detail", sql(f"""SELECT o.*, u.name AS buyer_name, u.email AS buyer_email, u.phone AS buyer_phone,
  p.status AS payment_status, p.method AS payment_method, p.reference_no, p.paid_at, {_AGGREGATES}
  FROM m_orders o JOIN m_users u ON u.user_id = o.buyer_id LEFT JOIN m_payments p ON p.order_id = o.order_id
  LEFT JOIN grouped g ON g.order_id = o.order_id""",
    named="SELECT l.*, s.name AS seller_name FROM m_order_items l LEFT JOIN m_users s ON s.user_id = l.seller_id",
    grouped=_LINES.format(keys="order_id", text=_line_text(
        "order_item_id", "item_type", "quantity", "unit_price", "subtotal", "seller_id", "seller_name"))))
def order_detail(spark, sf_dir) -> DataFrame:
    return _flat(orders.order_detail(marketplace(spark, sf_dir)), "order_item_id", "item_type", "quantity",
                 "unit_price", "subtotal", "seller_id", "seller_name")


@query("seller_orders", sql(f"""SELECT o.seller_id, o.order_id, o.status, o.total_price, o.created_at,
  o.shipping_address, o.shipping_city, o.shipping_postal, o.notes, u.name AS buyer_name, u.email AS buyer_email,
  u.phone AS buyer_phone, p.method AS payment_method, {_AGGREGATES}
  FROM paged o JOIN m_users u ON u.user_id = o.buyer_id LEFT JOIN m_payments p ON p.order_id = o.order_id
  JOIN grouped g ON g.order_id = o.order_id AND g.seller_id = o.seller_id""",
    mine="""SELECT DISTINCT l.seller_id, o.* FROM m_orders o JOIN m_order_items l ON l.order_id = o.order_id""",
    paged=_ranked("mine", "seller_id", "created_at DESC NULLS FIRST, order_id", 1, 12),
    named=_NAMED, grouped=_LINES.format(keys="seller_id, order_id", text=_line_text(
        "item_type", "quantity", "unit_price", "subtotal", "name"))))
def seller_orders(spark, sf_dir) -> DataFrame:
    return _flat(orders.seller_orders(marketplace(spark, sf_dir)), "item_type", "quantity", "unit_price", "subtotal",
                 "name")


@query("admin_orders", sql("""SELECT o.*, u.name AS buyer_name, u.email AS buyer_email, u.phone AS buyer_phone,
  p.status AS payment_status, p.method AS payment_method FROM m_orders o JOIN m_users u ON u.user_id = o.buyer_id
  LEFT JOIN m_payments p ON p.order_id = o.order_id"""))
def admin_orders(spark, sf_dir) -> DataFrame:
    return orders.admin_orders(marketplace(spark, sf_dir), page=None)


@query("admin_orders_page", sql("""SELECT o.*, u.name AS buyer_name, u.email AS buyer_email, u.phone AS buyer_phone,
  p.status AS payment_status, p.method AS payment_method FROM m_orders o JOIN m_users u ON u.user_id = o.buyer_id
  LEFT JOIN m_payments p ON p.order_id = o.order_id WHERE o.status = 'shipped'
  ORDER BY o.created_at DESC NULLS FIRST, o.order_id LIMIT 100 OFFSET 200"""))
def admin_orders_page(spark, sf_dir) -> DataFrame:
    return orders.admin_orders(marketplace(spark, sf_dir), status="shipped", page=3, limit=100)


@query("payment_lookup", sql("""SELECT p.*, o.buyer_id, o.total_price, o.status AS order_status
  FROM m_payments p JOIN m_orders o ON o.order_id = p.order_id"""))
def payment_lookup(spark, sf_dir) -> DataFrame:
    return orders.payment_lookup(marketplace(spark, sf_dir))


_META = "{key}, count(*) AS total, {page} AS page, {limit} AS \"limit\", CAST(ceil(count(*) / {limit}.0) AS BIGINT) AS total_pages"


def _meta(key: str, page: int, limit: int) -> str:
    return _META.format(key=key, page=page, limit=limit)


@query("order_lines", sql("""SELECT l.order_id, l.order_item_id, l.item_type, l.pet_id, l.product_id, l.quantity, l.unit_price, l.subtotal,
  l.name, l.image_url, l.seller_id, s.name AS seller_name FROM named l LEFT JOIN m_users s ON s.user_id = l.seller_id""", named=_NAMED))
def order_lines(spark, sf_dir) -> DataFrame:
    return orders.order_lines(marketplace(spark, sf_dir))


@query("buyer_orders_meta", sql(f"SELECT {_meta('buyer_id', 2, 5)} FROM m_orders GROUP BY buyer_id"))
def buyer_orders_meta(spark, sf_dir) -> DataFrame:
    return orders.buyer_orders_meta(marketplace(spark, sf_dir), page=2, limit=5)


@query("seller_orders_meta", sql(f"""SELECT {_meta('seller_id', 1, 12)} FROM (
  SELECT DISTINCT l.seller_id, l.order_id FROM m_order_items l JOIN m_orders o ON o.order_id = l.order_id
  JOIN m_users u ON u.user_id = o.buyer_id) GROUP BY seller_id"""))
def seller_orders_meta(spark, sf_dir) -> DataFrame:
    return orders.seller_orders_meta(marketplace(spark, sf_dir))


@query("admin_orders_meta", sql("""SELECT count(*) AS total, 3 AS page, 100 AS "limit",
  CAST(ceil(count(*) / 100.0) AS BIGINT) AS total_pages
  FROM m_orders o JOIN m_users u ON u.user_id = o.buyer_id WHERE o.status = 'shipped'"""))
def admin_orders_meta(spark, sf_dir) -> DataFrame:
    return orders.admin_orders_meta(marketplace(spark, sf_dir), status="shipped", page=3, limit=100)


@query("list_products_meta", sql("""SELECT count(*) AS total, 1 AS page, 24 AS "limit",
  CAST(ceil(count(*) / 24.0) AS BIGINT) AS total_pages FROM m_products p JOIN m_users u ON u.user_id = p.seller_id
  WHERE p.is_active AND p.category_id = 3"""))
def list_products_meta(spark, sf_dir) -> DataFrame:
    return catalog.list_products_meta(marketplace(spark, sf_dir), catalog.ItemFilters(category_id=3), limit=24)


@query("seller_products_meta", sql(f"SELECT {_meta('seller_id', 1, 12)} FROM m_products WHERE is_active GROUP BY seller_id"))
def seller_products_meta(spark, sf_dir) -> DataFrame:
    return catalog.seller_products_meta(marketplace(spark, sf_dir))


# --- earnings and dashboard

_BY_STATUS = """SELECT o.status, count(*) AS order_count, count(DISTINCT o.order_id) AS distinct_orders,
  CAST(sum(l.subtotal) AS DECIMAL(22,2)) AS gross_subtotal,
  CAST(floor(sum(l.subtotal) * 0.1 + 0.5) AS DECIMAL(22,2)) AS platform_fee
  FROM m_orders o JOIN m_order_items l ON l.order_id = o.order_id GROUP BY o.status"""


@query("seller_stats_by_status", sql("""SELECT l.seller_id, o.status, CAST(sum(l.subtotal) AS DECIMAL(22,2)) AS gross,
  count(DISTINCT o.order_id) AS order_count FROM m_order_items l JOIN m_orders o ON o.order_id = l.order_id
  GROUP BY l.seller_id, o.status"""))
def seller_stats_by_status(spark, sf_dir) -> DataFrame:
    return earnings.seller_stats_by_status(marketplace(spark, sf_dir))


@query("seller_stats", sql("""SELECT *, CAST(floor(gross_delivered * 0.9 + 0.5) AS DECIMAL(22,2)) AS net_delivered,
  CAST(floor(gross_on_going * 0.9 + 0.5) AS DECIMAL(22,2)) AS net_on_going FROM (
  SELECT u.user_id AS seller_id, CAST(10 AS DECIMAL(9,4)) AS fee_percent,
  CAST(coalesce(sum(l.subtotal) FILTER (o.status = 'delivered'), 0) AS DECIMAL(22,2)) AS gross_delivered,
  CAST(coalesce(sum(l.subtotal) FILTER (o.status IN ('pending', 'processing', 'shipped')), 0) AS DECIMAL(22,2))
  AS gross_on_going, count(DISTINCT o.order_id) AS total_orders
  FROM m_users u LEFT JOIN m_order_items l ON l.seller_id = u.user_id LEFT JOIN m_orders o ON o.order_id = l.order_id
  WHERE u.role = 'seller' GROUP BY u.user_id)"""))
def seller_stats(spark, sf_dir) -> DataFrame:
    return earnings.seller_stats(marketplace(spark, sf_dir))


@query("earnings_by_status", sql("SELECT * FROM by_status", by_status=_BY_STATUS))
def earnings_by_status(spark, sf_dir) -> DataFrame:
    return earnings.earnings_by_status(marketplace(spark, sf_dir))


@query("earnings_totals", sql("""SELECT CAST(10 AS DECIMAL(9,4)) AS fee_percent, CAST(15 AS DECIMAL(12,2)) AS shipping_cost,
  CAST(sum(platform_fee) FILTER (status = 'delivered') AS DECIMAL(22,2)) AS total_fee_delivered,
  CAST(sum(order_count) FILTER (status = 'delivered') AS BIGINT) AS total_orders_delivered,
  CAST(sum(platform_fee) FILTER (status IN ('pending', 'processing', 'shipped')) AS DECIMAL(22,2)) AS total_fee_on_going
  FROM by_status""", by_status=_BY_STATUS))
def earnings_totals(spark, sf_dir) -> DataFrame:
    return earnings.earnings_totals(marketplace(spark, sf_dir))


@query("earnings_monthly", sql(f"""SELECT strftime(o.created_at, '%Y-%m') AS month,
  count(DISTINCT o.order_id) AS order_count, CAST(sum(l.subtotal) AS DECIMAL(22,2)) AS gross_subtotal,
  CAST(floor(sum(l.subtotal) * 0.1 + 0.5) AS DECIMAL(22,2)) AS platform_fee
  FROM m_orders o JOIN m_order_items l ON l.order_id = o.order_id
  WHERE o.status = 'delivered' AND o.created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 12 MONTHS GROUP BY 1"""))
def earnings_monthly(spark, sf_dir) -> DataFrame:
    return earnings.earnings_monthly(marketplace(spark, sf_dir), AS_OF)


@query("dashboard_users", sql("""SELECT count(*) AS total, count(*) FILTER (role = 'buyer') AS buyers,
  count(*) FILTER (role = 'seller') AS sellers, count(*) FILTER (role = 'admin') AS admins
  FROM m_users WHERE is_active"""))
def dashboard_users(spark, sf_dir) -> DataFrame:
    return dashboard.dashboard_users(marketplace(spark, sf_dir))


@query("dashboard_inventory", sql("""SELECT 'pets' AS kind, count(*) AS total,
  CAST(sum(CASE WHEN stock > 0 THEN 1 ELSE 0 END) AS BIGINT) AS available FROM m_pets WHERE is_active UNION ALL
  SELECT 'products', count(*), CAST(sum(CASE WHEN stock > 0 THEN 1 ELSE 0 END) AS BIGINT) FROM m_products
  WHERE is_active"""))
def dashboard_inventory(spark, sf_dir) -> DataFrame:
    return dashboard.dashboard_inventory(marketplace(spark, sf_dir))


@query("dashboard_orders", sql("""SELECT status, count(*) AS order_count FROM m_orders GROUP BY status
  UNION ALL SELECT 'total', count(*) FROM m_orders"""))
def dashboard_orders(spark, sf_dir) -> DataFrame:
    return dashboard.dashboard_orders(marketplace(spark, sf_dir))


@query("dashboard_revenue", sql("""SELECT CAST(coalesce(sum(amount), 0) AS DECIMAL(22,2)) AS total,
  CAST(coalesce(sum(CASE WHEN status = 'paid' THEN amount ELSE 0 END), 0) AS DECIMAL(22,2)) AS paid FROM m_payments"""))
def dashboard_revenue(spark, sf_dir) -> DataFrame:
    return dashboard.dashboard_revenue(marketplace(spark, sf_dir))


@query("recent_orders", sql("""SELECT o.order_id, o.status, o.total_price, o.created_at, u.name AS buyer_name
  FROM m_orders o JOIN m_users u ON u.user_id = o.buyer_id
  ORDER BY o.created_at DESC NULLS FIRST, o.order_id LIMIT 10"""))
def recent_orders(spark, sf_dir) -> DataFrame:
    return dashboard.recent_orders(marketplace(spark, sf_dir))


# --- reviews, users, settings, paging

_REVIEW = """SELECT r.*, u.name AS reviewer_name, u.avatar_url AS reviewer_avatar FROM {view} r
  JOIN m_users u ON u.user_id = r.reviewer_id"""


@query("item_reviews", sql(f"{_REVIEW.format(view='pets_page')} UNION ALL {_REVIEW.format(view='products_page')}",
    pets_page=_ranked("m_reviews", "pet_id", "created_at DESC NULLS FIRST, review_id", 1, 12, "pet_id IS NOT NULL"),
    products_page=_ranked("m_reviews", "product_id", "created_at DESC NULLS FIRST, review_id", 1, 12,
                          "product_id IS NOT NULL")))
def item_reviews(spark, sf_dir) -> DataFrame:
    t = marketplace(spark, sf_dir)
    return reviews.item_reviews(t, "pet").unionByName(reviews.item_reviews(t, "product"))


@query("item_reviews_all", sql(f"{_REVIEW.format(view='m_reviews')} WHERE r.pet_id IS NOT NULL OR r.product_id IS NOT NULL"))
def item_reviews_all(spark, sf_dir) -> DataFrame:
    t = marketplace(spark, sf_dir)
    return reviews.item_reviews(t, "pet", page=None).unionByName(reviews.item_reviews(t, "product", page=None))


@query("item_reviews_meta", sql(f"""SELECT {_meta('pet_id', 1, 3)} FROM m_reviews r JOIN m_users u ON u.user_id = r.reviewer_id
  WHERE pet_id IS NOT NULL GROUP BY pet_id"""))
def item_reviews_meta(spark, sf_dir) -> DataFrame:
    return reviews.item_reviews_meta(marketplace(spark, sf_dir), "pet", limit=3)


@query("reviewed_keys", sql("""SELECT reviewer_id, 'order:' || coalesce(order_id, 'null') || CASE WHEN item_type = 'pet'
  THEN ':pet:' || coalesce(pet_id, 'null') ELSE ':product:' || coalesce(product_id, 'null') END AS review_key
  FROM m_reviews"""))
def reviewed_keys(spark, sf_dir) -> DataFrame:
    return reviews.reviewed_keys(marketplace(spark, sf_dir))


@query("review_eligibility", sql("""SELECT DISTINCT o.buyer_id, l.order_id, l.item_type, l.pet_id, l.product_id,
  coalesce(l.pet_id, l.product_id) AS item_id
  FROM m_order_items l JOIN m_orders o ON o.order_id = l.order_id WHERE o.status = 'delivered' AND NOT EXISTS (
  SELECT 1 FROM m_reviews r WHERE r.reviewer_id = o.buyer_id AND r.order_id = o.order_id AND r.item_type = l.item_type
  AND coalesce(r.pet_id, r.product_id) = coalesce(l.pet_id, l.product_id))"""))
def review_eligibility(spark, sf_dir) -> DataFrame:
    return reviews.review_eligibility(marketplace(spark, sf_dir))


@query("list_users", sql("""SELECT user_id, name, email, phone, role, avatar_url, is_active, is_verified, created_at
  FROM m_users WHERE is_active AND (name ILIKE '%er#%1%' OR email ILIKE '%er#%1%')"""))
def list_users(spark, sf_dir) -> DataFrame:
    return people.list_users(marketplace(spark, sf_dir), people.UserFilters(search="er#%1"), page=None)


@query("list_users_page", sql("""SELECT user_id, name, email, phone, role, avatar_url, is_active, is_verified, created_at
  FROM m_users WHERE NOT is_active AND role = 'buyer' ORDER BY created_at DESC NULLS FIRST, user_id LIMIT 50 OFFSET 50"""))
def list_users_page(spark, sf_dir) -> DataFrame:
    wanted = people.UserFilters(role="buyer", is_active=False)
    return people.list_users(marketplace(spark, sf_dir), wanted, page=2, limit=50)


@query("user_profiles", sql("""SELECT user_id, name, email, phone, role, avatar_url, address, city, postal_code,
  is_active, created_at, updated_at FROM m_users"""))
def user_profiles(spark, sf_dir) -> DataFrame:
    return people.user_profiles(marketplace(spark, sf_dir))


@query("login_eligible_users", sql("""SELECT user_id, email, role FROM m_users
  WHERE is_active AND (role <> 'seller' OR is_verified)"""))
def login_eligible_users(spark, sf_dir) -> DataFrame:
    return people.login_eligible_users(marketplace(spark, sf_dir))


_VISIBLE = """SELECT '{kind}' AS kind, o.{key} AS row_key, u.user_id AS viewer_id, 'own' AS scope FROM {view} o
  JOIN m_users u ON u.user_id = o.buyer_id AND u.role = 'buyer' AND u.is_active
  UNION ALL SELECT '{kind}', {key}, NULL, 'all' FROM {view}
  WHERE EXISTS (SELECT 1 FROM m_users WHERE role <> 'buyer' AND is_active)"""


@query("visible_rows", sql(f"""{_VISIBLE.format(kind='order', key='order_id', view='m_orders')} UNION ALL
  {_VISIBLE.format(kind='payment', key='payment_id', view='looked_up')}""",
    looked_up="SELECT p.*, o.buyer_id FROM m_payments p JOIN m_orders o ON o.order_id = p.order_id"))
def visible_rows(spark, sf_dir) -> DataFrame:
    t = marketplace(spark, sf_dir)
    of = lambda kind, df, key: people.visible_rows(df, t["users"], "buyer_id").select(
        F.lit(kind).alias("kind"), F.col(key).alias("row_key"), "viewer_id", "scope")
    return of("order", t["orders"], "order_id").unionByName(of("payment", orders.payment_lookup(t), "payment_id"))


@query("visible_counts", sql("""SELECT u.user_id AS viewer_id, u.role, CASE WHEN u.role = 'buyer' THEN
  (SELECT count(*) FROM m_orders o WHERE o.buyer_id = u.user_id) ELSE (SELECT count(*) FROM m_orders) END AS visible_rows
  FROM m_users u WHERE u.is_active"""))
def visible_counts(spark, sf_dir) -> DataFrame:
    t = marketplace(spark, sf_dir)
    return people.visible_counts(t["orders"], t["users"], "buyer_id")


@query("page", sql("""SELECT order_id, created_at, total, 4 AS page, 100 AS "limit",
  CAST(ceil(total / 100) AS BIGINT) AS total_pages FROM (SELECT order_id, created_at FROM m_orders
  ORDER BY created_at DESC NULLS FIRST, order_id LIMIT 100 OFFSET 300), (SELECT count(*) AS total FROM m_orders)"""))
def page(spark, sf_dir) -> DataFrame:
    rows = marketplace(spark, sf_dir)["orders"].select("order_id", "created_at")
    meta = page_meta(rows, 4, 100)
    of_meta = {c: meta.select(c).scalar() for c in ("total", "page", "limit", "total_pages")}
    return take_page(rows, newest_first("order_id"), 4, 100).withColumns(of_meta)


@query("page_per_key", sql("SELECT buyer_id, order_id, created_at FROM paged",
    paged=_ranked("m_orders", "buyer_id", "created_at DESC NULLS FIRST, order_id", 6, 10)))
def page_of_every_buyer(spark, sf_dir) -> DataFrame:
    rows = marketplace(spark, sf_dir)["orders"].select("buyer_id", "order_id", "created_at")
    return page_per_key(rows, "buyer_id", newest_first("order_id"), page=2, limit=5)


# --- data quality

def _views(changed) -> dict[str, str]:
    return {name: f"left_{name}" if f"left_{name}" in changed else f"m_{name}" for name in schema.TABLES}


def audit_sql(changed=()) -> str:
    """One SELECT per declared rule, written out for DuckDB; views of changed tables have names that begin with left_."""
    views = _views(changed)
    parts = []
    for table, fields in schema.TABLES.items():
        for f in fields:
            rules = []
            if f.required:
                rules.append(("not_null", f"{f.name} IS NULL"))
            if f.minimum is not None or f.maximum is not None:
                rules.append(("check", f"{f.name} < {f.minimum}" + (f" OR {f.name} > {f.maximum}" if f.maximum else "")))
            if f.allowed is not None:
                rules.append(("enum", f"{f.name} NOT IN ({', '.join(repr(a) for a in f.allowed)})"))
            if f.length is not None:
                rules.append(("length", f"length({f.name}) > {f.length}"))
            for rule, bad in rules:
                parts.append(f"SELECT '{table}' AS table_name, '{rule}' AS rule, '{f.name}' AS column_name, "
                             f"count(*) FILTER ({bad}) AS violations FROM {views[table]}")
        keys = [("primary_key", schema.PRIMARY_KEY[table])] + [("unique", c) for n, c in schema.UNIQUE if n == table]
        for rule, column in keys:
            parts.append(f"SELECT '{table}', '{rule}', '{column}', count(*) FROM (SELECT {column} FROM {views[table]} "
                         f"GROUP BY 1 HAVING count(*) > 1)")
    exactly = "(item_type = 'pet' AND pet_id IS NOT NULL AND product_id IS NULL) OR " \
              "(item_type = 'product' AND product_id IS NOT NULL AND pet_id IS NULL)"
    either = "(item_type = 'pet' AND pet_id IS NOT NULL) OR (item_type = 'product' AND product_id IS NOT NULL)"
    for table, fits in (("cart_items", exactly), ("reviews", either)):
        parts.append(f"SELECT '{table}', 'check', 'item_ref', count(*) FILTER (NOT ({fits})) FROM {views[table]}")
    return "\nUNION ALL ".join(parts)


def orphan_sql(changed=()) -> str:
    """One SELECT per reference."""
    views = _views(changed)
    return "\nUNION ALL ".join(
        f"""SELECT '{r.table}' AS table_name, '{r.column}' AS column_name, '{r.parent}' AS parent_table, count(*) AS orphans
  FROM {views[r.table]} c WHERE c.{r.column} IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM {views[r.parent]} p WHERE p.{schema.PRIMARY_KEY[r.parent]} = c.{r.column})""" for r in schema.REFERENCES)


@query("audit_constraints", sql(audit_sql()))
def audit_constraints(spark, sf_dir) -> DataFrame:
    return quality.audit_constraints(marketplace(spark, sf_dir))


@query("audit_foreign_keys", sql(orphan_sql()))
def audit_foreign_keys(spark, sf_dir) -> DataFrame:
    return quality.audit_foreign_keys(marketplace(spark, sf_dir))


@query("reconcile_orders", sql("""SELECT o.order_id, s.line_total, s.expected_fee,
  s.line_total = o.total_price - o.shipping_cost AS lines_match, s.expected_fee = o.platform_fee AS fee_matches,
  o.seller_payout = o.total_price - o.shipping_cost - o.platform_fee AS payout_matches,
  p.amount IS NOT NULL AS has_payment, coalesce(p.amount = o.total_price, false) AS payment_matches
  FROM m_orders o JOIN sums s ON s.order_id = o.order_id LEFT JOIN m_payments p ON p.order_id = o.order_id""",
    sums="""SELECT o.order_id, CAST(coalesce(sum(l.subtotal), 0) AS DECIMAL(22,2)) AS line_total,
  CAST(floor(coalesce(sum(l.subtotal), 0) * 0.1 + 0.5) AS DECIMAL(22,2)) AS expected_fee
  FROM m_orders o LEFT JOIN m_order_items l ON l.order_id = o.order_id GROUP BY o.order_id"""))
def reconcile_orders(spark, sf_dir) -> DataFrame:
    return quality.reconcile_orders(marketplace(spark, sf_dir))


@query("propagate_delete", sql("""
  SELECT 'users' AS table_name, user_id AS row_key, 'blocked' AS action, CAST(NULL AS VARCHAR) AS column_name FROM blocked
  UNION ALL SELECT 'users', user_id, 'delete', NULL FROM gone
  UNION ALL SELECT 'pets', pet_id, 'delete', NULL FROM gone_pets
  UNION ALL SELECT 'products', product_id, 'delete', NULL FROM gone_products
  UNION ALL SELECT 'cart', cart_id, 'delete', NULL FROM gone_cart
  UNION ALL SELECT 'cart_items', item_id, 'delete', NULL FROM m_cart_items
    WHERE cart_id IN (SELECT cart_id FROM gone_cart) OR pet_id IN (SELECT pet_id FROM gone_pets)
    OR product_id IN (SELECT product_id FROM gone_products)
  UNION ALL SELECT 'reviews', review_id, 'delete', NULL FROM m_reviews
    WHERE reviewer_id IN (SELECT user_id FROM gone) OR pet_id IN (SELECT pet_id FROM gone_pets)
    OR product_id IN (SELECT product_id FROM gone_products)
  UNION ALL SELECT 'order_items', order_item_id, 'set_null', 'pet_id' FROM m_order_items
    WHERE pet_id IN (SELECT pet_id FROM gone_pets)
  UNION ALL SELECT 'order_items', order_item_id, 'set_null', 'product_id' FROM m_order_items
    WHERE product_id IN (SELECT product_id FROM gone_products)""",
    asked="SELECT user_id FROM m_users WHERE NOT is_active",
    blocked="""SELECT user_id FROM asked WHERE user_id IN (SELECT buyer_id FROM m_orders)
      OR user_id IN (SELECT seller_id FROM m_order_items)""",
    gone="SELECT user_id FROM asked WHERE user_id NOT IN (SELECT user_id FROM blocked)",
    gone_pets="SELECT pet_id FROM m_pets WHERE seller_id IN (SELECT user_id FROM gone)",
    gone_products="SELECT product_id FROM m_products WHERE seller_id IN (SELECT user_id FROM gone)",
    gone_cart="SELECT cart_id FROM m_cart WHERE buyer_id IN (SELECT user_id FROM gone)"))
def propagate_delete(spark, sf_dir) -> DataFrame:
    t = marketplace(spark, sf_dir)
    inactive = t["users"].filter(~F.col("is_active")).select("user_id")
    return quality.propagate_delete(t, "users", inactive)


@query("propagate_delete_orders", sql("""
  SELECT 'orders' AS table_name, order_id AS row_key, 'delete' AS action, CAST(NULL AS VARCHAR) AS column_name FROM gone
  UNION ALL SELECT 'order_items', order_item_id, 'delete', NULL FROM m_order_items WHERE order_id IN (SELECT order_id FROM gone)
  UNION ALL SELECT 'payments', payment_id, 'delete', NULL FROM m_payments WHERE order_id IN (SELECT order_id FROM gone)
  UNION ALL SELECT 'reviews', review_id, 'set_null', 'order_id' FROM m_reviews WHERE order_id IN (SELECT order_id FROM gone)""",
    gone="SELECT order_id FROM m_orders WHERE status IN ('cancelled', 'delivered')"))
def propagate_delete_orders(spark, sf_dir) -> DataFrame:
    t = marketplace(spark, sf_dir)
    closed = t["orders"].filter(F.col("status").isin("cancelled", "delivered")).select("order_id")
    return quality.propagate_delete(t, "orders", closed)
