"""Batches of requests derived from the supplied tables, applied by the change operators, sources and the stream.

Each operator has one key for the new state and one for the rejected requests.
"""

from pyspark.sql import DataFrame, functions as F

from tradewind import schema
from tradewind.functions import ntz
from tradewind.operators import changes, people
from tradewind.session import work_folder
from tradewind.sources import evolve_schema, insert_if_absent, load_marketplace, load_requests, write_snapshot
from tradewind.streaming import payments_stream

from .registry import query
from .star import AS_OF, CATEGORY_SQL, EPOCH, category, event_key, item_columns, marketplace, money, sql, text

_AS_OF = f"TIMESTAMP '{AS_OF}'"


def _now():
    return ntz(AS_OF)


def _case(column: str, *pairs, otherwise=None):
    chain = F
    for value, result in pairs:
        chain = chain.when(F.col(column) == value, result)
    return chain.otherwise(otherwise) if otherwise is not None else chain


def _numbered(requests: str, *columns: str) -> str:
    """Requests with `copy`: 1 for the row of an id that counts. `columns`: all others in the order of their names."""
    order = ", ".join(f"{c} NULLS FIRST" for c in ("request_ts", *columns))
    return f"SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {order}) AS copy FROM ({requests})"


def _rejected(view: str) -> str:
    return f"SELECT request_id, request_ts, reason FROM {view} WHERE reason IS NOT NULL"


# --- registration: one request per sign-up event

_REGISTER = {
    "q": r"""SELECT 'E' || event_id AS request_id, ts AS request_ts,
  CASE WHEN event_id % 23 = 0 THEN '' ELSE '  user ' || user_id || chr(9) END AS name,
  CASE WHEN event_id % 17 = 0 THEN 'user' || user_id || '@example'
       WHEN event_id % 7 = 0 THEN 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') || '@example.com'
       ELSE 'User' || user_id || '@Example.com' END AS email,
  CASE WHEN event_id % 19 = 0 THEN 'abcd' ELSE 'secret' || user_id END AS password, 'h' || event_id AS password_hash,
  CASE WHEN event_id % 2 = 0 THEN '' ELSE '08' || user_id END AS phone,
  CASE event_id % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'seller' WHEN 2 THEN 'buyer' END AS role
  FROM events WHERE event_type = 'signup'""",
    "checked": r"""SELECT *, lower(email) AS login, CASE WHEN name = '' THEN 'missing_field'
  WHEN length(password) < 6 THEN 'password_too_short'
  WHEN NOT regexp_full_match(email, '[^\s@]+@[^\s@]+\.[^\s@]+') THEN 'bad_email'
  WHEN lower(email) IN (SELECT email FROM m_users) THEN 'duplicate' END AS early FROM q""",
    "judged": """SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN row_number() OVER (
  PARTITION BY login, early IS NULL ORDER BY request_ts, request_id) > 1 THEN 'duplicate' END AS reason FROM checked""",
    "added": """SELECT sha256('user:' || request_id) AS user_id, trim(name, ' ' || chr(9)) AS name, login AS email,
  password_hash AS password, nullif(phone, '') AS phone, CASE WHEN role = 'seller' THEN 'seller' ELSE 'buyer' END AS role,
  request_ts AS created_at FROM judged WHERE reason IS NULL""",
}


def _register(spark, sf_dir):
    t = marketplace(spark, sf_dir)
    e, user = F.col("event_id"), text("user_id")
    requests = t.raw("events").filter(F.col("event_type") == "signup").select(
        F.concat(F.lit("E"), text("event_id")).alias("request_id"), F.col("ts").alias("request_ts"),
        F.when(e % 23 == 0, "").otherwise(F.concat(F.lit("  user "), user, F.lit("\t"))).alias("name"),
        F.when(e % 17 == 0, F.concat(F.lit("user"), user, F.lit("@example")))
        .when(e % 7 == 0, F.concat(F.lit("Customer#"), F.lpad(user, 9, "0"), F.lit("@example.com")))
        .otherwise(F.concat(F.lit("User"), user, F.lit("@Example.com"))).alias("email"),
        F.when(e % 19 == 0, "abcd").otherwise(F.concat(F.lit("secret"), user)).alias("password"),
        F.concat(F.lit("h"), text("event_id")).alias("password_hash"),
        F.when(e % 2 == 0, "").otherwise(F.concat(F.lit("08"), user)).alias("phone"),
        F.when(e % 5 == 0, "admin").when(e % 5 == 1, "seller").when(e % 5 == 2, "buyer").alias("role"),
    )
    return changes.register_users(t, requests)


@query("register_users", sql("""SELECT user_id, name, email, password, phone, role, is_verified, created_at, c.cart_id FROM (
  SELECT user_id, name, email, password, phone, role, is_verified, created_at FROM m_users
  UNION ALL SELECT user_id, name, email, password, phone, role, role = 'buyer', created_at FROM added) u
  LEFT JOIN (SELECT cart_id, buyer_id FROM m_cart UNION ALL
  SELECT sha256('cart:' || user_id), user_id FROM added WHERE role = 'buyer') c ON c.buyer_id = u.user_id""", **_REGISTER))
def register_users(spark, sf_dir) -> DataFrame:
    state = _register(spark, sf_dir).tables
    carts = state["cart"].select("cart_id", F.col("buyer_id").alias("user_id"))
    return state["users"].join(carts, "user_id", "left").select(
        "user_id", "name", "email", "password", "phone", "role", "is_verified", "created_at", "cart_id")


@query("register_users_rejected", sql(_rejected("judged"), **_REGISTER))
def register_users_rejected(spark, sf_dir) -> DataFrame:
    return _register(spark, sf_dir).rejected


# --- new listings: every part is offered again, once as a pet and once as a product

_OFFER = """SELECT 'L' || p_partkey AS request_id,
  TIMESTAMP '1995-01-01 00:00:00' + to_minutes(CAST(p_partkey AS INTEGER)) AS request_ts, 'S' || p_size AS actor_id,
  CASE WHEN p_partkey % 9 = 0 THEN 'buyer' ELSE 'seller' END AS actor_role,
  CASE WHEN p_partkey % 31 = 0 THEN '' ELSE p_name END AS label, p_type AS species, p_brand AS breed,
  CASE p_size % 3 WHEN 0 THEN 'Jantan' WHEN 1 THEN 'Betina' ELSE 'none' END AS gender,
  CASE p_size WHEN 1 THEN 0 WHEN 2 THEN -5 ELSE CAST(p_retailprice AS DECIMAL(12,2)) END AS price,
  CASE WHEN p_size > 10 THEN p_size END AS stock, CASE WHEN p_size > 20 THEN p_size END AS age_month,
  CASE WHEN p_size = 3 THEN 99 ELSE CAST({cat} AS INTEGER) END AS category_id FROM part"""
_CREATE = {
    "q": _OFFER.format(cat=CATEGORY_SQL),
    "new_pets": """SELECT *, CASE WHEN actor_role <> 'seller' THEN 'forbidden'
  WHEN label = '' OR price = 0 THEN 'missing_field' WHEN gender = 'none' THEN 'bad_enum'
  WHEN price < 0 THEN 'constraint' END AS reason FROM q""",
    "new_products": """SELECT *, CASE WHEN actor_role <> 'seller' THEN 'forbidden'
  WHEN label = '' OR price = 0 THEN 'missing_field' WHEN price < 0 OR category_id = 99 THEN 'constraint' END AS reason
  FROM q""",
}


def _create(spark, sf_dir, kind):
    t = marketplace(spark, sf_dir)
    size, key = F.col("p_size"), F.col("p_partkey")
    common = t.raw("part").select(
        F.concat(F.lit("L"), text("p_partkey")).alias("request_id"),
        (F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(mins=key.cast("int"))).alias("request_ts"),
        F.concat(F.lit("S"), text("p_size")).alias("actor_id"),
        F.when(key % 9 == 0, "buyer").otherwise("seller").alias("actor_role"),
        F.when(key % 31 == 0, "").otherwise(F.col("p_name")).alias("label"),
        F.col("p_type").alias("species"), F.col("p_brand").alias("breed"),
        F.when(size % 3 == 0, "Jantan").when(size % 3 == 1, "Betina").otherwise("none").alias("gender"),
        F.when(size == 1, 0).when(size == 2, -5).otherwise(money("p_retailprice")).cast("decimal(12,2)").alias("price"),
        F.when(size > 10, size).alias("stock"), F.when(size > 20, size).alias("age_month"),
        F.when(size == 3, 99).otherwise(category()).alias("category_id"),
    )
    if kind == "pet":
        requests = common.withColumnRenamed("label", "pet_name").drop("category_id")
    else:
        requests = common.withColumnRenamed("label", "product_name").drop("species", "breed", "gender", "age_month")
    return changes.create_listings(t, kind, requests)


@query("create_listings", sql("""SELECT 'pet' AS kind, pet_id AS item_id, seller_id, pet_name AS name, price, stock,
  age_month, CAST(NULL AS INTEGER) AS category_id, is_active, created_at FROM m_pets
  UNION ALL SELECT 'pet', sha256('pet:' || request_id), actor_id, label, price, coalesce(stock, 0),
  coalesce(age_month, 0), NULL, true, request_ts FROM new_pets WHERE reason IS NULL
  UNION ALL SELECT 'product', product_id, seller_id, product_name, price, stock, NULL, category_id, is_active, created_at
  FROM m_products
  UNION ALL SELECT 'product', sha256('product:' || request_id), actor_id, label, price, coalesce(stock, 0), NULL,
  category_id, true, request_ts FROM new_products WHERE reason IS NULL""", **_CREATE))
def create_listings(spark, sf_dir) -> DataFrame:
    pets = _create(spark, sf_dir, "pet").tables["pets"].withColumn("category_id", F.lit(None).cast("int"))
    products = _create(spark, sf_dir, "product").tables["products"].withColumn("age_month", F.lit(None).cast("int"))
    of = lambda rows, kind: rows.select(
        F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("item_id"), "seller_id", F.col(f"{kind}_name").alias("name"),
        "price", "stock", "age_month", "category_id", "is_active", "created_at")
    return of(pets, "pet").unionByName(of(products, "product"))


@query("create_listings_rejected", sql("""SELECT 'pet' AS kind, request_id, request_ts, reason FROM new_pets
  WHERE reason IS NOT NULL UNION ALL SELECT 'product', request_id, request_ts, reason FROM new_products
  WHERE reason IS NOT NULL""", **_CREATE))
def create_listings_rejected(spark, sf_dir) -> DataFrame:
    of = lambda kind: _create(spark, sf_dir, kind).rejected.withColumn("kind", F.lit(kind))
    return of("pet").unionByName(of("product"))


# --- patches and deletions: one request per order line, by its supplier or by an administrator

_BY_LINE = """l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS request_id,
  l_shipdate AS request_ts, 'S' || l_suppkey AS actor_id"""


def _line_requests(t, **columns):
    key = F.concat_ws("-", *[text(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    return t.raw("lineitem").select(
        key.alias("request_id"), F.col("l_shipdate").alias("request_ts"),
        F.concat(F.lit("S"), text("l_suppkey")).alias("actor_id"),
        *[column.alias(name) for name, column in columns.items()],
    )


_PATCH = {
    "q": _numbered(f"""SELECT {_BY_LINE}, CASE l_linenumber WHEN 1 THEN 'admin' WHEN 2 THEN 'buyer' ELSE 'seller' END AS actor_role,
  CAST(l_partkey AS VARCHAR) AS product_id,
  CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_discount >= 0.095 THEN -1 ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END END
  AS price, CASE l_returnflag WHEN 'R' THEN CAST(l_quantity AS INTEGER) WHEN 'N' THEN 0 END AS stock,
  CASE WHEN l_linestatus = 'F' THEN l_returnflag = 'N' END AS is_active,
  CASE l_returnflag WHEN 'N' THEN '' WHEN 'R' THEN 'renamed ' || l_linenumber END AS product_name FROM lineitem""",
                   "actor_id", "actor_role", "is_active", "price", "product_id", "product_name", "stock"),
    "judged": """SELECT q.*, CASE WHEN copy > 1 THEN 'duplicate_request' WHEN actor_role = 'buyer' THEN 'forbidden'
  WHEN p.product_id IS NULL THEN 'not_found' WHEN actor_role = 'seller' AND p.seller_id <> actor_id THEN 'forbidden' WHEN q.price < 0 THEN 'constraint' END AS reason
  FROM q LEFT JOIN m_products p ON p.product_id = q.product_id""",
    "folded": """SELECT product_id, last(price ORDER BY request_ts, request_id) FILTER (price IS NOT NULL) AS price,
  last(stock ORDER BY request_ts, request_id) FILTER (stock > 0) AS stock,
  last(is_active ORDER BY request_ts, request_id) FILTER (is_active IS NOT NULL) AS is_active,
  last(product_name ORDER BY request_ts, request_id) FILTER (product_name <> '') AS product_name
  FROM judged WHERE reason IS NULL GROUP BY product_id""",
}


def _patch(spark, sf_dir):
    t = marketplace(spark, sf_dir)
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    price = F.when(F.col("l_discount") >= 0.095, F.lit(-1)).otherwise(money("l_extendedprice")).cast("decimal(12,2)")
    requests = _line_requests(
        t,
        actor_role=F.when(line == 1, "admin").when(line == 2, "buyer").otherwise("seller"),
        product_id=text("l_partkey"),
        price=F.when(flag == "A", price),
        stock=F.when(flag == "R", F.col("l_quantity").cast("int")).when(flag == "N", 0),
        is_active=F.when(F.col("l_linestatus") == "F", flag == "N"),
        product_name=F.when(flag == "N", "").when(flag == "R", F.concat(F.lit("renamed "), text("l_linenumber"))),
    )
    return changes.patch_rows(t, changes.PRODUCT_PATCH, requests, _now())


@query("patch_rows", sql(f"""SELECT p.product_id, p.seller_id, coalesce(f.product_name, p.product_name) AS product_name,
  coalesce(f.price, p.price) AS price, coalesce(f.stock, p.stock) AS stock, coalesce(f.is_active, p.is_active) AS is_active,
  p.category_id, CASE WHEN f.product_id IS NOT NULL THEN {_AS_OF} ELSE p.updated_at END AS updated_at
  FROM m_products p LEFT JOIN folded f ON f.product_id = p.product_id""", **_PATCH))
def patch_rows(spark, sf_dir) -> DataFrame:
    return _patch(spark, sf_dir).tables["products"].select(
        "product_id", "seller_id", "product_name", "price", "stock", "is_active", "category_id", "updated_at")


@query("patch_rows_rejected", sql(_rejected("judged"), **_PATCH))
def patch_rows_rejected(spark, sf_dir) -> DataFrame:
    return _patch(spark, sf_dir).rejected


_PROFILE = {
    "q": """SELECT CAST(o_orderkey AS VARCHAR) AS request_id, o_orderdate AS request_ts, 'C' || o_custkey AS user_id,
  CASE o_orderstatus WHEN 'F' THEN '' WHEN 'O' THEN '07' || o_orderkey END AS phone,
  CASE o_orderpriority WHEN '5-LOW' THEN '' WHEN '1-URGENT' THEN NULL ELSE o_orderpriority END AS address,
  CASE WHEN o_orderpriority = '2-HIGH' THEN '12345678901' WHEN o_orderstatus = 'P' THEN '40' END AS postal_code FROM orders""",
    "folded": """SELECT user_id, last(phone ORDER BY request_ts, request_id) FILTER (phone <> '') AS phone,
  last(address ORDER BY request_ts, request_id) FILTER (address IS NOT NULL) AS address,
  last(postal_code ORDER BY request_ts, request_id) FILTER (postal_code IS NOT NULL) AS postal_code
  FROM q WHERE coalesce(length(postal_code), 0) <= 10 GROUP BY user_id""",
}


@query("patch_profiles", sql(f"""SELECT u.user_id, coalesce(f.phone, u.phone) AS phone, coalesce(f.address, u.address) AS address,
  coalesce(f.postal_code, u.postal_code) AS postal_code,
  CASE WHEN f.user_id IS NOT NULL THEN {_AS_OF} ELSE u.updated_at END AS updated_at
  FROM m_users u LEFT JOIN folded f ON f.user_id = u.user_id""", **_PROFILE))
def patch_profiles(spark, sf_dir) -> DataFrame:
    t = marketplace(spark, sf_dir)
    user, priority, state = F.concat(F.lit("C"), text("o_custkey")), F.col("o_orderpriority"), F.col("o_orderstatus")
    requests = t.raw("orders").select(
        text("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("request_ts"), user.alias("actor_id"),
        F.lit("buyer").alias("actor_role"), user.alias("user_id"),
        F.when(state == "F", "").when(state == "O", F.concat(F.lit("07"), text("o_orderkey"))).alias("phone"),
        F.when(priority == "5-LOW", "").when(priority != "1-URGENT", priority).alias("address"),
        F.when(priority == "2-HIGH", "12345678901").when(state == "P", "40").alias("postal_code"),
    )
    return changes.patch_rows(t, changes.PROFILE_PATCH, requests, _now()).tables["users"].select(
        "user_id", "phone", "address", "postal_code", "updated_at")


@query("patch_users", sql("""SELECT u.user_id, CASE WHEN s_nationkey = 4 THEN 'buyer' ELSE u.role END AS role,
  coalesce(s_acctbal > 500, u.is_verified) AS is_verified, u.is_active FROM m_users u
  LEFT JOIN supplier ON 'S' || s_suppkey = u.user_id AND s_nationkey <> 3"""))
def patch_users(spark, sf_dir) -> DataFrame:
    t = marketplace(spark, sf_dir)
    nation = F.col("s_nationkey")
    requests = t.raw("supplier").select(
        text("s_suppkey").alias("request_id"), F.lit(EPOCH).cast("timestamp_ntz").alias("request_ts"),
        F.lit("A0").alias("actor_id"), F.lit("admin").alias("actor_role"),
        F.concat(F.lit("S"), text("s_suppkey")).alias("user_id"),
        F.when(nation == 3, "owner").when(nation == 4, "buyer").when(nation == 5, "").alias("role"),
        (F.col("s_acctbal") > 500).alias("is_verified"), F.lit(None).cast("boolean").alias("is_active"),
    )
    return changes.patch_rows(t, changes.ADMIN_USER_PATCH, requests, _now()).tables["users"].select(
        "user_id", "role", "is_verified", "is_active")


_DELETE = {
    "q": _numbered(f"""SELECT {_BY_LINE}, CASE WHEN l_linenumber = 7 THEN 'buyer' ELSE 'seller' END AS actor_role,
  CAST(l_partkey AS VARCHAR) AS target_id FROM lineitem""", "actor_id", "actor_role", "target_id"),
    "judged": """SELECT q.*, CASE WHEN copy > 1 THEN 'duplicate_request' WHEN actor_role = 'buyer' THEN 'forbidden'
  WHEN p.product_id IS NULL THEN 'not_found'
  WHEN p.seller_id <> actor_id THEN 'forbidden' END AS reason FROM q LEFT JOIN m_products p ON p.product_id = target_id""",
    "removals": """SELECT 'C' || c_custkey AS target_id, 'C' || c_custkey AS request_id,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'seller' ELSE 'admin' END AS actor_role, 'A' || c_nationkey AS actor_id FROM customer
  UNION ALL SELECT 'A' || n_nationkey, 'N' || n_nationkey, 'admin', 'A' || n_regionkey FROM nation""",
    "judged_removals": """SELECT r.*, CASE WHEN actor_role <> 'admin' THEN 'forbidden' WHEN target_id = actor_id
  THEN 'self_delete' END AS reason FROM removals r""",
}


def _delete_products(spark, sf_dir):
    t = marketplace(spark, sf_dir)
    requests = _line_requests(
        t, actor_role=F.when(F.col("l_linenumber") == 7, "buyer").otherwise("seller"), target_id=text("l_partkey"))
    return changes.soft_delete(t, "products", requests, _now())


def _delete_users(spark, sf_dir):
    t = marketplace(spark, sf_dir)
    customer, nation = F.concat(F.lit("C"), text("c_custkey")), text("n_nationkey")
    requests = t.raw("customer").select(
        customer.alias("target_id"), customer.alias("request_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", "seller").otherwise("admin").alias("actor_role"),
        F.concat(F.lit("A"), text("c_nationkey")).alias("actor_id"),
    ).unionByName(t.raw("nation").select(
        F.concat(F.lit("A"), nation).alias("target_id"), F.concat(F.lit("N"), nation).alias("request_id"),
        F.lit("admin").alias("actor_role"), F.concat(F.lit("A"), text("n_regionkey")).alias("actor_id"),
    )).withColumn("request_ts", F.lit(EPOCH).cast("timestamp_ntz"))
    return changes.soft_delete(t, "users", requests, _now())


@query("soft_delete", sql(f"""SELECT 'product' AS kind, product_id AS row_key, is_active AND d.target_id IS NULL AS is_active,
  CASE WHEN d.target_id IS NULL THEN updated_at ELSE {_AS_OF} END AS updated_at FROM m_products
  LEFT JOIN (SELECT DISTINCT target_id FROM judged WHERE reason IS NULL) d ON d.target_id = product_id
  UNION ALL SELECT 'user', user_id, is_active AND d.target_id IS NULL,
  CASE WHEN d.target_id IS NULL THEN updated_at ELSE {_AS_OF} END FROM m_users
  LEFT JOIN (SELECT DISTINCT target_id FROM judged_removals WHERE reason IS NULL) d ON d.target_id = user_id""", **_DELETE))
def soft_delete(spark, sf_dir) -> DataFrame:
    of = lambda rows, kind: rows.select(
        F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("row_key"), "is_active", "updated_at")
    products = _delete_products(spark, sf_dir).tables["products"]
    return of(products, "product").unionByName(of(_delete_users(spark, sf_dir).tables["users"], "user"))


@query("soft_delete_rejected", sql("""SELECT request_id, reason FROM judged WHERE reason IS NOT NULL
  UNION ALL SELECT request_id, reason FROM judged_removals WHERE reason IS NOT NULL""", **_DELETE))
def soft_delete_rejected(spark, sf_dir) -> DataFrame:
    rejected = _delete_products(spark, sf_dir).rejected.unionByName(_delete_users(spark, sf_dir).rejected)
    return rejected.select("request_id", "reason")


# --- carts: one request per event

_EVENT = """SELECT *, 'E' || event_id AS request_id, ts AS request_ts, 'C' || user_id AS actor_id,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"""


def _events(t) -> DataFrame:
    return t.raw("events").withColumns({
        "request_id": F.concat(F.lit("E"), text("event_id")), "request_ts": F.col("ts"),
        "actor_id": F.concat(F.lit("C"), text("user_id")), "k": event_key(),
    })


_ADD = {
    "e": _EVENT,
    "q": """SELECT request_id, request_ts, actor_id, CASE event_type WHEN 'error' THEN 'seller' ELSE 'buyer' END AS actor_role,
  CASE WHEN event_id % 29 = 0 THEN 'toy' WHEN part % 4 = 0 THEN 'pet' ELSE 'product' END AS item_type,
  CAST(part AS VARCHAR) AS item_id, CASE WHEN event_type = 'view' THEN 1 ELSE CAST(event_id % 5 AS INTEGER) END AS quantity
  FROM (SELECT *, CASE WHEN event_id % 13 = 0 THEN k + 100000000 ELSE k END AS part FROM e)""",
    "judged": """SELECT q.*, CASE WHEN actor_role = 'seller' THEN 'forbidden' WHEN q.item_type = 'toy' THEN 'bad_enum'
  WHEN NOT coalesce(i.is_active, false) THEN 'not_found' WHEN i.stock < quantity THEN 'out_of_stock'
  WHEN quantity < 1 THEN 'constraint' END AS reason
  FROM q LEFT JOIN m_items i ON i.item_type = q.item_type AND i.item_id = q.item_id""",
    "added": """SELECT c.cart_id, j.item_type, j.item_id, CAST(sum(quantity) AS INTEGER) AS quantity,
  first(request_ts ORDER BY request_ts, request_id) AS created_at FROM judged j JOIN m_cart c ON c.buyer_id = j.actor_id
  WHERE reason IS NULL GROUP BY ALL""",
}


def _add_requests(t) -> DataFrame:
    e = F.col("event_id")
    parts = _events(t).withColumn("part", F.when(e % 13 == 0, F.col("k") + 100000000).otherwise(F.col("k")))
    return parts.select(
        "request_id", "request_ts", "actor_id",
        F.when(F.col("event_type") == "error", "seller").otherwise("buyer").alias("actor_role"), *item_columns("part"),
        F.when(F.col("event_type") != "view", e % 5).cast("int").alias("quantity"), "event_id", (F.col("event_type") == "view").alias("is_view"),
    ).withColumn("item_type", F.when(e % 29 == 0, "toy").otherwise(F.col("item_type"))).drop("event_id")


def _add(spark, sf_dir):
    t = marketplace(spark, sf_dir)
    return changes.add_to_cart(t, _add_requests(t).drop("is_view"))


@query("add_to_cart", sql("""SELECT coalesce(l.cart_id, a.cart_id) AS cart_id,
  coalesce(l.item_id, sha256('line:' || a.cart_id || ':' || a.item_type || ':' || a.item_id)) AS item_id,
  coalesce(l.item_type, a.item_type) AS item_type, coalesce(l.pet_id, l.product_id, a.item_id) AS listing_id,
  CAST(coalesce(l.quantity, 0) + coalesce(a.quantity, 0) AS INTEGER) AS quantity,
  coalesce(l.created_at, a.created_at) AS created_at
  FROM m_cart_items l FULL JOIN added a ON a.cart_id = l.cart_id AND a.item_type = l.item_type
  AND a.item_id = coalesce(l.pet_id, l.product_id)""", **_ADD))
def add_to_cart(spark, sf_dir) -> DataFrame:
    return _add(spark, sf_dir).tables["cart_items"].select(
        "cart_id", "item_id", "item_type", F.coalesce("pet_id", "product_id").alias("listing_id"), "quantity", "created_at")


@query("add_to_cart_rejected", sql(_rejected("judged"), **_ADD))
def add_to_cart_rejected(spark, sf_dir) -> DataFrame:
    return _add(spark, sf_dir).rejected


_EDIT = {
    "e": _EVENT,
    "q": """SELECT request_id, request_ts, actor_id, 'K' || user_id AS cart_id,
  CASE WHEN event_type = 'signup' THEN 'swap' WHEN event_type = 'purchase' THEN 'remove'
       WHEN event_type = 'error' AND "value" >= 300 THEN 'clear' ELSE 'set' END AS op,
  CASE WHEN event_id % 3 = 0 THEN 'K' || (user_id + 1) ELSE 'K' || user_id END || '-' || k AS item_id,
  CAST(event_id % 7 AS INTEGER) AS quantity FROM e""",
    "sound": """SELECT q.*, CASE WHEN op = 'swap' THEN 'bad_enum' WHEN op = 'set' AND q.quantity < 1 THEN 'out_of_range' END AS early,
  coalesce(l.cart_id = q.cart_id, false) AS mine FROM q LEFT JOIN m_cart_items l ON l.item_id = q.item_id""",
    "ended": """SELECT l.item_id, min({'ts': s.request_ts, 'id': s.request_id}) AS till FROM m_cart_items l JOIN sound s
  ON s.cart_id = l.cart_id AND (s.op = 'clear' OR (s.op = 'remove' AND s.item_id = l.item_id)) GROUP BY l.item_id""",
    "judged": """SELECT s.*, CASE WHEN early IS NOT NULL THEN early WHEN op = 'clear' THEN NULL WHEN NOT mine THEN 'not_found'
  WHEN {'ts': s.request_ts, 'id': s.request_id} > e.till THEN 'not_found' END AS reason
  FROM sound s LEFT JOIN ended e ON e.item_id = s.item_id""",
}


def _edit(spark, sf_dir):
    t = marketplace(spark, sf_dir)
    kind, user = F.col("event_type"), F.col("user_id")
    op = (
        F.when(kind == "signup", "swap").when(kind == "purchase", "remove")
        .when((kind == "error") & (F.col("value") >= 300), "clear").otherwise("set")
    )
    cart_user = F.when(F.col("event_id") % 3 == 0, user + 1).otherwise(user)
    requests = _events(t).select(
        "request_id", "request_ts", "actor_id", F.lit("buyer").alias("actor_role"), op.alias("op"),
        F.concat(F.lit("K"), cart_user.cast("string"), F.lit("-"), text("k")).alias("item_id"),
        (F.col("event_id") % 7).cast("int").alias("quantity"),
    )
    return changes.edit_cart(t, requests)


@query("edit_cart", sql("""SELECT l.item_id, l.cart_id, CAST(coalesce(f.quantity, l.quantity) AS INTEGER) AS quantity, l.created_at
  FROM m_cart_items l LEFT JOIN (SELECT item_id, last(quantity ORDER BY request_ts, request_id) AS quantity FROM judged
  WHERE reason IS NULL AND op = 'set' GROUP BY item_id) f ON f.item_id = l.item_id
  WHERE l.item_id NOT IN (SELECT item_id FROM ended)""", **_EDIT))
def edit_cart(spark, sf_dir) -> DataFrame:
    return _edit(spark, sf_dir).tables["cart_items"].select("item_id", "cart_id", "quantity", "created_at")


@query("edit_cart_rejected", sql(_rejected("judged"), **_EDIT))
def edit_cart_rejected(spark, sf_dir) -> DataFrame:
    return _edit(spark, sf_dir).rejected


# --- order status: one request per order line

_STATUS = {
    "q": _numbered(f"""SELECT {_BY_LINE.replace("'S' || l_suppkey", "'S' || CASE WHEN l_returnflag = 'N' THEN l_linenumber ELSE l_suppkey END")},
  CASE WHEN l_linenumber = 1 THEN 'admin' WHEN l_tax >= 0.075 THEN 'buyer' ELSE 'seller' END AS actor_role,
  CASE WHEN l_linenumber = 1 AND l_linestatus = 'O' THEN 'X' ELSE '' END || l_orderkey AS order_id,
  CASE CAST(l_quantity AS INTEGER) % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'shipped'
       WHEN 3 THEN 'delivered' WHEN 4 THEN 'cancelled' ELSE 'lost' END AS status FROM lineitem""",
                   "actor_id", "actor_role", "order_id", "status"),
    "judged": """SELECT q.*, CASE WHEN copy > 1 THEN 'duplicate_request' WHEN actor_role = 'buyer' THEN 'forbidden'
  WHEN status = 'lost' OR (status = 'pending' AND actor_role = 'seller') THEN 'bad_enum'
  WHEN actor_role = 'seller' AND w.order_id IS NULL THEN 'forbidden' WHEN o.order_id IS NULL THEN 'not_found' END AS reason
  FROM q LEFT JOIN (SELECT DISTINCT order_id, seller_id FROM m_order_items) w
  ON w.order_id = q.order_id AND w.seller_id = q.actor_id
  LEFT JOIN (SELECT order_id FROM m_orders) o ON o.order_id = q.order_id""",
}


def _status(spark, sf_dir):
    t = marketplace(spark, sf_dir)
    line, pieces = F.col("l_linenumber"), F.col("l_quantity").cast("int") % 6
    names = F.array(*[F.lit(s) for s in [*schema.ORDER_STATUS, "lost"]])
    seller = F.when(F.col("l_returnflag") == "N", line.cast("bigint")).otherwise(F.col("l_suppkey"))
    requests = _line_requests(
        t,
        actor_role=F.when(line == 1, "admin").when(F.col("l_tax") >= 0.075, "buyer").otherwise("seller"),
        order_id=F.concat(F.when((line == 1) & (F.col("l_linestatus") == "O"), "X").otherwise(""), text("l_orderkey")),
        status=F.get(names, pieces), seller=F.concat(F.lit("S"), seller.cast("string")),
    ).drop("actor_id").withColumnRenamed("seller", "actor_id")
    return changes.set_order_status(t, requests, _now())


@query("set_order_status", sql(f"""SELECT o.order_id, coalesce(f.status, o.status) AS status,
  CASE WHEN f.status IS NULL THEN o.updated_at ELSE {_AS_OF} END AS updated_at FROM m_orders o LEFT JOIN (
  SELECT order_id, last(status ORDER BY request_ts, request_id) AS status FROM judged WHERE reason IS NULL GROUP BY order_id) f
  ON f.order_id = o.order_id""", **_STATUS))
def set_order_status(spark, sf_dir) -> DataFrame:
    return _status(spark, sf_dir).tables["orders"].select("order_id", "status", "updated_at")


@query("set_order_status_rejected", sql(_rejected("judged"), **_STATUS))
def set_order_status_rejected(spark, sf_dir) -> DataFrame:
    return _status(spark, sf_dir).rejected


# --- payments: one update per event

_PAY = {
    "e": _EVENT,
    "q": """SELECT request_id, request_ts, 'P' || (user_id * 100 + k) AS payment_id,
  CASE event_type WHEN 'view' THEN 'paid' WHEN 'click' THEN 'unpaid' WHEN 'signup' THEN 'failed'
       WHEN 'purchase' THEN 'refunded' ELSE 'lost' END AS status,
  CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 2 = 0 THEN 'ref' || event_id END AS reference_no FROM e""",
    "judged": """SELECT q.*, p.order_id, CASE WHEN q.status = 'lost' THEN 'bad_enum' WHEN p.payment_id IS NULL THEN 'not_found'
  END AS reason FROM q LEFT JOIN m_payments p ON p.payment_id = q.payment_id""",
    "folded": """SELECT payment_id, order_id, last(status ORDER BY request_ts, request_id) AS status,
  last(reference_no ORDER BY request_ts, request_id) FILTER (reference_no <> '') AS reference_no,
  max(request_ts) AS last_ts, bool_or(status = 'paid') AS was_paid FROM judged WHERE reason IS NULL GROUP BY ALL""",
    "new_payments": f"""SELECT p.payment_id, p.order_id, coalesce(f.status, p.status) AS status,
  coalesce(f.reference_no, p.reference_no) AS reference_no,
  CASE WHEN f.status IS NULL THEN p.paid_at WHEN f.status = 'paid' THEN f.last_ts END AS paid_at,
  CASE WHEN f.status IS NULL THEN p.updated_at ELSE {_AS_OF} END AS updated_at
  FROM m_payments p LEFT JOIN folded f ON f.payment_id = p.payment_id""",
    "new_orders": f"""SELECT o.order_id, CASE WHEN moved THEN 'processing' ELSE o.status END AS status,
  CASE WHEN moved THEN {_AS_OF} ELSE o.updated_at END AS updated_at
  FROM (SELECT *, status = 'pending' AND order_id IN (SELECT order_id FROM folded WHERE was_paid) AS moved FROM m_orders) o""",
}
_PAY_STATE = """SELECT 'payment' AS kind, payment_id AS row_key, status, reference_no, paid_at FROM new_payments
  UNION ALL SELECT 'order', order_id, status, NULL, NULL FROM new_orders"""


def _payment_updates(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return events.select(
        F.concat(F.lit("E"), text("event_id")).alias("request_id"), F.col("ts").alias("request_ts"),
        F.concat(F.lit("P"), (F.col("user_id") * 100 + event_key()).cast("string")).alias("payment_id"),
        _case("event_type", ("view", "paid"), ("click", "unpaid"), ("signup", "failed"), ("purchase", "refunded"),
              otherwise="lost").alias("status"),
        F.when(e % 10 == 0, "").when(e % 2 == 0, F.concat(F.lit("ref"), text("event_id"))).alias("reference_no"),
    )


def _payment_state(tables) -> DataFrame:
    payments = tables["payments"].select(
        F.lit("payment").alias("kind"), F.col("payment_id").alias("row_key"), "status", "reference_no", "paid_at")
    orders = tables["orders"].select(F.lit("order").alias("kind"), F.col("order_id").alias("row_key"), "status")
    return payments.unionByName(orders, allowMissingColumns=True)


def _pay(spark, sf_dir):
    t = marketplace(spark, sf_dir)
    return changes.apply_payments(t, _payment_updates(t.raw("events")), _now())


@query("apply_payments", sql(_PAY_STATE, **_PAY))
def apply_payments(spark, sf_dir) -> DataFrame:
    return _payment_state(_pay(spark, sf_dir).tables)


@query("apply_payments_rejected", sql(_rejected("judged"), **_PAY))
def apply_payments_rejected(spark, sf_dir) -> DataFrame:
    return _pay(spark, sf_dir).rejected


@query("touch_updated_at", sql("""SELECT 'payment' AS kind, payment_id AS row_key, updated_at FROM new_payments
  UNION ALL SELECT 'order', order_id, updated_at FROM new_orders""", **_PAY))
def touch_updated_at(spark, sf_dir) -> DataFrame:
    tables = _pay(spark, sf_dir).tables
    of = lambda kind: tables[f"{kind}s"].select(
        F.lit(kind).alias("kind"), F.col(f"{kind}_id").alias("row_key"), "updated_at")
    return of("payment").unionByName(of("order"))


@query("payments_stream", sql(_PAY_STATE, **_PAY))
def stream_payments(spark, sf_dir) -> DataFrame:
    """The same updates read as a stream of files; any file order gives the same state."""
    t = marketplace(spark, sf_dir)
    events = spark.readStream.schema(t.raw("events").schema).parquet(f"{sf_dir}/events*.parquet")
    return _payment_state(payments_stream(t, _payment_updates(events), work_folder(spark, "payments"), _now()))


@query("payments_stream_rejected", sql(_rejected("judged"), **_PAY))
def stream_payments_rejected(spark, sf_dir) -> DataFrame:
    """What the stream refuses is what the batch refuses."""
    t = marketplace(spark, sf_dir)
    events = spark.readStream.schema(t.raw("events").schema).parquet(f"{sf_dir}/events*.parquet")
    return payments_stream(t, _payment_updates(events), work_folder(spark, "payments"), _now())["rejected"]


# --- reviews: one request per order line

_REVIEW = {
    "q": _numbered(f"""SELECT {_BY_LINE.split(", 'S'")[0]}, 'C' || CASE WHEN l_linenumber = 5 THEN o_custkey + 1 ELSE o_custkey END AS actor_id,
  CAST(l_orderkey AS VARCHAR) AS order_id, CASE WHEN l_partkey % 4 = 0 THEN 'pet' ELSE 'product' END AS item_type,
  CAST(l_partkey AS VARCHAR) AS item_id,
  CASE WHEN l_tax >= 0.075 THEN 2.5 WHEN l_tax >= 0.065 THEN 6 ELSE 1 + l_linenumber % 5 END AS rating
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey""", "actor_id", "item_type", "order_id", "item_id", "rating"),
    "checked": """SELECT q.*, CASE WHEN copy > 1 THEN 'duplicate_request' WHEN q.rating > 5 THEN 'out_of_range' WHEN o.order_id IS NULL THEN 'not_eligible'
  WHEN r.review_id IS NOT NULL THEN 'duplicate' END AS early FROM q
  LEFT JOIN m_orders o ON o.order_id = q.order_id AND o.buyer_id = q.actor_id AND o.status = 'delivered'
  LEFT JOIN m_reviews r ON r.reviewer_id = q.actor_id AND r.order_id = q.order_id AND r.item_type = q.item_type
  AND coalesce(r.pet_id, r.product_id) = q.item_id""",
    "judged": """SELECT *, CASE WHEN early IS NOT NULL THEN early
  WHEN count(*) FILTER (early IS NULL AND rating <> 2.5) OVER (PARTITION BY actor_id, order_id, item_type, item_id
       ORDER BY request_ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'duplicate'
  WHEN rating = 2.5 THEN 'constraint' END AS reason FROM checked""",
}


def _review(spark, sf_dir):
    t = marketplace(spark, sf_dir)
    line, tax = F.col("l_linenumber"), F.col("l_tax")
    key = F.concat_ws("-", *[text(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    joined = t.raw("lineitem").join(t.raw("orders").select("o_orderkey", "o_custkey"),
                                    F.col("o_orderkey") == F.col("l_orderkey"))
    buyer = F.when(line == 5, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    rating = F.when(tax >= 0.075, F.lit("2.5")).when(tax >= 0.065, F.lit("6")).otherwise((1 + line % 5).cast("string"))
    requests = joined.select(
        key.alias("request_id"), F.col("l_shipdate").alias("request_ts"),
        F.concat(F.lit("C"), buyer.cast("string")).alias("actor_id"), F.lit("buyer").alias("actor_role"),
        text("l_orderkey").alias("order_id"), *item_columns("l_partkey"), rating.cast("decimal(6,2)").alias("rating"),
        F.lit("").alias("comment"),
    )
    return changes.create_reviews(t, requests)


@query("create_reviews", sql("""SELECT review_id, reviewer_id, order_id, item_type, coalesce(pet_id, product_id) AS item_id, rating,
  comment, created_at FROM m_reviews UNION ALL SELECT sha256('review:' || request_id), actor_id, order_id, item_type, item_id,
  CAST(rating AS SMALLINT), NULL, request_ts FROM judged WHERE reason IS NULL""", **_REVIEW))
def create_reviews(spark, sf_dir) -> DataFrame:
    return _review(spark, sf_dir).tables["reviews"].select(
        "review_id", "reviewer_id", "order_id", "item_type", F.coalesce("pet_id", "product_id").alias("item_id"),
        "rating", "comment", "created_at")


@query("create_reviews_rejected", sql(_rejected("judged"), **_REVIEW))
def create_reviews_rejected(spark, sf_dir) -> DataFrame:
    return _review(spark, sf_dir).rejected


# --- settings (one request per event) and categories (one per part)

_NUMBER = r"""TRY_CAST(regexp_extract({0}, '^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1) AS DECIMAL(30,10))"""
_PLAIN = r"""regexp_replace(CAST({0} AS VARCHAR), '\.?0+$', '')"""
_SETTINGS = {
    "e": _EVENT,
    "q": """SELECT request_id, request_ts, CASE WHEN event_id % 11 = 0 THEN 'seller' ELSE 'admin' END AS actor_role,
  CASE event_type WHEN 'signup' THEN amount || 'abc' WHEN 'error' THEN 'none' WHEN 'purchase' THEN '1' || amount
       WHEN 'click' THEN amount END AS fee_text,
  CASE event_type WHEN 'view' THEN ' ' || k || '.50' WHEN 'click' THEN '-' || (1 + k) WHEN 'purchase' THEN k || 'e2' END AS shipping_text
  FROM (SELECT *, CAST(CAST("value" AS DECIMAL(12,2)) AS VARCHAR) AS amount FROM e)""",
    "parsed": f"SELECT *, {_NUMBER.format('fee_text')} AS fee, {_NUMBER.format('shipping_text')} AS shipping FROM q",
    "judged": """SELECT *, fee_text IS NULL OR coalesce(fee BETWEEN 0 AND 100, false) AS good_fee,
  shipping_text IS NULL OR coalesce(shipping >= 0, false) AS good_shipping,
  CASE WHEN actor_role <> 'admin' THEN 'forbidden' WHEN NOT ((fee_text IS NULL OR coalesce(fee BETWEEN 0 AND 100, false))
  AND (shipping_text IS NULL OR coalesce(shipping >= 0, false))) THEN 'out_of_range' END AS reason FROM parsed""",
    "writes": f"""SELECT 'platform_fee_percent' AS key, {_PLAIN.format('fee')} AS value, request_ts, request_id FROM judged
  WHERE actor_role = 'admin' AND good_fee AND fee IS NOT NULL
  UNION ALL SELECT 'shipping_cost', {_PLAIN.format('shipping')}, request_ts, request_id FROM judged
  WHERE actor_role = 'admin' AND good_fee AND good_shipping AND shipping IS NOT NULL""",
    "state": """SELECT key, last(value ORDER BY request_ts, request_id) AS value, max(request_ts) AS updated_at FROM writes GROUP BY key""",
}


def _settings_change(spark, sf_dir):
    t = marketplace(spark, sf_dir)
    amount, k, kind = F.col("value").cast("decimal(12,2)").cast("string"), text("k"), F.col("event_type")
    requests = _events(t).select(
        "request_id", "request_ts", "actor_id",
        F.when(F.col("event_id") % 11 == 0, "seller").otherwise("admin").alias("actor_role"),
        F.when(kind == "signup", F.concat(amount, F.lit("abc"))).when(kind == "error", "none")
        .when(kind == "purchase", F.concat(F.lit("1"), amount)).when(kind == "click", amount).alias("platform_fee_percent"),
        F.when(kind == "view", F.concat(F.lit(" "), k, F.lit(".50")))
        .when(kind == "click", F.concat(F.lit("-"), (1 + F.col("k")).cast("string")))
        .when(kind == "purchase", F.concat(k, F.lit("e2"))).alias("shipping_cost"),
    )
    return changes.upsert_settings(t, requests)


@query("upsert_settings", sql("SELECT key, value, updated_at FROM state", **_SETTINGS))
def upsert_settings(spark, sf_dir) -> DataFrame:
    return _settings_change(spark, sf_dir).tables["app_settings"]


@query("upsert_settings_rejected", sql(_rejected("judged"), **_SETTINGS))
def upsert_settings_rejected(spark, sf_dir) -> DataFrame:
    return _settings_change(spark, sf_dir).rejected


@query("effective_settings", sql("""SELECT CAST(max(value) FILTER (key = 'platform_fee_percent') AS DECIMAL(9,4))
  AS platform_fee_percent, CAST(max(value) FILTER (key = 'shipping_cost') AS DECIMAL(12,2)) AS shipping_cost FROM state""",
    **_SETTINGS))
def effective_settings(spark, sf_dir) -> DataFrame:
    """The settings in force after all requests of the event table."""
    return people.effective_settings(_settings_change(spark, sf_dir).tables)


_CATEGORY = {
    "q": """SELECT 'L' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS request_id,
  TIMESTAMP '1995-01-01 00:00:00' + to_hours(p_size) AS request_ts,
  CASE WHEN p_size % 8 = 0 THEN 'seller' ELSE 'admin' END AS actor_role,
  CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN p_type ELSE ' ' || p_brand || ' ' || p_name || ' ' END AS name
  FROM part""",
    "checked": """SELECT *, trim(name) AS label, CASE WHEN actor_role <> 'admin' THEN 'forbidden' WHEN name = '' THEN 'missing_field'
  WHEN trim(name) IN (SELECT name FROM m_categories) THEN 'duplicate' END AS early FROM q""",
    "judged": """SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN row_number() OVER (PARTITION BY label, early IS NULL
  ORDER BY request_ts, request_id) > 1 THEN 'duplicate' END AS reason FROM checked""",
}


def _categories_change(spark, sf_dir):
    t = marketplace(spark, sf_dir)
    size, key = F.col("p_size"), F.col("p_partkey")
    label = F.concat(F.lit(" "), F.col("p_brand"), F.lit(" "), F.col("p_name"), F.lit(" "))
    requests = t.raw("part").select(
        F.concat(F.lit("L"), F.lpad(text("p_partkey"), 12, "0")).alias("request_id"),
        (F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(hours=size)).alias("request_ts"),
        F.when(size % 8 == 0, "seller").otherwise("admin").alias("actor_role"),
        F.when(key % 17 == 0, "").when(key % 5 == 0, F.col("p_type")).otherwise(label).alias("name"),
        F.lit(None).cast("string").alias("icon"), F.lit("").alias("description"),
    )
    return changes.create_categories(t, requests)


@query("create_categories", sql("""SELECT category_id, name, created_at FROM m_categories UNION ALL
  SELECT CAST(7 + row_number() OVER (ORDER BY request_ts, request_id) AS INTEGER), label, request_ts FROM judged
  WHERE reason IS NULL""", **_CATEGORY))
def create_categories(spark, sf_dir) -> DataFrame:
    return _categories_change(spark, sf_dir).tables["categories"].select("category_id", "name", "created_at")


@query("create_categories_rejected", sql(_rejected("judged"), **_CATEGORY))
def create_categories_rejected(spark, sf_dir) -> DataFrame:
    return _categories_change(spark, sf_dir).rejected


# --- checkout of every cart, among requests that name their items

# A service that takes one request after the other: a recursion over the requests in order, which carries what was
# sold per item and whose cart was emptied.
_CHECKOUT = {
    "c_requests": """SELECT 'O' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS request_id, 'C' || c_custkey AS actor_id, false AS direct,
  TIMESTAMP '1995-01-01 00:00:00' + to_minutes(CAST(trunc(c_acctbal) AS INTEGER)) AS request_ts,
  CASE WHEN c_nationkey = 0 THEN '' ELSE 'street ' || c_custkey END AS address, c_custkey % 17 = 0 AS bad_postal,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'cheque' WHEN 'MACHINERY' THEN 'cod' ELSE 'transfer' END AS method FROM customer
  UNION ALL SELECT 'D' || lpad(CAST(event_id AS VARCHAR), 12, '0'), 'C' || user_id, true,
  TIMESTAMP '1995-01-01 00:00:00' + to_minutes(CAST(event_id % 9000 AS INTEGER)), 'home', event_id % 13 = 0,
  CASE WHEN event_id % 11 = 0 THEN 'cheque' ELSE 'ewallet' END FROM events WHERE event_type = 'purchase'""",
    "c_named": """SELECT request_id, unnest(CASE WHEN event_id % 2 = 0 THEN [{'k': k, 'n': 1 + event_id % 3}, {'k': k + 4, 'n': 1}]
  ELSE [{'k': k, 'n': 1 + event_id % 3}] END, recursive := true) FROM (
  SELECT 'D' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS request_id, event_id,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'purchase')""",
    "c_lines": """SELECT request_id, direct, item_type, coalesce(pet_id, product_id) AS item_id, CAST(quantity AS BIGINT) AS quantity
  FROM c_requests JOIN m_cart ON buyer_id = actor_id JOIN m_cart_items USING (cart_id) WHERE NOT direct
  UNION ALL SELECT request_id, true, CASE WHEN k % 4 = 0 THEN 'pet' ELSE 'product' END, CAST(k AS VARCHAR), n FROM c_named""",
    "c_priced": """SELECT l.*, i.price, i.seller_id, i.is_active, CAST(p_size AS BIGINT) AS pieces FROM c_lines l
  LEFT JOIN m_items i ON i.item_type = l.item_type AND i.item_id = l.item_id LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = l.item_id""",
    "c_wanted": """SELECT request_id, bool_or(price IS NULL OR (direct AND NOT is_active)) AS unknown, sum(price * quantity) AS subtotal,
  list({'key': item_type || ':' || item_id, 'need': quantity, 'pieces': pieces}) AS lines
  FROM (SELECT request_id, direct, item_type, item_id, price, is_active, pieces, CAST(sum(quantity) AS BIGINT) AS quantity
        FROM c_priced GROUP BY ALL) GROUP BY request_id""",
    "c_steps": """SELECT row_number() OVER (ORDER BY request_ts, request_id) AS seq, r.*, w.lines, w.unknown, w.subtotal
  FROM c_requests r LEFT JOIN c_wanted w USING (request_id)""",
    "c_run": """SELECT CAST(0 AS BIGINT) AS seq, CAST(MAP {} AS MAP(VARCHAR, BIGINT)) AS sold, CAST(NULL AS VARCHAR) AS outcome
  UNION ALL SELECT seq, CASE WHEN outcome = 'accepted' THEN map_concat(sold, map_from_entries(list_append(
    [{'k': l.key, 'v': l.need + coalesce(sold[l.key], 0)} for l in lines], {'k': 'cart:' || actor_id, 'v': CAST(1 AS BIGINT)}))) ELSE sold END, outcome
  FROM (SELECT s.seq, sold, lines, actor_id, CASE WHEN address = '' THEN 'missing_field'
    WHEN lines IS NULL OR (NOT direct AND sold['cart:' || actor_id] IS NOT NULL) THEN 'empty_cart' WHEN unknown THEN 'not_found'
    WHEN len([1 for l in lines if coalesce(sold[l.key], 0) + l.need > l.pieces]) > 0 THEN 'out_of_stock'
    WHEN bad_postal THEN 'constraint' WHEN method NOT IN ('transfer', 'ewallet', 'cod') THEN 'bad_enum' ELSE 'accepted' END AS outcome
    FROM c_run r JOIN c_steps s ON s.seq = r.seq + 1)""",
    "c_done": """SELECT s.*, r.outcome, sha256('order:' || request_id) AS order_id FROM c_steps s
  JOIN (SELECT seq, outcome FROM c_run) r ON r.seq = s.seq""",
}


def _checkout_sql(body: str) -> str:
    text = sql(body, **_CHECKOUT).replace("WITH ", "WITH RECURSIVE ", 1)
    return text.replace("c_steps AS (", "c_steps AS MATERIALIZED (").replace("c_done AS (", "c_done AS MATERIALIZED (")


def _checkout(spark, sf_dir):
    t = marketplace(spark, sf_dir, stock="p_size")
    customer = F.concat(F.lit("C"), text("c_custkey"))
    at = lambda minutes: F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(mins=minutes.cast("int"))
    postal = lambda bad: F.when(bad, F.lit("9" * 40))
    of_cart = t.raw("customer").select(
        F.concat(F.lit("O"), F.lpad(text("c_custkey"), 12, "0")).alias("request_id"), at(F.col("c_acctbal")).alias("request_ts"),
        customer.alias("actor_id"), F.lit("buyer").alias("actor_role"),
        F.when(F.col("c_nationkey") == 0, "").otherwise(F.concat(F.lit("street "), text("c_custkey"))).alias("shipping_address"),
        postal(F.col("c_custkey") % 17 == 0).alias("shipping_postal"),
        F.when(F.col("c_mktsegment") == "BUILDING", "cheque").when(F.col("c_mktsegment") == "MACHINERY", "cod").alias("payment_method"),
        F.lit(None).cast("array<struct<item_type:string,pet_id:string,product_id:string,quantity:int>>").alias("items"),
    )
    key, event = event_key().cast("bigint"), F.col("event_id")

    def item(k, quantity):
        pet, number = k % 4 == 0, k.cast("string")
        return F.struct(F.when(pet, "pet").otherwise("product").alias("item_type"), F.when(pet, number).alias("pet_id"),
                        F.when(~pet, number).alias("product_id"), quantity.cast("int").alias("quantity"))

    first, second = item(key, 1 + event % 3), item(key + 4, F.lit(1))
    direct = t.raw("events").filter("event_type = 'purchase'").select(
        F.concat(F.lit("D"), F.lpad(text("event_id"), 12, "0")).alias("request_id"), at(event % 9000).alias("request_ts"),
        F.concat(F.lit("C"), text("user_id")).alias("actor_id"), F.lit("buyer").alias("actor_role"), F.lit("home").alias("shipping_address"),
        postal(event % 13 == 0).alias("shipping_postal"), F.when(event % 11 == 0, "cheque").otherwise("ewallet").alias("payment_method"),
        F.when(event % 2 == 0, F.array(first, second)).otherwise(F.array(first)).alias("items"),
    )
    return changes.checkout(t, of_cart.unionByName(direct), _now()), t


@query("checkout", _checkout_sql("""SELECT order_id, actor_id AS buyer_id, CAST(subtotal + 15 AS DECIMAL(12,2)) AS total_price,
  CAST(floor(subtotal * 0.1 + 0.5) AS DECIMAL(12,2)) AS platform_fee,
  CAST(subtotal - floor(subtotal * 0.1 + 0.5) AS DECIMAL(12,2)) AS seller_payout, request_ts AS created_at
  FROM c_done WHERE outcome = 'accepted'"""))
def checkout(spark, sf_dir) -> DataFrame:
    return _checkout(spark, sf_dir)[0].accepted.select(
        "order_id", "buyer_id", "total_price", "platform_fee", "seller_payout", "created_at")


@query("checkout_rejected", _checkout_sql("""SELECT request_id, request_ts, outcome AS reason FROM c_done WHERE outcome <> 'accepted'"""))
def checkout_rejected(spark, sf_dir) -> DataFrame:
    return _checkout(spark, sf_dir)[0].rejected


@query("checkout_lines", _checkout_sql("""SELECT d.order_id, l.item_type, l.item_id, l.seller_id, CAST(l.quantity AS INTEGER) AS quantity,
  l.price AS unit_price, CAST(l.price * l.quantity AS DECIMAL(12,2)) AS subtotal
  FROM c_done d JOIN c_priced l USING (request_id) WHERE outcome = 'accepted'"""))
def checkout_lines(spark, sf_dir) -> DataFrame:
    change, _ = _checkout(spark, sf_dir)
    lines = change.tables["order_items"].join(change.accepted.select("order_id"), "order_id", "left_semi")
    return lines.select("order_id", "item_type", F.coalesce("pet_id", "product_id").alias("item_id"), "seller_id", "quantity", "unit_price", "subtotal")


@query("checkout_payments", _checkout_sql("""SELECT order_id, CAST(subtotal + 15 AS DECIMAL(12,2)) AS amount, method, 'unpaid' AS status
  FROM c_done WHERE outcome = 'accepted'"""))
def checkout_payments(spark, sf_dir) -> DataFrame:
    change, _ = _checkout(spark, sf_dir)
    paid = change.tables["payments"].join(change.accepted.select("order_id"), "order_id", "left_semi")
    return paid.select("order_id", "amount", "method", "status")


@query("checkout_stock", _checkout_sql("""SELECT i.item_type, i.item_id, CAST(p_size - coalesce(gone, 0) AS INTEGER) AS stock FROM m_items i
  JOIN part ON CAST(p_partkey AS VARCHAR) = i.item_id LEFT JOIN (SELECT item_type, item_id, sum(quantity) AS gone
  FROM c_done JOIN c_lines USING (request_id) WHERE outcome = 'accepted' GROUP BY item_type, item_id) s
  ON s.item_type = i.item_type AND s.item_id = i.item_id"""))
def checkout_stock(spark, sf_dir) -> DataFrame:
    tables = _checkout(spark, sf_dir)[0].tables
    of = lambda kind: tables[f"{kind}s"].select(F.lit(kind).alias("item_type"), F.col(f"{kind}_id").alias("item_id"), "stock")
    return of("pet").unionByName(of("product"))


@query("checkout_carts", _checkout_sql("""SELECT c.cart_id, count(l.item_id) AS line_count FROM m_cart c LEFT JOIN (
  SELECT * FROM m_cart_items WHERE cart_id NOT IN (SELECT cart_id FROM m_cart JOIN c_done ON actor_id = buyer_id
  WHERE outcome = 'accepted')) l ON l.cart_id = c.cart_id GROUP BY c.cart_id"""))
def checkout_carts(spark, sf_dir) -> DataFrame:
    """Lines that every cart still has."""
    change, t = _checkout(spark, sf_dir)
    left = change.tables["cart_items"].groupBy("cart_id").agg(F.count(F.lit(1)).alias("n"))
    return t["cart"].select("cart_id").join(left, "cart_id", "left").select("cart_id", F.coalesce("n", F.lit(0)).alias("line_count"))


# --- sources and sinks

@query("evolve_schema", sql("""SELECT 'C' || c_custkey AS user_id, c_name AS name, 'buyer' AS role, true AS is_active,
  true AS is_verified, CAST(NULL AS VARCHAR) AS address, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS postal_code
  FROM customer"""))
def evolve(spark, sf_dir) -> DataFrame:
    old = marketplace(spark, sf_dir).raw("customer").select(
        F.concat(F.lit("C"), text("c_custkey")).alias("user_id"), F.col("c_name").alias("name"))
    return evolve_schema(old, "users", {"role": "buyer"}).select(
        "user_id", "name", "role", "is_active", "is_verified", "address", "city", "postal_code")


@query("seed_reference_rows", sql("""SELECT name, CAST(NULL AS VARCHAR) AS description FROM m_categories UNION ALL
  SELECT name, min(description) FROM (SELECT p_brand AS name, 'brand' AS description FROM part UNION ALL
  SELECT p_type, 'type' FROM part UNION ALL SELECT c_mktsegment, 'segment' FROM customer)
  WHERE name NOT IN (SELECT name FROM m_categories) GROUP BY name"""))
def seed_reference_rows(spark, sf_dir) -> DataFrame:
    t = marketplace(spark, sf_dir)
    of = lambda table, column, origin: t.raw(table).select(
        F.col(column).alias("name"), F.lit(origin).alias("description"))
    new = (
        of("part", "p_brand", "brand").unionByName(of("part", "p_type", "type"))
        .unionByName(of("customer", "c_mktsegment", "segment"))
    )
    return insert_if_absent(t["categories"], new, "name").select("name", "description")


@query("load_marketplace", sql("\nUNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS row_count, count(DISTINCT {schema.PRIMARY_KEY[name]}) AS key_count FROM m_{name}"
    for name in schema.TABLES)))
def load(spark, sf_dir) -> DataFrame:
    """Writes a snapshot, loads it again and counts rows and keys of every table."""
    folder = work_folder(spark, "snapshot")
    write_snapshot(marketplace(spark, sf_dir), folder)
    loaded = load_marketplace(spark, folder)
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(schema.PRIMARY_KEY[name]).alias("key_count"))
        .select(F.lit(name).alias("table_name"), "row_count", "key_count") for name, df in loaded.items()
    ]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


@query("write_snapshot", sql("""SELECT strftime(created_at, '%Y-%m') AS month, status, count(*) AS order_count,
  CAST(sum(total_price) AS DECIMAL(22,2)) AS total FROM m_orders GROUP BY ALL"""))
def snapshot(spark, sf_dir) -> DataFrame:
    """Orders written in month folders and read back through the folder name."""
    folder = work_folder(spark, "orders")
    write_snapshot({"orders": marketplace(spark, sf_dir)["orders"]}, folder)
    orders = spark.read.schema(schema.ddl("orders") + ", month string").parquet(f"{folder}/orders")
    return orders.groupBy("month", "status").agg(
        F.count(F.lit(1)).alias("order_count"), F.sum("total_price").cast("decimal(22,2)").alias("total"))


@query("load_requests", sql("""SELECT request_id, request_ts, item_type, quantity, true AS usable FROM good
  UNION ALL SELECT NULL, NULL, NULL, NULL, false FROM e WHERE event_id % 23 = 0 OR event_type = 'error'""",
    e=_EVENT, good="""SELECT request_id, request_ts, CASE WHEN event_type = 'view' THEN 'pet' END AS item_type,
  CAST(event_id % 5 AS INTEGER) AS quantity FROM e WHERE NOT (event_id % 23 = 0 OR event_type = 'error')"""))
def requests_from_text(spark, sf_dir) -> DataFrame:
    """Events written as JSON lines, some cut off and some with a text where a number belongs, and read as requests."""
    folder = work_folder(spark, "requests")
    e, kind = F.col("event_id"), F.col("event_type")
    body = F.concat(
        F.lit('{"request_id": "'), F.col("request_id"), F.lit('", "request_ts": "'),
        F.date_format("request_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('"'),
        F.when(kind == "view", ', "item_type": "pet"').otherwise(""), F.lit(', "quantity": '),
        F.when(kind == "error", F.lit('"some"')).otherwise((e % 5).cast("string")),
        F.when(e % 23 == 0, "").otherwise("}"),
    )
    _events(marketplace(spark, sf_dir)).select(body.alias("value")).write.text(folder)
    ok, bad = load_requests(spark, folder, "add_to_cart")
    good = ok.select("request_id", "request_ts", "item_type", "quantity", F.lit(True).alias("usable"))
    return good.unionByName(bad.select(F.lit(False).alias("usable")), allowMissingColumns=True)
