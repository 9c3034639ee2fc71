"""The supplied star-schema tables seen as marketplace tables, as DataFrames and as SQL."""

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tradewind import schema
from tradewind.session import tune
from tradewind.sources.evolve import evolve_schema

AS_OF = "2001-08-02 00:00:00"
EPOCH = "1995-01-01 00:00:00"


_EPOCH = f"TIMESTAMP_NTZ '{EPOCH}'"


def text(column: str) -> Column:
    return F.col(column).cast("string")


def money(column: str) -> Column:
    return F.col(column).cast("decimal(12,2)")


def _people(df: DataFrame, key: str, name: str, letter: str, role: str, active: str, verified: str) -> DataFrame:
    return df.selectExpr(
        f"'{letter}' || {key} AS user_id", f"{name} AS name", f"lower({name}) || '@example.com' AS email",
        f"'hash-' || {key} AS password", f"'08' || {key} AS phone", f"'{role}' AS role", f"'avatar/' || {name} AS avatar_url",
        f"{active} AS is_active", f"{verified} AS is_verified",
        f"{_EPOCH} + make_dt_interval(0, int({key})) AS created_at", f"{_EPOCH} + make_dt_interval(0, int({key})) AS updated_at",
    )


def _users(r) -> DataFrame:
    buyers = _people(r("customer"), "c_custkey", "c_name", "C", "buyer", "c_acctbal >= 0", "true")
    sellers = _people(r("supplier"), "s_suppkey", "s_name", "S", "seller", "s_acctbal >= 0", "s_acctbal > 1000")
    admins = _people(r("nation"), "n_nationkey", "n_name", "A", "admin", "n_regionkey < 4", "true")
    return buyers.unionByName(sellers).unionByName(admins)


# Category numbers of the part types; the last one has no products.
_CATEGORIES = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5, "STANDARD": 6}
_EMPTY_CATEGORY = 7
CATEGORY_SQL = "CASE p_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _CATEGORIES.items()) + " END"


def category() -> Column:
    return F.expr(CATEGORY_SQL)


def _categories(r) -> DataFrame:
    named = r("part").selectExpr(f"{CATEGORY_SQL} AS category_id", "p_type AS name").distinct()
    empty = r("part").groupBy().count().selectExpr(f"{_EMPTY_CATEGORY} AS category_id", "'EMPTY' AS name")
    return named.unionByName(empty).selectExpr("*", f"{_EPOCH} AS created_at")


def _kind(key: str) -> str:
    return f"CASE WHEN {key} % 4 = 0 THEN 'pet' ELSE 'product' END"


def item_columns(key: str) -> list[Column]:
    return [F.expr(e) for e in _reference(key)]


def _reference(key: str) -> list[str]:
    return [f"{_kind(key)} AS item_type", f"CASE WHEN {key} % 4 = 0 THEN string({key}) END AS pet_id",
            f"CASE WHEN {key} % 4 <> 0 THEN string({key}) END AS product_id"]


def _items(r, kind: str, stock: str) -> DataFrame:
    """Every part is either a pet or a product."""
    own = {
        "pet": ["string(p_partkey) AS pet_id", "p_name AS pet_name", "p_type AS species", "p_brand AS breed",
                "p_size AS age_month", "CASE WHEN p_size % 2 = 0 THEN 'Jantan' ELSE 'Betina' END AS gender"],
        "product": ["string(p_partkey) AS product_id", "p_name AS product_name",
                    f"CASE WHEN p_partkey % 13 <> 0 THEN {CATEGORY_SQL} END AS category_id"],
    }
    sellers = r("supplier").groupBy().count().scalar()
    created = f"{_EPOCH} + make_dt_interval(0, 0, int(p_partkey))"
    return r("part").filter(f"{_kind('p_partkey')} = '{kind}'").withColumn("_sellers", sellers).selectExpr(
        *own[kind], "'S' || (p_partkey % _sellers) AS seller_id", "CAST(p_retailprice AS DECIMAL(12,2)) AS price",
        f"{stock} AS stock", "'img/' || p_partkey AS image_url", "p_partkey % 11 <> 0 AS is_active",
        f"{created} AS created_at", f"{created} AS updated_at",
    )


def _orders(r) -> DataFrame:
    goods = "(CAST(o_totalprice AS DECIMAL(12,2)) - 15)"
    fee = f"floor({goods} * 0.1 + 0.5)"
    return r("orders").selectExpr(
        "string(o_orderkey) AS order_id", "'C' || o_custkey AS buyer_id",
        """CASE WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'pending'
           WHEN o_orderstatus = 'O' THEN 'processing' WHEN o_orderkey % 2 = 0 THEN 'shipped' ELSE 'cancelled' END AS status""",
        "CAST(o_totalprice AS DECIMAL(12,2)) AS total_price", "CAST(15 AS DECIMAL(12,2)) AS shipping_cost",
        f"CAST({fee} AS DECIMAL(12,2)) AS platform_fee", f"CAST({goods} - {fee} AS DECIMAL(12,2)) AS seller_payout",
        "'street ' || o_custkey AS shipping_address", "o_orderpriority AS notes",
        "o_orderdate AS created_at", "o_orderdate AS updated_at",
    )


LINE_KEY = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"


def _order_items(r) -> DataFrame:
    unit = "floor((2 * bigint(round(l_extendedprice * 100)) + bigint(l_quantity)) / (2 * l_quantity))"
    return r("lineitem").selectExpr(
        f"{LINE_KEY} AS order_item_id", "string(l_orderkey) AS order_id", *_reference("l_partkey"),
        "'S' || l_suppkey AS seller_id", "int(l_quantity) AS quantity",
        f"CAST(bigint({unit}) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS unit_price",
        "CAST(l_extendedprice AS DECIMAL(12,2)) AS subtotal",
    )


def _payments(r) -> DataFrame:
    """One per order, but not yet for open orders of low priority."""
    paid = "(o_orderstatus = 'F' OR (o_orderstatus = 'P' AND o_orderkey % 2 = 0))"
    return r("orders").filter("o_orderstatus <> 'O' OR o_orderpriority <> '5-LOW'").selectExpr(
        "'P' || o_orderkey AS payment_id", "string(o_orderkey) AS order_id", "CAST(o_totalprice AS DECIMAL(12,2)) AS amount",
        "CASE o_orderkey % 3 WHEN 0 THEN 'transfer' WHEN 1 THEN 'ewallet' ELSE 'cod' END AS method",
        f"CASE WHEN {paid} THEN 'paid' WHEN o_orderstatus = 'O' THEN 'unpaid' ELSE 'refunded' END AS status",
        f"CASE WHEN {paid} THEN 'REF-' || o_orderkey END AS reference_no", f"CASE WHEN {paid} THEN o_orderdate END AS paid_at",
        "o_orderdate AS created_at", "o_orderdate AS updated_at",
    )


def _reviews(r) -> DataFrame:
    """One per delivered order and accepted item (return flag A)."""
    delivered = r("orders").filter("o_orderstatus = 'F'").selectExpr("o_orderkey AS l_orderkey", "o_custkey")
    accepted = (
        r("lineitem").filter("l_returnflag = 'A'").groupBy("l_orderkey", "l_partkey")
        .agg(F.min("l_shipdate").alias("created_at"))
    )
    rating = "1 + (l_orderkey + l_partkey) % 5"
    return accepted.join(delivered, "l_orderkey").selectExpr(
        "concat_ws('-', l_orderkey, l_partkey) AS review_id", "'C' || o_custkey AS reviewer_id",
        "string(l_orderkey) AS order_id", *_reference("l_partkey"), f"smallint({rating}) AS rating",
        f"'rated ' || ({rating}) AS comment", "created_at",
    )


def event_key() -> Column:
    return F.expr("int(get_json_object(props, '$.k'))")


def _cart(r) -> DataFrame:
    created = f"{_EPOCH} + make_dt_interval(0, int(c_custkey))"
    return r("customer").selectExpr("'K' || c_custkey AS cart_id", "'C' || c_custkey AS buyer_id",
                                    f"{created} AS created_at", f"{created} AS updated_at")


def _cart_items(r) -> DataFrame:
    clicks = r("events").filter("event_type = 'click'").withColumn("k", event_key())
    pieces = clicks.groupBy("user_id", "k").agg(
        F.expr("int(sum(1 + event_id % 3)) AS quantity"), F.min("ts").alias("created_at"))
    return pieces.selectExpr("'K' || user_id || '-' || k AS item_id", "'K' || user_id AS cart_id", *_reference("k"),
                             "quantity", "created_at")


def _settings(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT key, value, {_EPOCH} AS updated_at FROM VALUES ('platform_fee_percent', '10'), "
                     "('shipping_cost', '15') AS (key, value)")


class Marketplace(Mapping):
    """The marketplace tables, each built when it is first asked for, so that a query opens only the files it reads."""

    def __init__(self, spark: SparkSession, sf_dir: str, stock: str = "p_size % 7"):
        self._spark, self._dir, self._stock = tune(spark), sf_dir, stock
        self._raw: dict[str, DataFrame] = {}
        self._built: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self._raw[name]

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self._built:
            self._built[table] = evolve_schema(self._build(table), table)
        return self._built[table]

    def _build(self, table: str) -> DataFrame:
        if table in ("pets", "products"):
            return _items(self.raw, table[:-1], self._stock)
        if table == "app_settings":
            return _settings(self._spark)
        return _BUILDERS[table](self.raw)

    def __iter__(self):
        return iter(schema.TABLES)

    def __len__(self):
        return len(schema.TABLES)


_BUILDERS = {
    "users": _users, "categories": _categories, "cart": _cart, "cart_items": _cart_items, "orders": _orders,
    "order_items": _order_items, "payments": _payments, "reviews": _reviews,
}


def marketplace(spark: SparkSession, sf_dir: str, **options: str) -> Marketplace:
    return Marketplace(spark, sf_dir, **options)


# The same tables for DuckDB, as common table expressions.
_KIND = "CASE WHEN {k} % 4 = 0 THEN 'pet' ELSE 'product' END"
_REF = (_KIND + " AS item_type, CASE WHEN {k} % 4 = 0 THEN CAST({k} AS VARCHAR) END AS pet_id, "
        "CASE WHEN {k} % 4 <> 0 THEN CAST({k} AS VARCHAR) END AS product_id")
_PERSON = """SELECT '{p}' || {k} AS user_id, {n} AS name, lower({n}) || '@example.com' AS email,
  'hash-' || {k} AS password, '08' || {k} AS phone, '{r}' AS role, 'avatar/' || {n} AS avatar_url,
  {a} AS is_active, {v} AS is_verified, CAST(NULL AS VARCHAR) AS address, CAST(NULL AS VARCHAR) AS city,
  CAST(NULL AS VARCHAR) AS postal_code,
  TIMESTAMP '1995-01-01 00:00:00' + to_hours(CAST({k} AS INTEGER)) AS created_at,
  TIMESTAMP '1995-01-01 00:00:00' + to_hours(CAST({k} AS INTEGER)) AS updated_at FROM {t}"""
_ITEM = """'S' || (p_partkey % (SELECT count(*) FROM supplier)) AS seller_id,
  CAST(p_retailprice AS DECIMAL(12,2)) AS price, p_size % 7 AS stock, 'img/' || p_partkey AS image_url,
  p_partkey % 11 <> 0 AS is_active,
  TIMESTAMP '1995-01-01 00:00:00' + to_minutes(CAST(p_partkey AS INTEGER)) AS created_at,
  TIMESTAMP '1995-01-01 00:00:00' + to_minutes(CAST(p_partkey AS INTEGER)) AS updated_at,
  CAST(NULL AS VARCHAR) AS description"""

VIEWS = {
    "m_users": "\nUNION ALL ".join([
        _PERSON.format(p="C", k="c_custkey", n="c_name", r="buyer", a="c_acctbal >= 0", v="true", t="customer"),
        _PERSON.format(p="S", k="s_suppkey", n="s_name", r="seller", a="s_acctbal >= 0", v="s_acctbal > 1000",
                       t="supplier"),
        _PERSON.format(p="A", k="n_nationkey", n="n_name", r="admin", a="n_regionkey < 4", v="true", t="nation"),
    ]),
    "m_categories": f"""SELECT DISTINCT CAST({CATEGORY_SQL} AS INTEGER) AS category_id, p_type AS name,
  CAST(NULL AS VARCHAR) AS icon, CAST(NULL AS VARCHAR) AS description, TIMESTAMP '1995-01-01 00:00:00' AS created_at
  FROM part UNION ALL SELECT 7, 'EMPTY', NULL, NULL, TIMESTAMP '1995-01-01 00:00:00'""",
    "m_pets": f"""SELECT CAST(p_partkey AS VARCHAR) AS pet_id, p_name AS pet_name, p_type AS species,
  p_brand AS breed, p_size AS age_month, CASE WHEN p_size % 2 = 0 THEN 'Jantan' ELSE 'Betina' END AS gender, {_ITEM}
  FROM part WHERE {_KIND.format(k='p_partkey')} = 'pet'""",
    "m_products": f"""SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name,
  CASE WHEN p_partkey % 13 <> 0 THEN CAST({CATEGORY_SQL} AS INTEGER) END AS category_id, {_ITEM}
  FROM part WHERE {_KIND.format(k='p_partkey')} = 'product'""",
    "m_cart": """SELECT 'K' || c_custkey AS cart_id, 'C' || c_custkey AS buyer_id,
  TIMESTAMP '1995-01-01 00:00:00' + to_hours(CAST(c_custkey AS INTEGER)) AS created_at FROM customer""",
    "m_cart_items": f"""SELECT 'K' || user_id || '-' || k AS item_id, 'K' || user_id AS cart_id,
  {_REF.format(k='k')}, CAST(sum(1 + event_id % 3) AS INTEGER) AS quantity, min(ts) AS created_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'click')
  GROUP BY user_id, k""",
    "m_orders": """SELECT *, CAST(total_price - shipping_cost - platform_fee AS DECIMAL(12,2)) AS seller_payout FROM (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, 'C' || o_custkey AS buyer_id,
  CASE WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'pending'
       WHEN o_orderstatus = 'O' THEN 'processing' WHEN o_orderkey % 2 = 0 THEN 'shipped' ELSE 'cancelled' END AS status,
  CAST(o_totalprice AS DECIMAL(12,2)) AS total_price, CAST(15 AS DECIMAL(12,2)) AS shipping_cost,
  CAST(floor((CAST(o_totalprice AS DECIMAL(12,2)) - 15) * 0.1 + 0.5) AS DECIMAL(12,2)) AS platform_fee,
  'street ' || o_custkey AS shipping_address, CAST(NULL AS VARCHAR) AS shipping_city,
  CAST(NULL AS VARCHAR) AS shipping_postal, o_orderpriority AS notes, o_orderdate AS created_at,
  o_orderdate AS updated_at FROM orders)""",
    "m_order_items": f"""SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS order_item_id,
  CAST(l_orderkey AS VARCHAR) AS order_id, {_REF.format(k='l_partkey')}, 'S' || l_suppkey AS seller_id,
  CAST(l_quantity AS INTEGER) AS quantity,
  CAST(CAST(floor((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT)) / (2e0 * l_quantity))
       AS BIGINT) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,2)) AS unit_price,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS subtotal FROM lineitem""",
    "m_payments": """SELECT 'P' || o_orderkey AS payment_id, CAST(o_orderkey AS VARCHAR) AS order_id,
  CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
  CASE o_orderkey % 3 WHEN 0 THEN 'transfer' WHEN 1 THEN 'ewallet' ELSE 'cod' END AS method,
  CASE WHEN paid THEN 'paid' WHEN o_orderstatus = 'O' THEN 'unpaid' ELSE 'refunded' END AS status,
  CASE WHEN paid THEN 'REF-' || o_orderkey END AS reference_no, CASE WHEN paid THEN o_orderdate END AS paid_at,
  o_orderdate AS created_at, o_orderdate AS updated_at
  FROM (SELECT *, o_orderstatus = 'F' OR (o_orderstatus = 'P' AND o_orderkey % 2 = 0) AS paid FROM orders)
  WHERE o_orderstatus <> 'O' OR o_orderpriority <> '5-LOW'""",
    "m_reviews": f"""SELECT l_orderkey || '-' || l_partkey AS review_id, 'C' || o_custkey AS reviewer_id,
  CAST(l_orderkey AS VARCHAR) AS order_id, {_REF.format(k='l_partkey')},
  CAST(1 + (l_orderkey + l_partkey) % 5 AS SMALLINT) AS rating, 'rated ' || (1 + (l_orderkey + l_partkey) % 5) AS comment,
  min(l_shipdate) AS created_at
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'A'
  GROUP BY l_orderkey, l_partkey, o_custkey""",
    "m_app_settings": """SELECT 'platform_fee_percent' AS key, '10' AS value, TIMESTAMP '1995-01-01 00:00:00' AS updated_at
  UNION ALL SELECT 'shipping_cost', '15', TIMESTAMP '1995-01-01 00:00:00'""",
    "m_items": """SELECT 'pet' AS item_type, pet_id AS item_id, pet_name AS name, price, stock, image_url, is_active,
  seller_id FROM m_pets
  UNION ALL SELECT 'product', product_id, product_name, price, stock, image_url, is_active, seller_id FROM m_products""",
}


def sql(body: str, **extra: str) -> str:
    """A query with the views it mentions (and extra ones, given in order) put in front as a WITH clause."""
    views = {**VIEWS, **extra}
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name in views:
            if name not in wanted and views[name] is not text and re.search(rf"\b{name}\b", text):
                visit(views[name])
                wanted.append(name)

    visit(body)
    if not wanted:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({views[name]})" for name in wanted) + "\n" + body
