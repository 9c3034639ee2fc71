"""Searches of names through posting lists of trigrams."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tradewind import schema
from tradewind.functions import contains
from tradewind.operators import catalog, people
from tradewind.session import work_folder
from tradewind.sources import TextIndex, load_marketplace, write_snapshot

from .batches import _PATCH, _patch
from .registry import query
from .star import marketplace, sql

# Fixed by the queries: table, searched column, text; with wildcards, with fewer than three letters in a row, without a match.
_SEARCHES = [
    ("products", "product_name", "RED"), ("products", "product_name", "r%d b"), ("products", "product_name", "e_"),
    ("products", "product_name", "all b_lt"), ("products", "product_name", "no such name"),
    ("pets", "species", "cono"), ("pets", "breed", "#2"), ("users", "name", "er#00000001"), ("users", "email", "%01@EXAMPLE"),
]
_CASES = "\nUNION ALL ".join(
    f"""SELECT '{table}' AS item_table, '{column}' AS item_column, '{needle}' AS needle, {schema.PRIMARY_KEY[table]} AS item_id, {column} AS item_text
  FROM m_{table} WHERE {column} ILIKE '%{needle}%'""" for table, column, needle in _SEARCHES)


def _indexed(spark, sf_dir):
    """The searched tables as a snapshot, loaded from it, with an index of their texts."""
    t, folder = marketplace(spark, sf_dir), work_folder(spark, "snapshot")
    names = ("users", "pets", "products")
    write_snapshot({name: t[name] for name in names}, folder)
    tables = {**{name: t[name] for name in t}, **load_marketplace(spark, folder, tables=names)}
    index = TextIndex(spark, work_folder(spark, "text-index"))
    index.replace({name: tables[name] for name in names})
    return tables, folder, index


@query("name_search", sql(_CASES))
def name_search(spark, sf_dir) -> DataFrame:
    """Several searches of all names: each reads the list of its rarest trigram and the key folders of what it finds there."""
    tables, folder, index = _indexed(spark, sf_dir)

    def search(table: str, column: str, needle: str) -> DataFrame:
        rows = index.narrowed(tables, table, {column: needle}, snapshot=folder)[table].filter(contains(column, needle))
        return rows.select(F.lit(table).alias("item_table"), F.lit(column).alias("item_column"), F.lit(needle).alias("needle"),
                           F.col(schema.PRIMARY_KEY[table]).alias("item_id"), F.col(column).alias("item_text"))

    return reduce(DataFrame.unionByName, [search(*case) for case in _SEARCHES])


@query("name_search_users", sql("""SELECT user_id, name, email, role FROM m_users
  WHERE is_active AND role = 'buyer' AND (name ILIKE '%er#0%5%' OR email ILIKE '%er#0%5%')"""))
def name_search_users(spark, sf_dir) -> DataFrame:
    """list_users on what the lists of names and of e-mail addresses find, one or the other."""
    tables, folder, index = _indexed(spark, sf_dir)
    narrowed = index.narrowed(tables, "users", {"name": "er#0%5", "email": "er#0%5"}, any_of=True, snapshot=folder)
    return people.list_users(narrowed, people.UserFilters(role="buyer", search="er#0%5"), page=None).select("user_id", "name", "email", "role")


@query("name_search_after_patch", sql("""SELECT product_id, product_name, price FROM (
  SELECT p.product_id, coalesce(f.product_name, p.product_name) AS product_name, coalesce(f.price, p.price) AS price,
  coalesce(f.is_active, p.is_active) AS is_active FROM m_products p LEFT JOIN folded f ON f.product_id = p.product_id)
  WHERE is_active AND product_name ILIKE '%NAMED 3%'""", **_PATCH))
def name_search_after_patch(spark, sf_dir) -> DataFrame:
    """admin_products after a batch that renames products: the batch's texts are added to the lists, old ones are found no more."""
    tables, _, index = _indexed(spark, sf_dir)
    change = _patch(spark, sf_dir)
    index.add_changes(change.sets, "patch")
    narrowed = index.narrowed({**tables, **change.tables}, "products", {"product_name": "NAMED 3"})
    found = catalog.admin_products(narrowed, catalog.ItemFilters(search="NAMED 3"), page=None)
    return found.select("product_id", "product_name", "price")
