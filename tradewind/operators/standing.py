"""Reports kept up to date from change sets: what a batch touched is taken out of the sums and put in again."""

import datetime as dt
from collections.abc import Callable, Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema
from ..functions.money import TOTAL, platform_fee, total_of
from ..plans.requests import ChangeSet
from ..session import held
from .items import KINDS
from .people import setting

State = dict[str, DataFrame]


class Facts(NamedTuple):
    """Rows that a report adds up, as a function of tables; each belongs to one row of a table, or to one order."""

    tables: tuple[str, ...]
    keys: tuple[str, ...]
    sums: tuple[str, ...]  # beside n, the number of facts behind a key
    rows: Callable[[dict], DataFrame]


def _ratings(t) -> DataFrame:
    stars = F.col("rating").cast("decimal(12,2)").alias("stars")
    of = lambda kind: t["reviews"].filter(F.col(KINDS[kind][1]).isNotNull()).select(
        F.lit(kind).alias("kind"), F.col(KINDS[kind][1]).alias("item_id"), stars)
    return of("pet").unionByName(of("product"))


def _inventory(t) -> DataFrame:
    available = F.when(F.col("stock") > 0, 1).otherwise(0).cast("bigint").alias("available")
    of = lambda table: t[table].filter("is_active").select(F.lit(table).alias("kind"), available) if table in t else None
    return reduce(DataFrame.unionByName, [df for df in map(of, ("pets", "products")) if df is not None])


def _order_lines(t, *keys: str) -> DataFrame:
    """One row per order (and further keys of its lines) with the order's columns, gross and number of lines."""
    sums = t["order_items"].groupBy("order_id", *keys).agg(
        F.sum("subtotal").cast(TOTAL).alias("gross"), F.count(F.lit(1)).alias("lines"))
    sign = ["n"] if "n" in t["orders"].columns else []
    return sums.join(t["orders"].select("order_id", "status", F.to_date("created_at").alias("day"), *sign), "order_id")


FACTS = {
    "ratings": Facts(("reviews",), ("kind", "item_id"), ("stars",), _ratings),
    "category_products": Facts(("products",), ("category_id",), (), lambda t: t["products"].filter(
        F.col("is_active") & F.col("category_id").isNotNull()).select("category_id")),
    "active_users": Facts(("users",), ("role",), (), lambda t: t["users"].filter(
        F.col("is_active") & F.col("role").isNotNull()).select("role")),
    "inventory": Facts(("pets", "products"), ("kind",), ("available",), _inventory),
    "order_statuses": Facts(("orders",), ("status",), (), lambda t: t["orders"].select("status")),
    "revenue": Facts(("payments",), ("status",), ("amount",), lambda t: t["payments"].select("status", "amount")),
    "seller_sales": Facts(("orders", "order_items"), ("seller_id", "status"), ("gross",), lambda t: _order_lines(t, "seller_id")),
    "status_sales": Facts(("orders", "order_items"), ("status",), ("gross", "lines"), lambda t: _order_lines(t)),
    "daily_sales": Facts(("orders", "order_items"), ("day",), ("gross",), lambda t: _order_lines(t).filter(
        (F.col("status") == "delivered") & F.col("day").isNotNull())),
}


def _summed(facts: Facts, rows: DataFrame) -> DataFrame:
    """Signed facts per key; a key without any is gone."""
    types = {"gross": TOTAL, "amount": TOTAL, "stars": TOTAL}
    sums = [F.sum(F.col(c) * F.col("n")).cast(types.get(c, "bigint")).alias(c) for c in facts.sums]
    return rows.groupBy(*facts.keys).agg(*sums, F.sum("n").cast("bigint").alias("n")).filter("n <> 0 or " + " or ".join(f"{c} <> 0" for c in facts.sums or ("n",)))


def _signed(facts: Facts, t: dict, sign: int) -> DataFrame:
    return facts.rows(t).select(*facts.keys, *facts.sums).withColumn("n", F.lit(sign))


# What the facts read of a table beside its key.
_READ = {
    "reviews": ("pet_id", "product_id", "rating"), "products": ("category_id", "is_active", "stock"), "pets": ("is_active", "stock"),
    "users": ("is_active", "role"), "orders": ("status", "created_at"), "payments": ("status", "amount"),
    "order_items": ("order_id", "seller_id", "subtotal"),
}


def _held_set(table: str, changed: ChangeSet) -> ChangeSet:
    """A change set that is read several times, as far as facts read it."""
    key = schema.PRIMARY_KEY[table]
    rows = changed.rows and held(changed.rows.select(*[c for c in changed.rows.columns if c in (key, *_READ[table])]), "changed")
    return ChangeSet(rows, changed.gone and held(changed.gone.select(key), "changed"))


def standing_state(t, names: Iterable[str] = FACTS) -> State:
    """The sums behind each report, from all rows."""
    return {name: _summed(FACTS[name], _signed(FACTS[name], t, 1)) for name in names}


def standing_delta(t, sets: dict[str, ChangeSet], names: Iterable[str] = FACTS) -> State:
    """What a batch adds to the sums, from the tables before it and its change sets.

    Only rows that the batch names are read as facts, once as they were (taken out) and once as they are (put in).
    Facts of orders are made of all lines of an order, so distinct orders are plain sums over the orders that the batch
    touches, by themselves or by a line. Reports whose tables the batch leaves alone are missing. The change sets are
    written to the work folder first, since they are made by the whole batch and read several times.
    """
    wanted = {table for name in names for table in FACTS[name].tables}
    sets = {table: _held_set(table, changed) for table, changed in sets.items() if table in wanted and changed != ChangeSet()}
    out = {}
    for name in names:
        facts = FACTS[name]
        if not set(facts.tables) & set(sets):
            continue
        if "order_items" in facts.tables and "order_items" not in sets:
            out[name] = _summed(facts, facts.rows(_moved_orders(t, sets["orders"])).select(*facts.keys, *facts.sums, "n"))
            continue
        before, after = _of_orders(t, sets) if "order_items" in facts.tables else touched_rows(t, sets, facts.tables)
        out[name] = _summed(facts, _signed(facts, after, 1).unionByName(_signed(facts, before, -1)))
    return out


def advance(state: State, delta: State) -> State:
    """The sums after a batch: those before it and what it adds, per key."""
    out = dict(state)
    for name, change in delta.items():
        facts = FACTS[name]
        merged = state[name].unionByName(change).groupBy(*facts.keys).agg(
            *[F.sum(c).cast(state[name].schema[c].dataType).alias(c) for c in (*facts.sums, "n")])
        out[name] = merged.filter("n <> 0")
    return out


def named_keys(changed: ChangeSet, key: str) -> DataFrame:
    """Keys that a change set names."""
    parts = [df.select(key) for df in changed if df is not None]
    return reduce(DataFrame.unionByName, parts).distinct()


def _patched(rows: DataFrame, changed: ChangeSet | None, key: str) -> DataFrame:
    if changed is None:
        return rows
    kept = rows.join(named_keys(changed, key), key, "left_anti")
    return kept.unionByName(changed.rows, allowMissingColumns=True) if changed.rows is not None else kept


def touched_rows(t, sets: dict[str, ChangeSet], tables: tuple[str, ...]) -> tuple[dict, dict]:
    """The named rows before and after."""
    before, after = {}, {}
    for table in tables:
        if table in sets:
            key = schema.PRIMARY_KEY[table]
            before[table] = t[table].join(named_keys(sets[table], key), key, "left_semi")
            after[table] = sets[table].rows if sets[table].rows is not None else t[table].limit(0)
    return before, after


def _moved_orders(t, changed: ChangeSet) -> dict:
    """The orders that a batch names, out as they were and in as they are, with their lines, which it leaves alone and which
    are therefore summed once."""
    named = named_keys(changed, "order_id")
    of = lambda df, sign: df.select("order_id", "status", "created_at", F.lit(sign).alias("n"))
    orders = of(t["orders"].join(named, "order_id", "left_semi"), -1)
    if changed.rows is not None:
        orders = orders.unionByName(of(changed.rows, 1))
    return {"orders": orders, "order_items": t["order_items"].join(named, "order_id", "left_semi")}


def _of_orders(t, sets: dict[str, ChangeSet]) -> tuple[dict, dict]:
    """The orders that a batch touches, with all their lines, before and after."""
    touched = []
    for table in ("orders", "order_items"):
        changed = sets.get(table, ChangeSet())
        if changed.rows is not None:
            touched.append(changed.rows.select("order_id"))
            if table == "order_items":  # a line may leave its order
                touched.append(t[table].join(changed.rows.select("order_item_id"), "order_item_id", "left_semi").select("order_id"))
        if changed.gone is not None:
            key = schema.PRIMARY_KEY[table]
            touched.append(t[table].join(changed.gone.select(key), key, "left_semi").select("order_id"))
    orders = reduce(DataFrame.unionByName, touched).distinct()
    before = {table: t[table].join(orders, "order_id", "left_semi") for table in ("orders", "order_items")}
    after = {table: _patched(before[table], sets.get(table), schema.PRIMARY_KEY[table]) for table in before}
    return before, after


# --- the reports, with the columns of those that read all rows


def rating_summary(state: State, kind: str) -> DataFrame:
    average = F.round((F.col("stars") / F.col("n")).cast("decimal(16,6)"), 1).cast("decimal(12,1)")
    return state["ratings"].filter(F.col("kind") == kind).select(
        F.col("item_id").alias(KINDS[kind][1]), average.alias("avg_rating"), F.col("n").alias("review_count"))


def category_counts(state: State, categories: DataFrame) -> DataFrame:
    counts = state["category_products"].withColumnRenamed("n", "product_count")
    return categories.join(counts, "category_id", "left").withColumn("product_count", F.coalesce("product_count", F.lit(0).cast("bigint")))


def _total(column: str, condition: Column | None = None) -> Column:
    value = F.col(column) if condition is None else F.when(condition, F.col(column))
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def dashboard_users(state: State) -> DataFrame:
    return state["active_users"].agg(_total("n").alias("total"), *[_total("n", F.col("role") == r).alias(f"{r}s") for r in schema.ROLES])


def dashboard_inventory(state: State) -> DataFrame:
    of = lambda table: state["inventory"].filter(F.col("kind") == table).agg(
        F.lit(table).alias("kind"), _total("n").alias("total"), F.sum("available").cast("bigint").alias("available"))
    return of("pets").unionByName(of("products"))


def dashboard_orders(state: State) -> DataFrame:
    counts = state["order_statuses"].select("status", F.col("n").alias("order_count"))
    return counts.unionByName(counts.agg(_total("order_count").alias("order_count")).select(F.lit("total").alias("status"), "order_count"))


def dashboard_revenue(state: State) -> DataFrame:
    return state["revenue"].agg(total_of("amount").alias("total"), total_of(F.when(F.col("status") == "paid", F.col("amount"))).alias("paid"))


def seller_stats_by_status(state: State) -> DataFrame:
    return state["seller_sales"].select("seller_id", "status", "gross", F.col("n").alias("order_count"))


def earnings_by_status(state: State, t) -> DataFrame:
    sales = state["status_sales"].select("status", F.col("lines").alias("order_count"), F.col("n").alias("distinct_orders"), F.col("gross").alias("gross_subtotal"))
    return sales.withColumn("platform_fee", platform_fee(F.col("gross_subtotal"), setting(t, "platform_fee_percent")))


def earnings_monthly(state: State, t, as_of: str) -> DataFrame:
    """Sums are kept by day, so as_of must be the start of one."""
    if dt.datetime.fromisoformat(as_of).time() != dt.time():
        raise ValueError(f"daily sums answer from the start of a day on, not from {as_of}")
    since = F.to_date(F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 12 MONTHS"))
    sales = state["daily_sales"].filter(F.col("day") >= since).groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(
        _total("n").alias("order_count"), total_of("gross").alias("gross_subtotal"))
    return sales.withColumn("platform_fee", platform_fee(F.col("gross_subtotal"), setting(t, "platform_fee_percent")))
