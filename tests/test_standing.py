"""Reports moved on by change sets equal reports of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from fixtures import START, at, frame, tables
from test_request_ids import BUYER, NOW
from tradewind import schema
from tradewind.functions import ntz
from tradewind.operators import catalog, changes, dashboard, earnings, standing
from tradewind.plans.requests import ChangeSet
from tradewind.sources.requests import REQUEST_SCHEMAS


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def same_reports(t, state):
    as_of = "2024-07-01"
    pairs = [
        *[(catalog.rating_summary(t["reviews"], kind), standing.rating_summary(state, kind)) for kind in ("pet", "product")],
        (catalog.category_counts(t), standing.category_counts(state, t["categories"])),
        (dashboard.dashboard_users(t), standing.dashboard_users(state)),
        (dashboard.dashboard_inventory(t), standing.dashboard_inventory(state)),
        (dashboard.dashboard_orders(t), standing.dashboard_orders(state)),
        (dashboard.dashboard_revenue(t), standing.dashboard_revenue(state)),
        (earnings.seller_stats_by_status(t), standing.seller_stats_by_status(state)),
        (earnings.earnings_by_status(t), standing.earnings_by_status(state, t)),
        (earnings.earnings_monthly(t, as_of), standing.earnings_monthly(state, t, as_of)),
    ]
    for want, got in pairs:
        assert rows(got) == rows(want)


def kept(tables):
    return {name: df.checkpoint() for name, df in tables.items()}


def world(spark):
    dice = random.Random(3)
    orders = [{"order_id": f"o{i}", "buyer_id": "b1", "status": dice.choice(schema.ORDER_STATUS), "created_at": START.replace(month=1 + i % 6)} for i in range(20)]
    lines = [{"order_item_id": f"l{i}", "order_id": f"o{dice.randrange(20)}", "item_type": "pet", "pet_id": "p1", "seller_id": f"s{dice.randrange(3)}",
              "subtotal": dice.randrange(1, 99)} for i in range(50)]
    return kept(tables(
        spark, users=[{"user_id": "b1", "email": "b1"}, *[{"user_id": f"s{i}", "email": f"s{i}", "role": "seller"} for i in range(3)]],
        categories=[{"category_id": 1, "name": "c"}, {"category_id": 2, "name": "d"}], cart=[{"cart_id": "k1", "buyer_id": "b1"}],
        pets=[{"pet_id": f"p{i}", "seller_id": "s1", "stock": i} for i in range(4)],
        products=[{"product_id": f"r{i}", "category_id": 1 + i % 2, "seller_id": "s1"} for i in range(4)],
        orders=orders, order_items=lines, payments=[{"payment_id": f"m{i}", "order_id": f"o{i}", "amount": i} for i in range(20)],
        reviews=[{"review_id": f"v{i}", "reviewer_id": "b1", "item_type": "pet", "pet_id": f"p{i % 3}", "rating": 1 + i % 5} for i in range(9)]))


def batches(spark):
    make = lambda kind, *rows: frame(spark, REQUEST_SCHEMAS[kind], [{"request_id": f"{kind}{i}", "request_ts": at(i), **r} for i, r in enumerate(rows)])
    admin, seller, now = {"actor_id": "a", "actor_role": "admin"}, {"actor_id": "s1", "actor_role": "seller"}, ntz(NOW)
    yield lambda t: changes.register_users(t, make("register", {"name": "N", "email": "n@x.y", "password": "longer", "password_hash": "h", "role": "seller"}))
    yield lambda t: changes.create_listings(t, "product", make("create_product", {**seller, "product_name": "x", "price": 3, "category_id": 2, "stock": 2}))
    yield lambda t: changes.patch_rows(t, changes.PRODUCT_PATCH, make("patch_product", {**seller, "product_id": "r0", "category_id": 2, "stock": 7}, {**seller, "product_id": "r1", "is_active": False}), now)
    yield lambda t: changes.soft_delete(t, "pets", make("delete", {**seller, "target_id": "p1"}, {**seller, "target_id": "zz"}), now)
    yield lambda t: changes.checkout(t, make("checkout", {**BUYER, "shipping_address": "h", "items": [{"item_type": "pet", "pet_id": "p3", "product_id": None, "quantity": 3}]}), now)
    yield lambda t: changes.set_order_status(t, make("order_status", *[{**admin, "order_id": f"o{i}", "status": s} for i, s in enumerate(["delivered", "cancelled", "pending", "delivered"])]), now)
    yield lambda t: changes.apply_payments(t, make("payment", *[{"payment_id": f"m{i}", "status": "paid"} for i in range(8)]), now)
    yield lambda t: changes.create_reviews(t, make("review", *[{**BUYER, "item_type": "pet", "pet_id": "p1", "order_id": f"o{i}", "rating": 2} for i in range(20)]))


def test_state_after_batches_equals_a_recompute(spark):
    t = world(spark)
    state = kept(standing.standing_state(t))
    same_reports(t, state)
    moved = set()
    for batch in batches(spark):
        change = batch(t)
        delta = standing.standing_delta(t, change.sets)
        moved |= set(delta)
        state = kept(standing.advance(state, delta))
        t = {**t, **kept({name: df for name, df in change.tables.items() if name in change.sets})}
    assert moved == set(standing.FACTS)
    same_reports(t, state)


@pytest.mark.parametrize("table, gone", [("order_items", ["l1", "l2", "l3", "none"]), ("orders", ["o1", "o2"]), ("reviews", [f"v{i}" for i in range(0, 9, 3)]), ("products", ["r1", "r3"])])
def test_removed_rows_are_taken_out(spark, table, gone):
    t, key = world(spark), schema.PRIMARY_KEY[table]
    keys = spark.createDataFrame([(g,) for g in gone], f"{key} string")
    sets = {table: ChangeSet(gone=keys), "users": ChangeSet()}
    state = standing.advance(standing.standing_state(t), standing.standing_delta(t, sets))
    same_reports({**t, table: t[table].join(keys, key, "left_anti")}, state)


def test_a_line_that_moves_to_another_order(spark):
    t = world(spark)
    line = t["order_items"].filter("order_item_id = 'l5'").withColumn("order_id", F.lit("o0")).withColumn("seller_id", F.lit("s9"))
    state = standing.advance(standing.standing_state(t), standing.standing_delta(t, {"order_items": ChangeSet(line)}))
    same_reports({**t, "order_items": t["order_items"].filter("order_item_id <> 'l5'").unionByName(line)}, state)
    with pytest.raises(ValueError):
        standing.earnings_monthly(state, t, "2024-07-01 10:00:00")


def test_only_named_orders_are_read_as_facts(spark):
    t = world(spark)
    changed = t["orders"].filter("order_id = 'o4'").withColumn("status", F.lit("shipped"))
    before, after = standing._of_orders(t, {"orders": ChangeSet(changed)})
    lines = t["order_items"].filter("order_id = 'o4'").count()
    assert before["order_items"].count() == after["order_items"].count() == lines
    assert before["orders"].count() == after["orders"].count() == 1


def test_lines_that_a_batch_leaves_alone_are_summed_once(spark):
    t = world(spark)
    moved = t["orders"].filter("order_id in ('o1', 'o2', 'o3')").withColumn("status", F.lit("delivered"))
    sets = {"orders": ChangeSet(moved, t["orders"].filter("order_id = 'o4'").select("order_id"))}
    delta = standing.standing_delta(t, sets, ["seller_sales"])
    text = delta["seller_sales"]._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("sum(subtotal") == 1
    after = {**t, "orders": t["orders"].filter("order_id not in ('o1', 'o2', 'o3', 'o4')").unionByName(moved)}
    state = standing.advance(standing.standing_state(t, ["seller_sales"]), delta)
    assert rows(standing.seller_stats_by_status(state)) == rows(earnings.seller_stats_by_status(after))
