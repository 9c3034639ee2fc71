"""Batches in which requests come twice, rows at the limits of a type, and orders of reasons."""

import random

import pytest
from pyspark.sql import functions as F

from fixtures import at, frame, tables
from tradewind import schema
from tradewind.functions import ntz
from tradewind.operators import changes
from tradewind.plans.requests import once
from tradewind.sources.requests import REQUEST_SCHEMAS

NOW = "2024-02-01 00:00:00"


def world(spark):
    return tables(
        spark, users=[{"user_id": "b1", "email": "b1@x.y", "name": "B"}, {"user_id": "s1", "email": "s1@x.y", "name": "S", "role": "seller"}],
        categories=[{"category_id": 1, "name": "old"}], cart=[{"cart_id": "k1", "buyer_id": "b1"}],
        pets=[{"pet_id": "p1", "stock": 9}], products=[{"product_id": "r1", "stock": 9}],
        cart_items=[{"item_id": "i1", "cart_id": "k1", "item_type": "pet", "pet_id": "p1", "quantity": 2}],
        orders=[{"order_id": "o1", "buyer_id": "b1", "status": "delivered"}],
        order_items=[{"order_item_id": "l1", "order_id": "o1", "item_type": "pet", "pet_id": "p1"}],
        payments=[{"payment_id": "m1", "order_id": "o1"}])


BUYER = {"actor_id": "b1", "actor_role": "buyer"}
DIRECT = [{"item_type": "pet", "pet_id": "p1", "product_id": None, "quantity": 1}]
# operator, kind of request, a sound request, and what a second copy changes
CASES = {
    "register": (lambda t, q: changes.register_users(t, q), "register", {"name": "N", "email": "n@x.y", "password": "longer", "password_hash": "h"}, {"email": "m@x.y"}),
    "pet": (lambda t, q: changes.create_listings(t, "pet", q), "create_pet", {"actor_id": "s1", "actor_role": "seller", "pet_name": "c", "species": "cat", "gender": "Jantan", "price": 3}, {"price": 4}),
    "patch": (lambda t, q: changes.patch_rows(t, changes.PET_PATCH, q, ntz(NOW)), "patch_pet", {"actor_id": "s1", "actor_role": "seller", "pet_id": "p1", "stock": 3}, {"stock": 4}),
    "delete": (lambda t, q: changes.soft_delete(t, "pets", q, ntz(NOW)), "delete", {"actor_id": "s1", "actor_role": "seller", "target_id": "p1"}, {"target_id": "zz"}),
    "add": (lambda t, q: changes.add_to_cart(t, q), "add_to_cart", {**BUYER, "item_type": "product", "product_id": "r1", "quantity": 2}, {"quantity": 3}),
    "edit": (lambda t, q: changes.edit_cart(t, q), "edit_cart", {**BUYER, "op": "set", "item_id": "i1", "quantity": 5}, {"quantity": 6}),
    "checkout": (lambda t, q: changes.checkout(t, q, ntz(NOW)), "checkout", {**BUYER, "shipping_address": "home", "items": DIRECT}, {"notes": "again"}),
    "cart checkout": (lambda t, q: changes.checkout(t, q, ntz(NOW)), "checkout", {**BUYER, "shipping_address": "home"}, {"notes": "again"}),
    "status": (lambda t, q: changes.set_order_status(t, q, ntz(NOW)), "order_status", {"actor_id": "a", "actor_role": "admin", "order_id": "o1", "status": "shipped"}, {"status": "pending"}),
    "payment": (lambda t, q: changes.apply_payments(t, q, ntz(NOW)), "payment", {"payment_id": "m1", "status": "paid"}, {"status": "failed"}),
    "review": (lambda t, q: changes.create_reviews(t, q), "review", {**BUYER, "item_type": "pet", "pet_id": "p1", "order_id": "o1", "rating": 4}, {"rating": 5}),
    "settings": (lambda t, q: changes.upsert_settings(t, q), "settings", {"actor_id": "a", "actor_role": "admin", "platform_fee_percent": "5"}, {"platform_fee_percent": "6"}),
    "category": (lambda t, q: changes.create_categories(t, q), "category", {"actor_id": "a", "actor_role": "admin", "name": "new"}, {"name": "newer"}),
}


def contents(change, names):
    drop = {"month"}
    return {n: sorted(map(str, change.tables[n].select(*[c for c in change.tables[n].columns if c not in drop]).collect())) for n in names}


@pytest.mark.parametrize("name", CASES)
def test_a_repeated_request_counts_once(spark, name):
    run, kind, sound, change = CASES[name]
    first = {"request_id": "q1", "request_ts": at(1), **sound}
    copies = [first, first, {**first, **change, "request_ts": at(2)}]
    make = lambda rows: frame(spark, REQUEST_SCHEMAS[kind], rows)
    got, want = run(world(spark), make(copies).repartition(3)), run(world(spark), make([first]))
    assert contents(got, want.tables) == contents(want, want.tables)
    assert want.rejected.count() == 0 and got.accepted.count() == want.accepted.count() == 1
    assert [(r.request_id, r.reason) for r in got.rejected.collect()] == [("q1", "duplicate_request")] * 2
    for table in got.tables:
        key = schema.PRIMARY_KEY[table]
        assert got.tables[table].groupBy(key).count().filter("count > 1").count() == 0


def test_the_earliest_row_counts(spark):
    dice = random.Random(5)
    rows = [{"request_id": f"q{dice.randrange(30)}", "request_ts": at(dice.randrange(20)), "payment_id": f"m{i}", "status": "paid"} for i in range(120)]
    kept, repeated = once(frame(spark, REQUEST_SCHEMAS["payment"], rows).repartition(4))
    times = {}
    for r in rows:
        times[r["request_id"]] = min(times.get(r["request_id"], r["request_ts"]), r["request_ts"])
    assert {r.request_id: r.request_ts for r in kept.collect()} == times and kept.count() == len(times)
    assert repeated.count() == len(rows) - len(times)
    assert once(kept)[1] is None


def test_ties_in_time_go_by_the_columns_in_order_of_their_names(spark):
    rows = [{"request_id": "q1", "request_ts": at(1), "actor_id": a, "payment_id": p, "status": s}
            for a, p, s in (("b", "m0", "paid"), ("a", "m2", "paid"), ("a", "m1", "unpaid"), ("a", "m1", "paid"))]
    for shuffled in (rows, rows[::-1]):
        kept, _ = once(frame(spark, REQUEST_SCHEMAS["payment"], shuffled).repartition(3))
        assert [(r.actor_id, r.payment_id, r.status) for r in kept.collect()] == [("a", "m1", "paid")]
    kept, _ = once(frame(spark, REQUEST_SCHEMAS["payment"], [*rows, {"request_id": "q1", "request_ts": at(1), "payment_id": "m9"}]))
    assert [r.payment_id for r in kept.collect()] == ["m9"]  # a missing value comes first


def test_once_leaves_no_count_behind(spark):
    from tradewind.plans.skew import batch_rows

    once(frame(spark, REQUEST_SCHEMAS["payment"], [{"request_id": "q1", "request_ts": at(1)}] * 3))
    assert batch_rows.get() is None
    CASES["payment"][0](world(spark), frame(spark, REQUEST_SCHEMAS["payment"], [{"request_id": "q1", "request_ts": at(1)}]))
    assert batch_rows.get() is None


def test_cart_quantities_stay_within_the_type(spark):
    most = schema.MAX_INT
    t = tables(spark, cart=[{"cart_id": "k1", "buyer_id": "b1"}], pets=[{"pet_id": "p1", "stock": most}, {"pet_id": "p2", "stock": most}],
               cart_items=[{"item_id": "i1", "cart_id": "k1", "item_type": "pet", "pet_id": "p1", "quantity": most - 5}])
    ask = lambda i, pet, n: {"request_id": f"q{i}", "request_ts": at(i), **BUYER, "item_type": "pet", "pet_id": pet, "quantity": n}
    requests = [ask(1, "p1", 3), ask(2, "p1", 3), ask(3, "p1", 2), ask(4, "p1", 1), ask(5, "p2", most), ask(6, "p2", 1)]
    change = changes.add_to_cart(t, frame(spark, REQUEST_SCHEMAS["add_to_cart"], requests))
    assert {r.request_id: r.reason for r in change.rejected.collect()} == {q: "constraint" for q in ("q2", "q4", "q6")}
    assert {r.pet_id: r.quantity for r in change.tables["cart_items"].collect()} == {"p1": most, "p2": most}


def test_checkout_reasons_in_order(spark):
    t = tables(spark, users=[{"user_id": f"b{i}", "email": f"b{i}"} for i in range(9)], cart=[{"cart_id": "k0", "buyer_id": "b0"}],
               pets=[{"pet_id": "p1", "stock": 1_000_000, "price": 9_999_000}, {"pet_id": "p2", "stock": 1, "price": 1}])
    buy = lambda pet, n: [{"item_type": "pet", "pet_id": pet, "product_id": None, "quantity": n}]
    cases = {
        "empty_cart": {"payment_method": "cheque"}, "not_found": {"payment_method": "cheque", "items": buy("zz", 1)},
        "out_of_stock": {"payment_method": "cheque", "items": buy("p2", 2)}, "bad_enum": {"payment_method": "cheque", "items": buy("p2", 1)},
        "constraint": {"shipping_postal": "1" * 40, "items": buy("p2", 1)}, "too_large": {"items": buy("p1", 1001)}, "odd": {"items": buy("p2", 0)},
        "missing_field": {"shipping_address": "", "payment_method": "cheque"},
    }
    rows = [{"request_id": name, "request_ts": at(i), "actor_id": f"b{i}", "actor_role": "buyer", "shipping_address": "home", **case}
            for i, (name, case) in enumerate(cases.items())]
    rows.append({"request_id": "fits", "request_ts": at(60), "actor_id": "b8", "actor_role": "buyer", "shipping_address": "home",
                 "shipping_postal": "1" * 20, "items": [*buy("p2", 1), *buy("p1", 1000)]})
    change = changes.checkout(t, frame(spark, REQUEST_SCHEMAS["checkout"], rows), ntz(NOW))
    reasons = {r.request_id: r.reason for r in change.rejected.collect()}
    assert reasons == {**{n: n for n in cases}, "too_large": "constraint", "odd": "constraint"}
    # refused requests took no stock
    assert change.accepted.count() == 1
    assert {r.pet_id: r.stock for r in change.tables["pets"].collect()} == {"p1": 999_000, "p2": 0}


def test_editing_makes_a_missing_cart(spark):
    t = tables(spark, cart=[{"cart_id": "k1", "buyer_id": "b1"}])
    rows = [{"request_id": f"q{i}", "request_ts": at(i), "actor_id": actor, "actor_role": role, "op": op, "item_id": "zz", "quantity": 1}
            for i, (actor, role, op) in enumerate([("b1", "buyer", "clear"), ("b2", "buyer", "clear"), ("b2", "buyer", "set"), ("b3", "seller", "clear"), ("b4", "buyer", "remove")])]
    change = changes.edit_cart(t, frame(spark, REQUEST_SCHEMAS["edit_cart"], rows))
    assert sorted(r.buyer_id for r in change.tables["cart"].collect()) == ["b1", "b2", "b4"]
    assert change.tables["cart"].filter(F.col("created_at").isNull()).count() == 0


def test_lists_beyond_the_old_limits(spark):
    from tradewind.operators import dashboard, reviews

    t = tables(spark, users=[{"user_id": "b", "email": "b", "name": "B"}], pets=[{"pet_id": "p"}],
               orders=[{"order_id": f"o{i:04d}", "buyer_id": "b", "created_at": at(i)} for i in range(300)],
               reviews=[{"review_id": f"v{i}", "reviewer_id": "b", "item_type": "pet", "pet_id": "p"} for i in range(30)])
    assert [r.order_id for r in dashboard.recent_orders(t, 250).collect()] == [f"o{i:04d}" for i in range(299, 49, -1)]
    assert dashboard.recent_orders(t, 0).count() == 0 and dashboard.recent_orders(t).count() == 10
    assert reviews.item_reviews(t, "pet", page=None).count() == 30
    assert tuple(reviews.item_reviews_meta(t, "pet", 2).first()) == ("p", 30, 2, 12, 3)


def test_a_batch_is_read_from_files_by_column(spark):
    batch = spark.createDataFrame([("a", 1, "x" * 50), ("b", 2, "y"), ("b", 3, "z")], "request_id string, request_ts int, body string")
    rows, repeated = once(batch)
    text = rows.select("request_id")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in text and sorted(r.body for r in rows.collect()) == ["x" * 50, "y"] and repeated.count() == 1


def test_a_batch_with_a_column_without_a_type(spark):
    rows, _ = once(spark.sql("SELECT 'a' AS request_id, 1 AS request_ts, NULL AS note"))
    assert [tuple(r) for r in rows.collect()] == [("a", 1, None)]


def test_a_refused_status_request_is_listed_once_per_row_of_its_order(spark):
    t = world(spark)
    t = {**t, "orders": t["orders"].unionByName(t["orders"])}
    asked = [{"request_id": "q0", "request_ts": at(0), "order_id": "o1", "actor_role": "admin", "actor_id": "a", "status": "lost"}]
    change = changes.set_order_status(t, frame(spark, REQUEST_SCHEMAS["order_status"], asked), ntz(NOW))
    assert [r.reason for r in change.rejected.collect()] == ["bad_enum", "bad_enum"]
