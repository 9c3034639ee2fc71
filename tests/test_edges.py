"""Small tables that exercise the rules at their edges."""

from decimal import Decimal

import pytest

from fixtures import at, rows_of, tables
from tradewind.operators import cart, catalog, dashboard, earnings, orders, people, quality, reviews
from tradewind.plans.paging import page_meta


def test_empty_tables(spark):
    t = tables(spark)
    assert [tuple(r) for r in dashboard.dashboard_inventory(t).collect()] == [("pets", 0, None), ("products", 0, None)]
    assert tuple(dashboard.dashboard_revenue(t).collect()[0]) == (0, 0)
    assert tuple(dashboard.dashboard_users(t).collect()[0]) == (0, 0, 0, 0)
    assert rows_of(dashboard.dashboard_orders(t), "status", "order_count") == [("total", 0)]
    assert tuple(page_meta(t["orders"]).collect()[0]) == (0, 1, 12, 0)
    totals = earnings.earnings_totals(t).collect()[0]
    assert (totals["total_fee_delivered"], totals["total_orders_delivered"], totals["total_fee_on_going"]) == (0, 0, 0)
    assert orders.buyer_orders(t).count() == 0
    assert catalog.list_products(t).count() == 0
    assert {r["violations"] for r in quality.audit_constraints(t).collect()} == {0}


def test_rows_without_time_come_first_and_ties_by_key(spark):
    t = tables(spark, users=[{"user_id": "b", "email": "b", "name": "n"}], orders=[
        {"order_id": "2", "buyer_id": "b", "created_at": at(1)},
        {"order_id": "1", "buyer_id": "b", "created_at": at(1)},
        {"order_id": "3", "buyer_id": "b", "created_at": at(2)},
        {"order_id": "0", "buyer_id": "b", "created_at": None},
    ])
    assert [r["order_id"] for r in dashboard.recent_orders(t, 3).collect()] == ["0", "3", "1"]
    assert [r["order_id"] for r in orders.admin_orders(t, page=2, limit=2).collect()] == ["1", "2"]


def test_parents_without_children(spark):
    t = tables(
        spark,
        users=[{"user_id": "b", "email": "b", "name": "n"}, {"user_id": "s1", "email": "s", "name": "s", "role": "seller"}],
        categories=[{"category_id": 1, "name": "full"}, {"category_id": 2, "name": "hidden"}],
        products=[{"product_id": "r", "category_id": 1}, {"product_id": "q", "category_id": 2, "is_active": False}],
        orders=[{"order_id": "o", "buyer_id": "b"}], cart=[{"cart_id": "k", "buyer_id": "b"}],
    )
    row = orders.buyer_orders(t).collect()[0]
    assert (row["items"], row["item_count"], row["items_total"], row["payment_status"]) == ([], 0, 0, None)
    assert rows_of(catalog.category_counts(t), "name", "product_count") == [("full", 1), ("hidden", 0)]
    assert rows_of(cart.cart_totals(t), "cart_id", "total_price", "item_count") == [("k", Decimal(0), 0)]
    stats = earnings.seller_stats(t).collect()[0]
    assert (stats["seller_id"], stats["gross_delivered"], stats["net_delivered"], stats["total_orders"]) == ("s1", 0, 0, 0)


@pytest.mark.parametrize("gross, fee, net", [(5, 1, 5), (15, 2, 14), ("0.05", 0, 0), ("4.99", 0, 4)])
def test_halves_round_up(spark, gross, fee, net):
    t = tables(
        spark, users=[{"user_id": "s1", "email": "s", "name": "s", "role": "seller"}],
        orders=[{"order_id": "o", "buyer_id": "b", "status": "delivered"}],
        order_items=[{"order_item_id": "i", "order_id": "o", "item_type": "pet", "pet_id": "p", "subtotal": gross}],
    )
    assert earnings.earnings_by_status(t).collect()[0]["platform_fee"] == fee
    assert earnings.seller_stats(t).collect()[0]["net_delivered"] == net


@pytest.mark.parametrize("ratings, average", [([4, 4, 4, 5], "4.3"), ([4, 5, 4, 5, 4, 4, 4, 4, 4, 4], "4.2"), ([5], "5.0")])
def test_average_rating_has_one_decimal(spark, ratings, average):
    t = tables(spark, reviews=[
        {"review_id": str(i), "reviewer_id": "b", "item_type": "pet", "pet_id": "p", "rating": r} for i, r in enumerate(ratings)
    ])
    assert rows_of(catalog.rating_summary(t["reviews"], "pet"), "avg_rating", "review_count") == \
        [(Decimal(average), len(ratings))]


def test_wildcards_stay_live(spark):
    t = tables(spark, users=[{"user_id": "s1", "email": "s", "name": "s"}], products=[
        {"product_id": n, "product_name": n} for n in ("a_b", "AxB", "50%", "zzz")
    ])
    found = lambda text: rows_of(catalog.list_products(t, catalog.ItemFilters(search=text)), "product_name")
    assert found("a_b") == [("AxB",), ("a_b",)]
    assert found("0%") == [("50%",)]
    assert len(found("%")) == 4


def test_unknown_enum_value_is_an_error(spark):
    t = tables(spark)
    with pytest.raises(ValueError):
        orders.admin_orders(t, status="lost")
    with pytest.raises(ValueError):
        catalog.list_pets(t, catalog.ItemFilters(gender="x"))


def test_unknown_sort_means_newest(spark):
    t = tables(spark, users=[{"user_id": "s1", "email": "s", "name": "s"}],
               products=[{"product_id": "old", "created_at": at(0)}, {"product_id": "new", "created_at": at(5)}])
    assert [r["product_id"] for r in catalog.list_products(t, sort="no such").collect()] == ["new", "old"]


def test_listing_skips_items_without_seller_and_keeps_inactive_sellers(spark):
    t = tables(spark, users=[{"user_id": "s1", "email": "s", "name": "s", "is_active": False}],
               products=[{"product_id": "a"}, {"product_id": "b", "seller_id": "gone"}])
    for sort in ("newest", "rating", "price_asc"):
        assert [r["product_id"] for r in catalog.list_products(t, sort=sort).collect()] == ["a"]
    assert rows_of(catalog.seller_products(t), "product_id") == [("a",), ("b",)]


@pytest.mark.parametrize("rows, fee, shipping", [
    ([], 10, 15000),
    ([("platform_fee_percent", "12abc"), ("shipping_cost", "")], 12, 0),
    ([("platform_fee_percent", "abc"), ("shipping_cost", "2.5e3")], 0, 2500),
    ([("platform_fee_percent", " 7.25")], 7.25, 15000),
])
def test_settings(spark, rows, fee, shipping):
    t = tables(spark, app_settings=[{"key": k, "value": v} for k, v in rows])
    row = people.effective_settings(t).collect()[0]
    assert (float(row["platform_fee_percent"]), float(row["shipping_cost"])) == (fee, shipping)


def test_bad_rows_are_counted(spark):
    t = tables(
        spark,
        users=[{"user_id": "u1", "email": "same", "name": "a"}, {"user_id": "u2", "email": "same", "name": "b" * 101},
               {"user_id": "u2", "email": "x", "name": None, "role": "owner"}],
        products=[{"product_id": "p", "seller_id": "nobody", "price": -1}],
        reviews=[{"review_id": "r", "reviewer_id": "u1", "item_type": "pet", "product_id": "p", "rating": 6}],
        cart_items=[{"item_id": "i", "cart_id": "none", "item_type": "pet", "pet_id": "a", "product_id": "p", "quantity": 0}],
    )
    found = {(r["table_name"], r["rule"], r["column_name"]): r["violations"]
             for r in quality.audit_constraints(t).collect() if r["violations"]}
    assert found == {
        ("users", "unique", "email"): 1, ("users", "length", "name"): 1, ("users", "primary_key", "user_id"): 1,
        ("users", "not_null", "name"): 1, ("users", "enum", "role"): 1, ("products", "check", "price"): 1,
        ("reviews", "check", "rating"): 1, ("reviews", "check", "item_ref"): 1,
        ("cart_items", "check", "item_ref"): 1, ("cart_items", "check", "quantity"): 1,
    }
    orphans = {(r["table_name"], r["column_name"]): r["orphans"]
               for r in quality.audit_foreign_keys(t).collect() if r["orphans"]}
    assert orphans == {("products", "seller_id"): 1, ("cart_items", "cart_id"): 1, ("cart_items", "pet_id"): 1}


def test_reconcile_clean_and_broken_orders(spark):
    settings = [{"key": "platform_fee_percent", "value": "10"}]
    line = {"item_type": "pet", "pet_id": "p"}
    t = tables(
        spark, app_settings=settings,
        orders=[{"order_id": "good", "buyer_id": "b", "total_price": 100, "shipping_cost": 15, "platform_fee": 9, "seller_payout": 76},
                {"order_id": "bad", "buyer_id": "b", "total_price": 100, "shipping_cost": 15, "platform_fee": 9, "seller_payout": 70}],
        order_items=[{"order_item_id": "1", "order_id": "good", "subtotal": 60, **line},
                     {"order_item_id": "2", "order_id": "good", "subtotal": 25, **line}],
        payments=[{"payment_id": "p", "order_id": "good", "amount": 100}],
    )
    flags = ["order_id", "lines_match", "fee_matches", "payout_matches", "has_payment", "payment_matches"]
    assert rows_of(quality.reconcile_orders(t), *flags) == [
        ("bad", False, False, False, False, False), ("good", True, True, True, True, True)]


def test_access(spark):
    users = [{"user_id": "b1", "email": "1", "name": "n"}, {"user_id": "b2", "email": "2", "name": "n", "is_active": False},
             {"user_id": "s", "email": "3", "name": "n", "role": "seller"}, {"user_id": "a", "email": "4", "name": "n", "role": "admin"}]
    t = tables(spark, users=users, orders=[{"order_id": o, "buyer_id": o[:2]} for o in ("b1x", "b1y", "b2x")])
    seen = lambda viewer: rows_of(people.visible_to(t["orders"], t["users"], "buyer_id", viewer), "order_id")
    everything = [("b1x",), ("b1y",), ("b2x",)]
    assert seen("b1") == [("b1x",), ("b1y",)]
    assert seen("b2") == []
    assert seen("s") == everything and seen("a") == everything
    assert seen("nobody") == []
    counts = rows_of(people.visible_counts(t["orders"], t["users"], "buyer_id"), "viewer_id", "visible_rows")
    assert counts == [("a", 3), ("b1", 2), ("s", 3)]


def test_review_keys_and_eligibility(spark):
    t = tables(
        spark, orders=[{"order_id": "o", "buyer_id": "b", "status": "delivered"}, {"order_id": "w", "buyer_id": "b"}],
        order_items=[{"order_item_id": "1", "order_id": "o", "item_type": "pet", "pet_id": "p"},
                     {"order_item_id": "2", "order_id": "o", "item_type": "product", "product_id": "p"},
                     {"order_item_id": "3", "order_id": "w", "item_type": "pet", "pet_id": "p"}],
        reviews=[{"review_id": "1", "reviewer_id": "b", "order_id": "o", "item_type": "pet", "pet_id": "p"},
                 {"review_id": "2", "reviewer_id": "b", "item_type": "product", "product_id": "z"}],
    )
    assert rows_of(reviews.reviewed_keys(t, "b"), "review_key") == [("order:null:product:z",), ("order:o:pet:p",)]
    assert rows_of(reviews.review_eligibility(t), "order_id", "item_type", "item_id") == [("o", "product", "p")]


def test_blocked_and_cascading_deletes(spark):
    t = tables(
        spark,
        users=[{"user_id": u, "email": u, "name": u} for u in ("s1", "s2", "b")],
        pets=[{"pet_id": "p1", "seller_id": "s1"}, {"pet_id": "p2", "seller_id": "s2"}],
        cart=[{"cart_id": "k", "buyer_id": "s1"}],
        cart_items=[{"item_id": "i", "cart_id": "k", "item_type": "pet", "pet_id": "p1"}],
        orders=[{"order_id": "o", "buyer_id": "b"}],
        order_items=[{"order_item_id": "l", "order_id": "o", "item_type": "pet", "pet_id": "p1", "seller_id": "s2"}],
        reviews=[{"review_id": "r", "reviewer_id": "s1", "order_id": "o", "item_type": "pet", "pet_id": "p1"}],
    )
    keys = spark.createDataFrame([("s1",), ("s2",), ("b",), ("nobody",)], "user_id string")
    found = rows_of(quality.propagate_delete(t, "users", keys), "table_name", "row_key", "action", "column_name")
    assert found == sorted([
        ("users", "b", "blocked", None), ("users", "s2", "blocked", None), ("users", "s1", "delete", None),
        ("pets", "p1", "delete", None), ("cart", "k", "delete", None), ("cart_items", "i", "delete", None),
        ("reviews", "r", "delete", None), ("order_items", "l", "set_null", "pet_id"),
    ], key=repr)
