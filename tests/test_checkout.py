"""Checkout against a loop that serves one request after the other."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fixtures import at, frame, rows_of, tables
from tradewind.functions import ntz
from tradewind.operators.changes import checkout
from tradewind.sources.requests import REQUEST_SCHEMAS

NOW = "2024-02-01 00:00:00"


def serve_one_by_one(stock, active, carts, requests):
    """Outcome per request and remaining stock and carts, by the rules of a single checkout."""
    stock, carts, outcome = dict(stock), {b: list(lines) for b, lines in carts.items()}, {}
    for r in sorted(requests, key=lambda r: (r["request_ts"], r["request_id"])):
        if r["actor_role"] != "buyer":
            outcome[r["request_id"]] = "forbidden"
            continue
        if not r["shipping_address"]:
            outcome[r["request_id"]] = "missing_field"
            continue
        direct = r.get("items")
        lines = [(i["item_type"], i["pet_id"] or i["product_id"], i["quantity"]) for i in direct] if direct \
            else carts.get(r["actor_id"], [])
        wanted = Counter()
        for kind, key, quantity in lines:
            wanted[kind, key] += quantity
        if not lines:
            outcome[r["request_id"]] = "empty_cart"
        elif any(i not in stock or (direct and not active[i]) for i in wanted):
            outcome[r["request_id"]] = "not_found"
        elif any(stock[i] < n for i, n in wanted.items()):
            outcome[r["request_id"]] = "out_of_stock"
        elif len(r.get("shipping_postal") or "") > 20:
            outcome[r["request_id"]] = "constraint"
        elif (r.get("payment_method") or "transfer") not in ("transfer", "ewallet", "cod"):
            outcome[r["request_id"]] = "bad_enum"
        else:
            outcome[r["request_id"]] = "accepted"
            for i, n in wanted.items():
                stock[i] -= n
            carts[r["actor_id"]] = []
    return outcome, stock, carts


def random_batch(seed):
    rng = random.Random(seed)
    items = [("pet", f"p{i}") for i in range(3)] + [("product", f"r{i}") for i in range(3)]
    stock = {i: rng.randint(0, 9) for i in items}
    active = {i: rng.random() < 0.9 for i in items}
    buyers = [f"b{i}" for i in range(30)]
    carts = defaultdict(list)
    for b in buyers:
        for item in rng.sample(items, rng.choice([0, 1, 1, 2, 3])):
            carts[b].append((*item, rng.randint(1, 4)))
    requests = []
    for n in range(45):
        buyer = rng.choice(buyers)
        direct = None
        if rng.random() < 0.3:
            direct = []
            for kind, key in rng.choices(items + [("pet", "unknown")], k=rng.randint(1, 2)):
                direct.append({"item_type": kind, "pet_id": key if kind == "pet" else None,
                               "product_id": key if kind == "product" else None, "quantity": rng.randint(1, 3)})
        requests.append({
            "request_id": f"q{n:03d}", "request_ts": at(rng.randint(0, 20)), "actor_id": buyer,
            "actor_role": "seller" if rng.random() < 0.05 else "buyer",
            "shipping_address": "" if rng.random() < 0.05 else "home", "items": direct,
            "shipping_postal": rng.choice([None, "1" * 20, "1" * 20, "1" * 40]) if rng.random() < 0.5 else "",
            "payment_method": rng.choice([None, "", "cod", "cheque"]),
        })
    return stock, active, carts, requests


def build(spark, stock, active, carts):
    rows = defaultdict(list)
    for (kind, key), n in stock.items():
        rows[kind + "s"].append({f"{kind}_id": key, "stock": n, "price": 100 + len(key), "is_active": active[kind, key]})
    for b, lines in carts.items():
        rows["cart"].append({"cart_id": f"k-{b}", "buyer_id": b})
        for n, (kind, key, quantity) in enumerate(lines):
            rows["cart_items"].append({"item_id": f"{b}-{n}", "cart_id": f"k-{b}", "item_type": kind,
                                       f"{kind}_id": key, "quantity": quantity})
    rows["app_settings"] = [{"key": "platform_fee_percent", "value": "10"}, {"key": "shipping_cost", "value": "15"}]
    return tables(spark, **rows)


def outcomes(change, requests):
    accepted = {r["buyer_id"] for r in change.accepted.collect()}
    result = {r["request_id"]: r["reason"] for r in change.rejected.collect()}
    for r in requests:
        if r["request_id"] not in result:
            assert r["actor_id"] in accepted
            result[r["request_id"]] = "accepted"
    return result


@pytest.mark.parametrize("seed", range(6))
def test_equals_one_by_one(spark, seed):
    stock, active, carts, requests = random_batch(seed)
    want, left, carts_left = serve_one_by_one(stock, active, carts, requests)
    t = build(spark, stock, active, carts)
    change = checkout(t, frame(spark, REQUEST_SCHEMAS["checkout"], requests), ntz(NOW))
    assert outcomes(change, requests) == want
    got = {("pet", r["pet_id"]): r["stock"] for r in change.tables["pets"].collect()}
    got |= {("product", r["product_id"]): r["stock"] for r in change.tables["products"].collect()}
    assert got == left
    still = Counter(r["cart_id"] for r in change.tables["cart_items"].collect())
    assert still == Counter({f"k-{b}": len(lines) for b, lines in carts_left.items() if lines})


def test_refused_order_takes_no_stock(spark):
    carts = {"a": [("pet", "p", 2)], "b": [("pet", "p", 2)], "c": [("pet", "p", 1)]}
    t = build(spark, {("pet", "p"): 3}, {("pet", "p"): True}, carts)
    requests = [{"request_id": b, "request_ts": at(i), "actor_id": b, "actor_role": "buyer", "shipping_address": "x"}
                for i, b in enumerate("abc")]
    change = checkout(t, frame(spark, REQUEST_SCHEMAS["checkout"], requests), ntz(NOW))
    assert outcomes(change, requests) == {"a": "accepted", "b": "out_of_stock", "c": "accepted"}
    assert rows_of(change.tables["pets"], "stock") == [(0,)]


def test_amounts_and_rows(spark):
    t = build(spark, {("pet", "pp"): 9, ("product", "r"): 9}, {("pet", "pp"): True, ("product", "r"): True},
              {"a": [("pet", "pp", 2), ("product", "r", 1)]})
    requests = [{"request_id": "q", "request_ts": at(1), "actor_id": "a", "actor_role": "buyer", "shipping_address": "x",
                 "payment_method": "cod", "notes": ""}]
    change = checkout(t, frame(spark, REQUEST_SCHEMAS["checkout"], requests), ntz(NOW))
    order = change.tables["orders"].collect()[0]
    # 2 * 102 + 101 = 305; fee 30.5 rounds to 31
    assert [float(order[c]) for c in ("total_price", "shipping_cost", "platform_fee", "seller_payout")] == [320, 15, 31, 274]
    assert order["status"] == "pending" and order["notes"] is None
    payment = change.tables["payments"].collect()[0]
    assert (payment["order_id"], float(payment["amount"]), payment["method"], payment["status"]) == \
        (order["order_id"], 320, "cod", "unpaid")
    lines = change.tables["order_items"].collect()
    assert sorted((r["item_type"], r["quantity"], float(r["subtotal"])) for r in lines) == [("pet", 2, 204), ("product", 1, 101)]
    assert len({r["order_item_id"] for r in lines}) == 2
    updated = change.tables["pets"].select(F.col("updated_at").cast("string")).collect()[0][0]
    assert updated == NOW


def test_unknown_method_and_empty_batch(spark):
    t = build(spark, {("pet", "p"): 3}, {("pet", "p"): True}, {"a": [("pet", "p", 1)]})
    requests = [{"request_id": "q", "request_ts": at(1), "actor_id": "a", "actor_role": "buyer", "shipping_address": "x",
                 "payment_method": "cheque"}]
    change = checkout(t, frame(spark, REQUEST_SCHEMAS["checkout"], requests), ntz(NOW))
    assert rows_of(change.rejected, "reason") == [("bad_enum",)]
    assert change.tables["orders"].count() == 0
    nothing = checkout(t, frame(spark, REQUEST_SCHEMAS["checkout"], []), ntz(NOW))
    assert nothing.accepted.count() == 0 and nothing.rejected.count() == 0
    assert nothing.tables["cart_items"].count() == 1
