"""Change operators against loops that apply one request after the other."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fixtures import at, frame, rows_of, tables
from tradewind.functions import ntz
from tradewind.operators import changes
from tradewind.sources import REQUEST_SCHEMAS, evolve_schema, insert_if_absent

NOW = "2024-02-01 00:00:00"
SEEDS = [11, 12]


def in_order(requests):
    return sorted(requests, key=lambda r: (r["request_ts"], r["request_id"]))


def batch(rng, n, make):
    """n requests with ids and times, some of them at the same time."""
    return [{"request_id": f"q{i:03d}", "request_ts": at(rng.randint(0, n // 3)), **make()} for i in range(n)]


def reasons(change):
    return {r["request_id"]: r["reason"] for r in change.rejected.collect()}


@pytest.mark.parametrize("seed", SEEDS)
def test_add_to_cart(spark, seed):
    rng = random.Random(seed)
    items = {("pet", "p1"): (3, True), ("pet", "p2"): (9, False), ("product", "r1"): (5, True)}
    start = {("k1", "pet", "p1"): 4, ("k1", "product", "r1"): 1}
    carts = {"b1": "k1", "b2": "k2"}

    def make():
        kind = rng.choice(["pet", "product", "toy"])
        key = rng.choice(["p1", "p2", "r1", "zz", None])
        return {"actor_id": rng.choice(["b1", "b2", "b3"]), "actor_role": rng.choice(["buyer"] * 6 + ["admin"]), "item_type": kind,
                "pet_id": key if kind == "pet" else None, "product_id": key if kind == "product" else None,
                "quantity": rng.choice([None, 0, -1, 1, 2, 3, 4, 9])}

    requests = batch(rng, 60, make)
    lines, want = dict(start), {}
    owners = dict(carts)
    for r in in_order(requests):
        quantity = 1 if r["quantity"] is None else r["quantity"]
        key = (r["item_type"], r["pet_id"] or r["product_id"])
        stock, active = items.get(key, (0, False))
        if r["actor_role"] != "buyer":
            want[r["request_id"]] = "forbidden"
        elif r["item_type"] == "toy":
            want[r["request_id"]] = "bad_enum"
        elif key[1] is None:
            want[r["request_id"]] = "missing_field"
        elif not active:
            want[r["request_id"]] = "not_found"
        elif stock < quantity:
            want[r["request_id"]] = "out_of_stock"
        elif quantity < 1:
            want[r["request_id"]] = "constraint"
        else:
            cart = owners.setdefault(r["actor_id"], "new")
            lines[cart, *key] = lines.get((cart, *key), 0) + quantity
    t = tables(
        spark, pets=[{"pet_id": k, "stock": s, "is_active": a} for (kind, k), (s, a) in items.items() if kind == "pet"],
        products=[{"product_id": k, "stock": s, "is_active": a} for (kind, k), (s, a) in items.items() if kind == "product"],
        cart=[{"cart_id": k, "buyer_id": b} for b, k in carts.items()],
        cart_items=[{"item_id": "-".join(k), "cart_id": k[0], "item_type": k[1], f"{k[1]}_id": k[2], "quantity": n}
                    for k, n in start.items()],
    )
    change = changes.add_to_cart(t, frame(spark, REQUEST_SCHEMAS["add_to_cart"], requests))
    assert reasons(change) == want
    new_cart = {r["cart_id"]: r["buyer_id"] for r in change.tables["cart"].collect()}
    got = {(r["cart_id"] if r["cart_id"] in ("k1", "k2") else "new", r["item_type"], r["pet_id"] or r["product_id"]): r["quantity"]
           for r in change.tables["cart_items"].collect()}
    assert got == lines
    assert set(new_cart.values()) == set(owners) and len(new_cart) == len(owners)


@pytest.mark.parametrize("seed", SEEDS)
def test_edit_cart(spark, seed):
    rng = random.Random(seed)
    start = {f"i{n}": (f"k{n % 3}", rng.randint(1, 5)) for n in range(9)}

    def make():
        return {"actor_id": rng.choice(["b0", "b1", "b2", "b9"]), "actor_role": "buyer",
                "op": rng.choice(["set"] * 8 + ["remove"] * 3 + ["clear", "swap"]),
                "item_id": rng.choice([*start, "none"]), "quantity": rng.choice([None, 0, 1, 2, 7])}

    requests = batch(rng, 50, make)
    lines, want = dict(start), {}
    for r in in_order(requests):
        cart = "k" + r["actor_id"][1]
        if r["op"] == "swap":
            want[r["request_id"]] = "bad_enum"
        elif r["op"] == "set" and (r["quantity"] or 0) < 1:
            want[r["request_id"]] = "out_of_range"
        elif r["op"] == "clear":
            lines = {i: v for i, v in lines.items() if v[0] != cart}
        elif lines.get(r["item_id"], ("", 0))[0] != cart:
            want[r["request_id"]] = "not_found"
        elif r["op"] == "set":
            lines[r["item_id"]] = (cart, r["quantity"])
        else:
            del lines[r["item_id"]]
    t = tables(spark, cart=[{"cart_id": f"k{n}", "buyer_id": f"b{n}"} for n in range(3)],
               cart_items=[{"item_id": i, "cart_id": c, "item_type": "pet", "pet_id": "p", "quantity": q} for i, (c, q) in start.items()])
    change = changes.edit_cart(t, frame(spark, REQUEST_SCHEMAS["edit_cart"], requests))
    assert reasons(change) == want
    assert {r["item_id"]: (r["cart_id"], r["quantity"]) for r in change.tables["cart_items"].collect()} == lines


@pytest.mark.parametrize("seed", SEEDS)
def test_order_status(spark, seed):
    rng = random.Random(seed)
    state = {f"o{n}": "pending" for n in range(4)}
    owners = {("o0", "s1"), ("o1", "s1"), ("o1", "s2"), ("o2", "s2"), ("gone", "s1")}
    make = lambda: {"actor_id": rng.choice(["s1", "s2"]), "actor_role": rng.choice(["seller", "seller", "admin", "buyer"]),
                    "order_id": rng.choice([*state, "gone"]), "status": rng.choice(["pending", "processing", "shipped", "lost", None])}
    requests = batch(rng, 50, make)
    want, moved = {}, set()
    for r in in_order(requests):
        admin = r["actor_role"] == "admin"
        if r["actor_role"] == "buyer":
            want[r["request_id"]] = "forbidden"
        elif r["status"] in ("lost", None) or (not admin and r["status"] == "pending"):
            want[r["request_id"]] = "bad_enum"
        elif not admin and (r["order_id"], r["actor_id"]) not in owners:
            want[r["request_id"]] = "forbidden"
        elif r["order_id"] not in state:
            want[r["request_id"]] = "not_found"
        else:
            state[r["order_id"]] = r["status"]
            moved.add(r["order_id"])
    t = tables(spark, orders=[{"order_id": o, "buyer_id": "b"} for o in state],
               order_items=[{"order_item_id": f"{o}{s}", "order_id": o, "seller_id": s, "item_type": "pet", "pet_id": "p"} for o, s in owners])
    change = changes.set_order_status(t, frame(spark, REQUEST_SCHEMAS["order_status"], requests), ntz(NOW))
    assert reasons(change) == want
    rows = change.tables["orders"].select("order_id", "status", F.col("updated_at").cast("string").alias("u")).collect()
    assert {r["order_id"]: r["status"] for r in rows} == state
    assert {r["order_id"] for r in rows if r["u"] == NOW} == moved


@pytest.mark.parametrize("seed", SEEDS)
def test_payments(spark, seed):
    rng = random.Random(seed)
    payments = {f"p{n}": {"status": "unpaid", "reference_no": "old", "paid_at": None, "order": f"o{n}"} for n in range(4)}
    orders = {"o0": "pending", "o1": "pending", "o2": "shipped", "o3": "pending"}
    make = lambda: {"payment_id": rng.choice([*payments, "none"]), "status": rng.choice(["paid", "failed", "refunded", "lost"]),
                    "reference_no": rng.choice([None, "", "x", "y"])}
    requests = batch(rng, 25, make)
    t = tables(spark, orders=[{"order_id": o, "buyer_id": "b", "status": s} for o, s in orders.items()],
               payments=[{"payment_id": p, "order_id": v["order"], "reference_no": "old"} for p, v in payments.items()])
    want = {}
    for r in in_order(requests):
        if r["status"] == "lost":
            want[r["request_id"]] = "bad_enum"
        elif r["payment_id"] not in payments:
            want[r["request_id"]] = "not_found"
        else:
            row = payments[r["payment_id"]]
            row.update(status=r["status"], reference_no=r["reference_no"] or row["reference_no"],
                       paid_at=r["request_ts"] if r["status"] == "paid" else None)
            if r["status"] == "paid" and orders[row["order"]] == "pending":
                orders[row["order"]] = "processing"
    frame_ = frame(spark, REQUEST_SCHEMAS["payment"], requests)
    change = changes.apply_payments(t, frame_, ntz(NOW))
    assert reasons(change) == want
    got = {r["payment_id"]: (r["status"], r["reference_no"], r["paid_at"]) for r in change.tables["payments"].collect()}
    assert got == {p: (v["status"], v["reference_no"], v["paid_at"]) for p, v in payments.items()}
    assert {r["order_id"]: r["status"] for r in change.tables["orders"].collect()} == orders
    again = changes.apply_payments({**t, **change.tables}, frame_, ntz(NOW))
    for table in ("payments", "orders"):
        columns = t[table].columns
        assert rows_of(again.tables[table], *columns) == rows_of(change.tables[table], *columns)


@pytest.mark.parametrize("seed", SEEDS)
def test_reviews(spark, seed):
    rng = random.Random(seed)
    lines = [("o1", "pet", "p1"), ("o1", "product", "r1"), ("o2", "pet", "p1"), ("o3", "pet", "p1")]
    buyers, delivered = {"o1": "b1", "o2": "b1", "o3": "b2"}, {"o1", "o2"}
    written = {("b1", "o2", "pet", "p1")}

    def make():
        kind = rng.choice(["pet", "product", "toy"])
        key = rng.choice(["p1", "r1", None])
        return {"actor_id": rng.choice(["b1", "b1", "b2"]), "actor_role": "buyer", "item_type": kind,
                "pet_id": key if kind == "pet" else None, "product_id": key if kind == "product" else None,
                "order_id": rng.choice(["o1", "o1", "o2", "o3", None]), "rating": rng.choice([None, 0, 1, 3, 5, 6, 2.5]), "comment": ""}

    requests = batch(rng, 80, make)
    want = {}
    seen = set(written)
    for r in in_order(requests):
        item = r["pet_id"] or r["product_id"]
        key = (r["actor_id"], r["order_id"], r["item_type"], item)
        if r["item_type"] == "toy":
            want[r["request_id"]] = "bad_enum"
        elif not r["rating"] or not 1 <= r["rating"] <= 5:
            want[r["request_id"]] = "out_of_range"
        elif r["order_id"] is None or item is None:
            want[r["request_id"]] = "missing_field"
        elif r["order_id"] not in delivered or buyers[r["order_id"]] != r["actor_id"] or key[1:] not in lines:
            want[r["request_id"]] = "not_eligible"
        elif key in seen:
            want[r["request_id"]] = "duplicate"
        elif r["rating"] == 2.5:
            want[r["request_id"]] = "constraint"
        else:
            seen.add(key)
    t = tables(spark, orders=[{"order_id": o, "buyer_id": b, "status": "delivered" if o in delivered else "shipped"} for o, b in buyers.items()],
               order_items=[{"order_item_id": "-".join(x), "order_id": x[0], "item_type": x[1], f"{x[1]}_id": x[2]} for x in lines],
               reviews=[{"review_id": "r", "reviewer_id": b, "order_id": o, "item_type": k, f"{k}_id": i} for b, o, k, i in written])
    change = changes.create_reviews(t, frame(spark, REQUEST_SCHEMAS["review"], requests))
    assert reasons(change) == want
    got = {(r["reviewer_id"], r["order_id"], r["item_type"], r["pet_id"] or r["product_id"]) for r in change.tables["reviews"].collect()}
    assert got == seen and change.tables["reviews"].count() == len(seen)


@pytest.mark.parametrize("seed", SEEDS)
def test_registration(spark, seed):
    rng = random.Random(seed)
    make = lambda: {"name": rng.choice(["", None, " Ann ", "x" * 101]), "password": rng.choice(["", "12345", "123456"]),
                    "email": rng.choice(["A@b.co", "a@B.co", "old@x.y", "no", "a b@c.d", "a@b.c\n", "c@d.ef", None]),
                    "phone": rng.choice([None, "", "08"]), "role": rng.choice([None, "admin", "seller", "buyer"])}
    requests = batch(rng, 150, make)
    emails, want, new = {"old@x.y"}, {}, {}
    for r in in_order(requests):
        if not r["name"] or not r["email"] or not r["password"]:
            want[r["request_id"]] = "missing_field"
        elif len(r["password"]) < 6:
            want[r["request_id"]] = "password_too_short"
        elif not re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", r["email"]):
            want[r["request_id"]] = "bad_email"
        elif r["email"].lower() in emails:
            want[r["request_id"]] = "duplicate"
        elif len(r["name"].strip()) > 100:
            want[r["request_id"]] = "constraint"
        else:
            emails.add(r["email"].lower())
            role = "seller" if r["role"] == "seller" else "buyer"
            new[r["email"].lower()] = (r["name"].strip(), r["phone"] or None, role, role == "buyer")
    t = tables(spark, users=[{"user_id": "u", "email": "old@x.y", "name": "n"}])
    change = changes.register_users(t, frame(spark, REQUEST_SCHEMAS["register"], requests))
    assert reasons(change) == want
    rows = change.accepted.collect()
    assert {r["email"]: (r["name"], r["phone"], r["role"], r["is_verified"]) for r in rows} == new
    buyers = {r["user_id"] for r in rows if r["role"] == "buyer"}
    assert {r["buyer_id"] for r in change.tables["cart"].collect()} == buyers
    assert change.tables["users"].count() == 1 + len(new)


@pytest.mark.parametrize("seed", SEEDS)
def test_patches(spark, seed):
    rng = random.Random(seed)
    pets = {f"p{n}": {"pet_name": f"n{n}", "price": 10, "stock": 5, "gender": "Jantan", "is_active": True, "seller": f"s{n % 2}"} for n in range(4)}
    make = lambda: {"pet_id": rng.choice([*pets, "none"]), "actor_id": rng.choice(["s0", "s1"]),
                    "actor_role": rng.choice(["seller", "seller", "admin", "buyer"]), "pet_name": rng.choice([None, "", "x", "y" * 151]),
                    "price": rng.choice([None, 0, 7, -1]), "stock": rng.choice([None, 0, 3]),
                    "gender": rng.choice([None, "", "Betina", "other"]), "is_active": rng.choice([None, False, True])}
    requests = batch(rng, 80, make)
    t = tables(spark, pets=[{"pet_id": k, "seller_id": v["seller"], **{c: v[c] for c in ("pet_name", "price", "stock", "gender", "is_active")}}
                            for k, v in pets.items()])
    want = {}
    for r in in_order(requests):
        pet = pets.get(r["pet_id"])
        if r["actor_role"] == "buyer":
            want[r["request_id"]] = "forbidden"
        elif pet is None:
            want[r["request_id"]] = "not_found"
        elif r["actor_role"] == "seller" and pet["seller"] != r["actor_id"]:
            want[r["request_id"]] = "forbidden"
        elif r["gender"] == "other":
            want[r["request_id"]] = "bad_enum"
        elif (r["price"] or 0) < 0 or len(r["pet_name"] or "") > 150:
            want[r["request_id"]] = "constraint"
        else:
            for c in ("pet_name", "price", "stock", "gender"):
                pet[c] = r[c] or pet[c]
            pet["is_active"] = pet["is_active"] if r["is_active"] is None else r["is_active"]
    change = changes.patch_rows(t, changes.PET_PATCH, frame(spark, REQUEST_SCHEMAS["patch_pet"], requests), ntz(NOW))
    assert reasons(change) == want
    got = {r["pet_id"]: {c: r[c] for c in ("pet_name", "price", "stock", "gender", "is_active")} for r in change.tables["pets"].collect()}
    assert got == {k: {c: v[c] for c in v if c != "seller"} for k, v in pets.items()}


def test_profiles_keep_and_take_empty_text(spark):
    t = tables(spark, users=[{"user_id": "u", "email": "e", "name": "n", "phone": "1", "address": "here"}])
    requests = [{"request_id": "a", "request_ts": at(0), "actor_id": "u", "user_id": "u", "name": "", "phone": "", "address": "", "city": "c"},
                {"request_id": "b", "request_ts": at(1), "actor_id": "other", "user_id": "u", "city": "d"}]
    change = changes.patch_rows(t, changes.PROFILE_PATCH, frame(spark, REQUEST_SCHEMAS["patch_profile"], requests), ntz(NOW))
    assert rows_of(change.tables["users"], "name", "phone", "address", "city") == [("n", "1", "", "c")]
    assert reasons(change) == {"b": "forbidden"}


def test_settings_keep_the_fee_of_a_half_bad_request(spark):
    t = tables(spark, app_settings=[{"key": "platform_fee_percent", "value": "10"}])
    requests = [
        {"request_id": "a", "request_ts": at(0), "actor_role": "admin", "platform_fee_percent": "12.50x", "shipping_cost": "-1"},
        {"request_id": "b", "request_ts": at(1), "actor_role": "admin", "platform_fee_percent": "101", "shipping_cost": "5"},
        {"request_id": "c", "request_ts": at(2), "actor_role": "seller", "shipping_cost": "6"},
        {"request_id": "d", "request_ts": at(3), "actor_role": "admin", "shipping_cost": "1e2"},
        {"request_id": "e", "request_ts": at(4), "actor_role": "admin"},
    ]
    frame_ = frame(spark, REQUEST_SCHEMAS["settings"], requests)
    change = changes.upsert_settings(t, frame_)
    assert rows_of(change.tables["app_settings"], "key", "value") == [("platform_fee_percent", "12.5"), ("shipping_cost", "100")]
    assert reasons(change) == {"a": "out_of_range", "b": "out_of_range", "c": "forbidden"}
    again = changes.upsert_settings(change.tables, frame_)
    assert rows_of(again.tables["app_settings"], "key", "value") == rows_of(change.tables["app_settings"], "key", "value")


def test_categories_get_the_next_numbers(spark):
    t = tables(spark, categories=[{"category_id": 4, "name": "old"}])
    names = ["b", " a ", "a", "old", "", None, "c"]
    requests = [{"request_id": str(i), "request_ts": at(i), "actor_role": "admin", "name": n} for i, n in enumerate(names)]
    change = changes.create_categories(t, frame(spark, REQUEST_SCHEMAS["category"], requests))
    assert rows_of(change.tables["categories"], "category_id", "name") == [(4, "old"), (5, "b"), (6, "a"), (7, "c")]
    assert reasons(change) == {"2": "duplicate", "3": "duplicate", "4": "missing_field", "5": "missing_field"}


def test_deletions(spark):
    t = tables(spark, users=[{"user_id": u, "email": u, "name": u} for u in ("a", "b")], products=[{"product_id": "p"}])
    ask = lambda rows: frame(spark, REQUEST_SCHEMAS["delete"], [{"request_id": str(i), "request_ts": at(i), **r} for i, r in enumerate(rows)])
    change = changes.soft_delete(t, "users", ask([
        {"actor_id": "a", "actor_role": "admin", "target_id": "a"}, {"actor_id": "a", "actor_role": "admin", "target_id": "b"},
        {"actor_id": "a", "actor_role": "admin", "target_id": "b"}, {"actor_id": "a", "actor_role": "admin", "target_id": "c"},
        {"actor_id": "b", "actor_role": "buyer", "target_id": "a"}]), ntz(NOW))
    assert reasons(change) == {"0": "self_delete", "3": "not_found", "4": "forbidden"}
    assert rows_of(change.tables["users"], "user_id", "is_active") == [("a", True), ("b", False)]
    change = changes.soft_delete(t, "products", ask([
        {"actor_id": "s2", "actor_role": "seller", "target_id": "p"}, {"actor_id": "s1", "actor_role": "seller", "target_id": "p"}]), ntz(NOW))
    assert reasons(change) == {"0": "forbidden"}
    assert rows_of(change.tables["products"], "product_id", "is_active") == [("p", False)]


def test_listings(spark):
    t = tables(spark, categories=[{"category_id": 1, "name": "c"}])
    ask = {"actor_id": "s1", "actor_role": "seller", "product_name": "n", "price": 5}
    rows = [ask, {**ask, "price": 0}, {**ask, "category_id": 9}, {**ask, "category_id": 1, "stock": 4}, {**ask, "actor_role": "buyer"},
            {**ask, "stock": -1}, {**ask, "product_name": ""}]
    requests = [{"request_id": str(i), "request_ts": at(i), **r} for i, r in enumerate(rows)]
    change = changes.create_listings(t, "product", frame(spark, REQUEST_SCHEMAS["create_product"], requests))
    assert reasons(change) == {"1": "missing_field", "2": "constraint", "4": "forbidden", "5": "constraint", "6": "missing_field"}
    assert rows_of(change.tables["products"], "seller_id", "category_id", "stock", "is_active") == [("s1", 1, 4, True), ("s1", None, 0, True)]


def test_evolve_and_seed(spark):
    old = spark.createDataFrame([("k1", "5")], "key string, value string")
    assert rows_of(evolve_schema(old, "app_settings"), "key", "value", "updated_at") == [("k1", "5", None)]
    new = spark.createDataFrame([("k1", "6"), ("k2", "7"), ("k2", "7")], "key string, value string")
    assert rows_of(insert_if_absent(old, new, "key"), "key", "value") == [("k1", "5"), ("k2", "7")]
