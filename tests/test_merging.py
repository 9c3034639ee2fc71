"""Change sets merged into a snapshot, and the ledger of request ids."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fixtures import START, at, frame, tables
from test_request_ids import BUYER, CASES, DIRECT, NOW, world
from tradewind import schema
from tradewind.functions import ntz
from tradewind.operators import changes
from tradewind.plans.requests import ChangeSet
from tradewind.sources import RequestLedger, apply_once, commit, ledger as ledger_module, load_marketplace, merge_snapshot, snapshot, write_snapshot
from tradewind.sources.requests import REQUEST_SCHEMAS


def content(df, table):
    names = [f.name for f in schema.TABLES[table]]
    return sorted(map(str, df.select(*names).collect()))


def files(folder):
    return {str(p): hashlib.md5(p.read_bytes()).hexdigest() for p in Path(folder).rglob("*.parquet")}


@pytest.mark.parametrize("name", CASES)
def test_merged_change_sets_equal_the_new_tables(spark, tmp_path, name):
    run, kind, sound, _ = CASES[name]
    path = str(tmp_path / "s")
    write_snapshot(world(spark), path)
    loaded = load_marketplace(spark, path)
    change = run(loaded, frame(spark, REQUEST_SCHEMAS[kind], [{"request_id": "q1", "request_ts": at(1), **sound}]))
    want = {table: content(df, table) for table, df in change.tables.items()}
    before = {table: content(loaded[table], table) for table in schema.TABLES}
    assert set(change.sets) <= set(change.tables)
    merge_snapshot(spark, change.sets, path)
    after = load_marketplace(spark, path)
    assert {table: content(after[table], table) for table in schema.TABLES} == {**before, **want}
    assert before != {**before, **want}


def months(spark, tmp_path):
    orders = [{"order_id": f"o{m}{i}", "buyer_id": "b1", "created_at": START.replace(month=m)} for m in range(1, 7) for i in range(3)]
    orders.append({"order_id": "none", "buyer_id": "b1", "created_at": None})
    t = tables(spark, orders=orders, payments=[{"payment_id": f"p{o['order_id']}", "order_id": o["order_id"]} for o in orders],
               order_items=[{"order_item_id": f"l{o['order_id']}", "order_id": o["order_id"], "item_type": "pet", "pet_id": "p"} for o in orders])
    path = str(tmp_path / "s")
    write_snapshot(t, path)
    return path


def test_a_batch_about_one_month_leaves_the_files_of_the_others(spark, tmp_path):
    path = months(spark, tmp_path)
    before, t = files(path), load_marketplace(spark, path)
    rows = [{"request_id": f"q{i}", "request_ts": at(i), "payment_id": f"po2{i}", "status": "paid"} for i in range(2)]
    change = changes.apply_payments(t, frame(spark, REQUEST_SCHEMAS["payment"], rows), ntz(NOW))
    want = {name: content(df, name) for name, df in change.tables.items()}
    written = merge_snapshot(spark, change.sets, path)
    assert written == {name: [f"{path}/{name}/month=2024-02"] for name in ("payments", "orders")}
    after = files(path)
    assert {p: h for p, h in before.items() if "month=2024-02" not in p} == {p: h for p, h in after.items() if "month=2024-02" not in p}
    assert {p.split("/s/")[1].split("/")[0] for p in set(after) - set(before)} == {"payments", "orders"}
    again = load_marketplace(spark, path)
    assert {name: content(again[name], name) for name in want} == want
    # the same as a full rewrite
    full = str(tmp_path / "full")
    write_snapshot(again, full)
    assert {name: content(load_marketplace(spark, full)[name], name) for name in want} == want


def test_orders_of_no_month_and_new_months(spark, tmp_path):
    path = months(spark, tmp_path)
    rows = load_marketplace(spark, path)["orders"].filter("order_id = 'none'").withColumn("status", F.lit("shipped"))
    new = rows.withColumn("order_id", F.lit("later")).withColumn("created_at", ntz("2025-03-01 00:00:00"))
    paid = load_marketplace(spark, path)["payments"].filter("order_id = 'none'").withColumn("payment_id", F.lit("plater")).withColumn("order_id", F.lit("later"))
    sets = {"orders": ChangeSet(rows.unionByName(new)), "payments": ChangeSet(paid)}
    for _ in range(2):  # a merge that is run again changes nothing
        written = merge_snapshot(spark, sets, path, staging=str(tmp_path / "staged"))
        t = load_marketplace(spark, path)
        assert t["orders"].count() == 20 and t["payments"].count() == 20
        assert {r.order_id: r.status for r in t["orders"].filter("order_id in ('none', 'later')").collect()} == {"none": "shipped", "later": "shipped"}
        assert t["payments"].filter("month = '2025-03'").count() == 1
        assert written["payments"] == [f"{path}/payments/month=2025-03"]


def test_key_folders_and_emptied_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "ROWS_PER_PART", 5)
    t = tables(spark, cart=[{"cart_id": "k1", "buyer_id": "b1"}], cart_items=[
        {"item_id": f"i{n}", "cart_id": "k1", "item_type": "pet", "pet_id": "p1"} for n in range(23)])
    path = str(tmp_path / "s")
    write_snapshot({"cart": t["cart"], "cart_items": t["cart_items"]}, path)
    folders = {p.parent.name: p for p in (tmp_path / "s" / "cart_items").rglob("*.parquet")}
    assert len(folders) > 2 and all(name.endswith("-of-0005") for name in folders)
    one = spark.read.parquet(f"{path}/cart_items").groupBy("part").agg(F.collect_list("item_id").alias("ids")).orderBy(F.size("ids")).first()
    before = files(path)
    gone = spark.createDataFrame([(i,) for i in one.ids], "item_id string")
    assert merge_snapshot(spark, {"cart_items": ChangeSet(gone=gone)}, path) == {"cart_items": [f"{path}/cart_items/part={one.part}"]}
    after = files(path)
    assert after == {p: h for p, h in before.items() if one.part not in p}
    left = load_marketplace(spark, path, tables=["cart_items"])["cart_items"]
    assert left.columns == [f.name for f in schema.TABLES["cart_items"]] and left.count() == 23 - len(one.ids)
    assert merge_snapshot(spark, {"cart_items": ChangeSet(gone=gone), "cart": ChangeSet()}, path)["cart"] == []
    assert load_marketplace(spark, path, tables=["cart_items"])["cart_items"].count() == 23 - len(one.ids)


# --- ledger


def state(spark, path):
    t = load_marketplace(spark, path)
    return {table: content(t[table], table) for table in schema.TABLES}


@pytest.mark.parametrize("name", ["checkout", "add", "edit", "pet"])
def test_the_same_file_twice(spark, tmp_path, name):
    run, kind, sound, _ = CASES[name]
    path, book = str(tmp_path / "s"), RequestLedger(spark, str(tmp_path / "l"))
    write_snapshot(world(spark), path)
    rows = [{"request_id": "q1", "request_ts": at(1), **sound}, {"request_id": "q2", "request_ts": at(2)}]
    requests = frame(spark, REQUEST_SCHEMAS[kind], rows)
    operator = lambda t, requests: run(t, requests)
    first = apply_once(book, kind, operator, load_marketplace(spark, path), requests)
    commit(spark, path, book, kind, "one", requests, first)
    after = state(spark, path)
    second = apply_once(book, kind, operator, load_marketplace(spark, path), requests)
    assert sorted((r.request_id, r.reason) for r in second.rejected.collect()) == [("q1", "duplicate_request"), ("q2", "duplicate_request")]
    commit(spark, path, book, kind, "two", requests, second)
    assert state(spark, path) == after
    # another kind of request may use the same id
    assert book.known("other kind", requests) is None


def test_a_commit_that_was_lost_half_way_goes_on(spark, tmp_path, monkeypatch):
    """Stock is written, orders are not: run again, the batch sells each piece once and writes each order once."""
    path, book = str(tmp_path / "s"), RequestLedger(spark, str(tmp_path / "l"))
    write_snapshot(world(spark), path)
    requests = frame(spark, REQUEST_SCHEMAS["checkout"], [{"request_id": "q1", "request_ts": at(1), **BUYER, "shipping_address": "home", "items": DIRECT}])
    merge, lost = snapshot._merge, []

    def some(spark, table, *rest):
        if table == "orders" and not lost:
            lost.append(table)
            raise OSError("executor lost")
        return merge(spark, table, *rest)

    monkeypatch.setattr(snapshot, "_merge", some)
    for number in range(2):
        change = apply_once(book, "checkout", changes.checkout, load_marketplace(spark, path), requests, ntz(NOW))
        ordered = {table: change.sets[table] for table in ("pets", "orders", "order_items", "payments", "cart_items", "products")}
        change = change._replace(sets=ordered)
        if number == 0:
            with pytest.raises(OSError):
                commit(spark, path, book, "checkout", "b1", requests, change)
            assert book.segments() == []
        else:
            commit(spark, path, book, "checkout", "b1", requests, change)
    t = load_marketplace(spark, path)
    assert {r.pet_id: r.stock for r in t["pets"].collect()} == {"p1": 8}
    assert t["orders"].count() == 2 and t["order_items"].count() == 2 and t["cart_items"].count() == 0


def test_a_retried_direct_checkout_sells_once_even_without_a_ledger(spark):
    t = world(spark)
    rows = [{"request_id": "q1", "request_ts": at(1), **BUYER, "shipping_address": "home", "items": DIRECT}]
    make = lambda rows: frame(spark, REQUEST_SCHEMAS["checkout"], rows)
    first = changes.checkout(t, make(rows), ntz(NOW))
    later = {**t, **first.tables}
    second = changes.checkout(later, make([*rows, {**rows[0], "request_id": "q2", "request_ts": at(2)}]), ntz(NOW))
    assert [(r.request_id, r.reason) for r in second.rejected.collect()] == [("q1", "duplicate_request")]
    assert second.accepted.count() == 1
    assert second.tables["orders"].groupBy("order_id").count().filter("count > 1").count() == 0
    assert {r.pet_id: r.stock for r in second.tables["pets"].collect()} == {"p1": 7}


def test_segments_are_merged_and_a_full_filter_stays_exact(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger_module, "FANOUT", 3)
    monkeypatch.setattr(ledger_module, "ROWS_PER_BUCKET", 20)
    monkeypatch.setattr(ledger_module, "BITS_PER_ID", 1)  # nearly all bits set: the ids decide
    book = RequestLedger(spark, str(tmp_path / "l"))
    batch = lambda low, high: spark.range(low, high).select(F.concat(F.lit("q"), F.col("id")).alias("request_id"), F.lit(1).alias("x"))
    assert book.split("a", batch(0, 5))[1] is None
    for number in range(4):
        for _ in range(2):  # added again under its name: nothing new
            book.add("a", batch(number * 30, number * 30 + 30), f"b{number}")
    assert sorted(s.level for s in book.segments()) == [0, 1] and sum(s.n for s in book.segments()) == 120
    assert max(s.buckets for s in book.segments()) == 5
    asked = batch(100, 150).unionByName(spark.createDataFrame([(None, 1)], "request_id string, x int")).withColumn("request_ts", ntz(NOW))
    fresh, repeated = book.split("a", asked)
    assert sorted(str(r.request_id) for r in fresh.collect()) == sorted(["None", *[f"q{i}" for i in range(120, 150)]])
    assert {r.request_id for r in repeated.collect()} == {f"q{i}" for i in range(100, 120)}
    assert book.split("b", asked)[1] is None
    assert book.split("a", asked.limit(0))[0].count() == 0


def counted(spark, df):
    """The rows of a DataFrame, and a count of how often they are made."""
    made, rows = spark.sparkContext.accumulator(0), df.collect()

    def make(row):
        made.add(1)
        return row

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(make), df.schema), made


def test_snapshot_makes_rows_once(spark, tmp_path):
    t = tables(spark, cart_items=[{"item_id": f"i{i}", "cart_id": f"c{i % 3}", "item_type": "pet", "pet_id": "p"} for i in range(20)])
    lines, made = counted(spark, t["cart_items"])
    write_snapshot({"cart_items": lines}, str(tmp_path / "s"))
    assert made.value == 20
    loaded = load_marketplace(spark, str(tmp_path / "s"), tables=["cart_items"])["cart_items"]
    assert content(loaded, "cart_items") == content(t["cart_items"], "cart_items")


def test_cart_requests_are_judged_once(spark):
    t = tables(spark, pets=[{"pet_id": f"p{i}"} for i in range(6)], cart=[{"cart_id": "c1", "buyer_id": "b1"}],
               cart_items=[{"item_id": "i1", "cart_id": "c1", "item_type": "pet", "pet_id": "p1"}])
    t["pets"], made = counted(spark, t["pets"])
    asked = [{"request_id": f"q{i}", "request_ts": at(i), "actor_id": "b1", "actor_role": "buyer", "item_type": "pet",
              "pet_id": f"p{i}", "quantity": 1} for i in range(8)]
    change = changes.add_to_cart(t, frame(spark, REQUEST_SCHEMAS["add_to_cart"], asked))
    assert change.rejected.count() == 2 and change.accepted.count() == 6
    lines = {r.pet_id: r.quantity for r in change.sets["cart_items"].rows.collect()}
    assert lines == {"p0": 1, "p1": 2, "p2": 1, "p3": 1, "p4": 1, "p5": 1} and change.sets["cart"].rows.count() == 0
    assert made.value == 6
