"""Paging, numbering and nesting helpers, and the shape of the physical plans."""

import random

import pytest
from pyspark.sql import functions as F

import workload.batches  # noqa: F401
import workload.reports  # noqa: F401
from fixtures import rows_of, tables
from tradewind.functions import newest_first
from tradewind.operators import orders
from tradewind.plans.paging import page_of, page_per_key, take_page
from tradewind.plans.sequence import dense_sequence
from workload.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
                                                  .fromString("formatted"))


@pytest.mark.parametrize("asked, given", [
    ((None, None), (1, 12)), ((0, 0), (1, 12)), ((-3, -1), (1, 1)), ((2, 500), (2, 100)), ((7, 30), (7, 30))])
def test_page_is_clamped(asked, given):
    assert tuple(page_of(*asked)) == given


def numbered(spark, n=500):
    rng = random.Random(1)
    rows = [(f"k{rng.choice('aaaaabc')}", f"{i:04d}", rng.randint(0, 40)) for i in range(n)]
    return spark.createDataFrame(rows, "owner string, id string, minute int").withColumn(
        "created_at", F.when(F.col("minute") > 0, F.timestamp_seconds(F.col("minute") * 60).cast("timestamp_ntz")))


def test_pages_cover_the_list_and_deep_pages_agree(spark):
    df, order = numbered(spark), newest_first("id")
    whole = [r["id"] for r in df.orderBy(*order).collect()]
    pages = [[r["id"] for r in take_page(df, order, p, 100).collect()] for p in range(1, 7)]
    assert sum(pages, []) == whole and pages[5] == []
    assert [r["id"] for r in take_page(df, order, 3, 100, deep_page=10).collect()] == pages[2]


def test_numbers_are_dense_and_ordered(spark):
    df = numbered(spark).repartition(7)
    got = [(r["id"], r["n"]) for r in dense_sequence(df, [F.col("id")], "n").orderBy("n").collect()]
    assert got == [(f"{i:04d}", i + 1) for i in range(500)]


def test_page_per_key_with_and_without_salting(spark):
    df, order = numbered(spark), newest_first("id")
    plain = page_per_key(df, "owner", order, 3, 20)
    salted = page_per_key(df, "owner", order, 3, 20, pruned_rank=5)
    assert rows_of(plain, "owner", "id") == rows_of(salted, "owner", "id")
    assert plain.groupBy("owner").count().agg(F.max("count")).collect()[0][0] == 20


def test_hot_key_is_pruned_before_the_shuffle(spark):
    text = plan(page_per_key(numbered(spark), "owner", newest_first("id"), 2, 20))
    assert text.count("WindowGroupLimit") >= 2


def test_large_orders_are_one_row(spark):
    lines = [{"order_item_id": str(i), "order_id": "big", "item_type": "pet", "pet_id": "p", "subtotal": 1} for i in range(100)]
    lines += [{"order_item_id": f"s{i}", "order_id": "small", "item_type": "pet", "pet_id": "p", "subtotal": 2} for i in range(3)]
    t = tables(spark, users=[{"user_id": "b", "email": "e", "name": "n"}], order_items=lines,
               orders=[{"order_id": "big", "buyer_id": "b"}, {"order_id": "small", "buyer_id": "b"}])
    for rows in (orders.buyer_orders(t).collect(), orders.order_detail(t).collect()):
        found = {r["order_id"]: r for r in rows}
        assert len(rows) == 2
        assert [(found[o]["item_count"], found[o]["items_total"]) for o in ("big", "small")] == [(100, 100), (3, 6)]
        assert sorted(i["order_item_id"] for i in found["big"]["items"]) == sorted(str(i) for i in range(100))
    assert orders.order_lines(t).count() == 103 and orders.order_lines(t, ["big"]).count() == 100


LAZY = sorted(
    {name for name in QUERIES if not name.startswith("checkout") or name == "checkout_quote"}
    - {"load_marketplace", "write_snapshot", "load_requests", "payments_stream", "payments_stream_rejected",
       "create_categories", "create_categories_rejected", "propagate_delete", "propagate_delete_orders"})


@pytest.mark.parametrize("name", LAZY)
def test_no_product_joins_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_reports_read_only_the_columns_they_need(spark):
    text = plan(QUERIES["earnings_by_status"](spark, SF_DIR))
    schemas = [line for line in text.splitlines() if "ReadSchema" in line]
    assert any("l_orderkey" in s and "l_extendedprice" in s and "l_shipdate" not in s and "l_partkey" not in s for s in schemas)
    monthly = plan(QUERIES["earnings_monthly"](spark, SF_DIR))
    assert any("PushedFilters" in line and "o_orderdate" in line for line in monthly.splitlines())


def test_months_prune_lines_of_a_snapshot(spark, tmp_path):
    from tradewind.operators import earnings
    from tradewind.sources import load_marketplace, write_snapshot

    t = tables(spark, users=[{"user_id": "b", "email": "e"}], orders=[{"order_id": "o", "buyer_id": "b", "status": "delivered"}],
               order_items=[{"order_item_id": "i", "order_id": "o", "item_type": "pet"}], payments=[{"payment_id": "p", "order_id": "o"}])
    write_snapshot(t, str(tmp_path / "s"))
    loaded = load_marketplace(spark, str(tmp_path / "s"))
    text = plan(earnings.earnings_monthly(loaded, "2024-02-01 00:00:00"))
    assert sum("PartitionFilters" in line and "month" in line for line in text.splitlines()) >= 2
    assert [tuple(r)[:2] for r in earnings.earnings_monthly(loaded, "2024-02-01 00:00:00").collect()] == [("2024-01", 1)]


def test_only_wanted_lines_are_summed(spark):
    text = plan(QUERIES["earnings_monthly"](spark, SF_DIR))
    # the order's date filters its lines before they are added up
    assert text.index("LeftSemi") > 0 and "o_orderdate" in text


@pytest.mark.parametrize("name", ["edit_cart", "set_order_status", "patch_rows"])
def test_a_batch_is_run_once(spark, name):
    jobs = lambda group: len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("reading", "")
    from workload.star import marketplace

    marketplace(spark, SF_DIR)
    spark.sparkContext.setJobGroup(f"building-{name}", "")
    QUERIES[name](spark, SF_DIR)
    spark.sparkContext.setJobGroup("", "")
    assert jobs(f"building-{name}") <= 12  # among them one per table for its schema


def test_lines_are_not_shuffled_for_the_names_of_few_sellers(spark, monkeypatch):
    t = tables(
        spark, users=[{"user_id": "b1", "name": "B"}, {"user_id": "s1", "name": "S"}], pets=[{"pet_id": "p1"}],
        orders=[{"order_id": "o1", "buyer_id": "b1"}],
        order_items=[{"order_item_id": f"l{i}", "order_id": "o1", "item_type": "pet", "pet_id": "p1", "seller_id": seller} for i, seller in enumerate(["s1", "s2", None])])
    monkeypatch.setitem(orders.__dict__, "NEAR_SELLERS", 0)
    shuffled = sorted(map(str, orders.order_lines(t).collect()))
    monkeypatch.undo()
    near = orders.order_lines(t)
    assert sorted(map(str, near.collect())) == shuffled and "'S'" in str(shuffled)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(orders.order_lines(t))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in text


def test_pages_of_all_buyers_nest_lines_where_the_join_left_them(spark):
    text = plan(QUERIES["buyer_orders"](spark, SF_DIR))
    assert "REPARTITION_BY_COL" not in text
