"""One key with a third of the rows: results stay whole and the key's rows are split over tasks."""

import pytest
from pyspark.sql import functions as F

from fixtures import at, tables
from tradewind.functions import ntz
from tradewind.operators import changes, earnings
from tradewind.plans.sequence import ordered_blocks
from tradewind.plans.skew import look_up

N = 240_000
NOW = "2024-02-01 00:00:00"


@pytest.fixture
def small_partitions(spark):
    """Settings under which some KB (the rows compress well) count as a skewed partition."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_requests(spark):
    i = F.col("id")
    return spark.range(N, numPartitions=8).select(
        F.format_string("q%09d", "id").alias("request_id"), F.lit(at(0)).cast("timestamp_ntz").alias("request_ts"),
        F.lit("s1").alias("actor_id"), F.lit("seller").alias("actor_role"),
        F.when(i % 3 == 0, "p0").when(i % 3 == 1, F.concat(F.lit("p"), (i % 50).cast("string"))).alias("product_id"),
        (i + 1).cast("decimal(12,2)").alias("price"),
    )


def test_look_up_spreads_a_hot_key_and_missing_keys(spark, small_partitions):
    rows = spark.createDataFrame([(f"p{i}", f"owner{i}") for i in range(40)], "product_id string, owner string")
    requests = hot_requests(spark)
    plain, spread = look_up(requests, rows, ["product_id"]), look_up(requests, rows, ["product_id"], hot_rows=1000)
    assert spread.columns == plain.columns
    total = lambda df: df.agg(F.count("*"), F.count("owner"), F.sum(F.xxhash64("request_id", "owner") % 1000003)).first()
    assert total(spread) == total(plain)
    largest = lambda df: df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert largest(plain) >= N // 3
    assert largest(spread) < N // 6


def test_patches_of_one_hot_product(spark, small_partitions, monkeypatch):
    t = tables(spark, products=[{"product_id": f"p{i}", "price": 10} for i in range(50)])
    monkeypatch.setattr("tradewind.operators.changes.listings.look_up", lambda a, b, keys: look_up(a, b, keys, hot_rows=1000))
    change = changes.patch_rows(t, changes.PRODUCT_PATCH, hot_requests(spark), ntz(NOW))
    prices = {r["product_id"]: int(r["price"]) for r in change.tables["products"].collect()}
    named = lambda n: "p0" if n % 3 == 0 else f"p{n % 50}" if n % 3 == 1 else None
    last = {named(n): n + 1 for n in range(N)}
    assert prices == {k: v for k, v in last.items() if k}
    assert change.rejected.count() == sum(1 for n in range(N) if n % 3 == 2)


def test_hot_order_collapses_before_the_shuffle(spark):
    t = tables(spark, users=[{"user_id": "s0", "email": "e", "name": "n", "role": "seller"}],
               orders=[{"order_id": str(i), "buyer_id": "b", "status": "delivered"} for i in range(100)])
    i = F.col("id")
    t["order_items"] = spark.range(N, numPartitions=8).select(
        F.col("id").cast("string").alias("order_item_id"),
        F.when(i % 3 == 0, 0).otherwise(i % 100).cast("string").alias("order_id"), F.lit("pet").alias("item_type"),
        F.lit("p").alias("pet_id"), F.lit(None).cast("string").alias("product_id"),
        F.concat(F.lit("s"), (i % 7).cast("string")).alias("seller_id"), F.lit(1).alias("quantity"),
        F.lit(1).cast("decimal(12,2)").alias("unit_price"), F.lit(1).cast("decimal(12,2)").alias("subtotal"),
    )
    row = earnings.earnings_by_status(t).collect()[0]
    assert (row["order_count"], row["distinct_orders"], int(row["gross_subtotal"])) == (N, 100, N)
    assert earnings.seller_stats(t).collect()[0]["total_orders"] == 100
    sums = earnings._order_sums(t)
    sums.collect()
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert plan.index("keys=[order_id") < plan.index("Exchange") < plan.rindex("keys=[order_id")


def test_demands_of_one_item_are_spread_over_blocks(spark, small_partitions):
    requests = spark.range(N, numPartitions=8).select(
        F.format_string("q%09d", "id").alias("request_id"), F.lit(at(0)).cast("timestamp_ntz").alias("request_ts"))
    blocks = ordered_blocks(requests, [F.col("request_ts"), F.col("request_id")])
    sizes = [r["count"] for r in blocks.groupBy("block").count().collect()]
    assert sum(sizes) == N and len(sizes) > 8 and max(sizes) < N / 4


def test_hot_item_is_sold_exactly_out(spark):
    buyers = 3000
    t = tables(spark, pets=[{"pet_id": "hot", "stock": 700}, {"pet_id": "cold", "stock": 10_000}],
               app_settings=[{"key": "shipping_cost", "value": "1"}])
    ids = spark.range(buyers)
    name = F.format_string("b%05d", "id")
    t["cart"] = ids.select(name.alias("cart_id"), name.alias("buyer_id"))
    t["cart_items"] = ids.select(
        name.alias("item_id"), name.alias("cart_id"), F.lit("pet").alias("item_type"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("pet_id"), F.lit(None).cast("string").alias("product_id"),
        (1 + F.col("id") % 2).cast("int").alias("quantity"), F.lit(at(0)).cast("timestamp_ntz").alias("created_at"))
    requests = ids.select(
        name.alias("request_id"), F.lit(at(0)).cast("timestamp_ntz").alias("request_ts"), name.alias("actor_id"),
        F.lit("buyer").alias("actor_role"), F.lit("x").alias("shipping_address"))
    change = changes.checkout(t, requests, ntz(NOW))
    stock, want = 700, set()
    for n in range(buyers):
        quantity = 1 + n % 2
        if n % 3:
            want.add(f"b{n:05d}")
        elif quantity <= stock:
            stock -= quantity
            want.add(f"b{n:05d}")
    assert {r["buyer_id"] for r in change.accepted.collect()} == want
    left = {r["pet_id"]: r["stock"] for r in change.tables["pets"].collect()}
    assert left["hot"] == stock
