"""Pages by key bound: from the first to the last page they give the whole list."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tradewind.plans.cursor import By, cursor_of, newest, page_after


def listing(spark, n=97):
    dice = random.Random(n)
    rows = [(f"k{i:03d}", dice.choice([None, *[dt.datetime(2024, 1, d) for d in range(1, 6)]]),
             dice.choice([None, Decimal("1.50"), Decimal("2.00"), Decimal("10.25")]), dice.choice(["en", None])) for i in range(n)]
    return spark.createDataFrame(rows, "key string, created_at timestamp_ntz, price decimal(12,2), lang string").repartition(3).cache()


def walk(df, order, limit):
    cursor, pages = None, []
    while rows := page_after(df, order, cursor, limit).collect():
        assert len(rows) <= limit
        pages += rows
        cursor = cursor_of(rows[-1], order)
    return [r.key for r in pages]


@pytest.mark.parametrize("order, limit", [
    (newest("key"), 10),
    ([By("price"), By("key")], 33),
    ([By("price", descending=True, nulls_first=False), By("created_at", nulls_first=True), By("key", descending=True)], 40),
    ([By("lang"), By("price", descending=True), By("key")], 50),
])
def test_cursors_give_the_whole_list(spark, order, limit):
    df = listing(spark)
    assert walk(df, order, limit) == [r.key for r in df.orderBy(*[by.sort() for by in order]).collect()]


def test_rows_added_before_the_cursor_shift_nothing(spark):
    df, order = listing(spark), newest("key")
    first = page_after(df, order, None, 20).collect()
    cursor = cursor_of(first[-1], order)
    more = df.unionByName(df.limit(5).withColumn("key", F.concat(F.lit("a"), "key")).withColumn("created_at", F.lit(None).cast("timestamp_ntz")))
    assert page_after(more, order, cursor, 20).collect() == page_after(df, order, cursor, 20).collect()


def test_the_bound_reaches_the_file_reader(spark, tmp_path):
    path = str(tmp_path / "list")
    listing(spark).repartitionByRange(4, "created_at").write.parquet(path)
    df, order = spark.read.parquet(path), newest("key")
    deep = cursor_of(df.filter("created_at is not null").orderBy("created_at").first(), order)
    plan = page_after(df, order, deep)._jdf.queryExecution().executedPlan().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line).split("PushedFilters")[1]
    assert "LessThanOrEqual(created_at,2024-01-01" in pushed
    assert "TakeOrderedAndProject(limit=12" in plan


def test_odd_cursors(spark):
    df = listing(spark)
    for bad in ("", "nonsense", "e30", "W3sib3RoZXIiOiAxfV0="):
        with pytest.raises(ValueError):
            page_after(df, newest("key"), bad)
    assert page_after(df.limit(0), newest("key")).count() == 0
    last = df.orderBy(*[by.sort() for by in newest("key")]).collect()[-1]
    assert page_after(df, newest("key"), cursor_of(last, newest("key"))).count() == 0
    assert page_after(df, newest("key"), None, 1_000).count() == 97 and page_after(df, newest("key"), None, 0).count() == 12
