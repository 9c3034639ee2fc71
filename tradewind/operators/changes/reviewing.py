"""New reviews."""

from pyspark.sql import DataFrame, functions as F

from ... import schema
from ...functions.ordering import request_order
from ...plans.requests import Change, ChangeSet, first_reason, named_in, new_id, one_row_per_request, rejections, split
from ...plans.skew import look_up, merge_facts
from ..items import item_id
from ..reviews import delivered_lines


@one_row_per_request
def create_reviews(t, requests: DataFrame) -> Change:
    """Reviews of delivered lines by their buyer, one per buyer, order and item; the first request wins."""
    keys = ["actor_id", "order_id", "item_type", "item_id"]
    rating = F.col("rating")
    both = F.col("pet_id").isNotNull() & F.col("product_id").isNotNull()
    checked = requests.withColumn("item_id", item_id()).withColumn("_order", request_order()).withColumn(
        "reason", first_reason(
            (F.coalesce(F.col("actor_role") != "buyer", F.lit(True)), "forbidden"),
            (~F.coalesce(F.col("item_type").isin(schema.ITEM_TYPES), F.lit(False)), "bad_enum"),
            (rating.isNull() | (rating < 1) | (rating > 5), "out_of_range"),
            (F.col("order_id").isNull() | F.col("item_id").isNull(), "missing_field"),
            (both, "not_eligible"),
        ))
    sound, refused = checked.filter("reason is null"), checked.filter("reason is not null")
    # only the orders that are named in the batch are looked up
    named = {table: named_in(t[table], sound, "order_id") for table in ("orders", "order_items", "reviews")}
    eligible = delivered_lines(named).select(
        F.col("buyer_id").alias("actor_id"), "order_id", "item_type", item_id(), F.lit(True).alias("_eligible"))
    written = named["reviews"].select(
        F.col("reviewer_id").alias("actor_id"), "order_id", "item_type", item_id(), F.lit(True).alias("_written"))
    # a rating with a fraction would fail on insert, after the other checks
    whole = rating == F.floor(rating)
    firsts = sound.filter(whole).groupBy(*keys).agg(F.min("_order").alias("_first"))
    facts = merge_facts(keys, {"_eligible": eligible, "_written": written, "_first": firsts})
    judged = (
        look_up(sound, facts, keys, from_batch=True)
        .withColumn("reason", first_reason(
            (F.col("_eligible").isNull(), "not_eligible"),
            (F.col("_written") | (F.col("_order") > F.col("_first")), "duplicate"),
            (~whole, "constraint"),
        ))
    )
    accepted, late = split(judged)
    rows = accepted.select(
        new_id("review", "request_id").alias("review_id"), F.col("actor_id").alias("reviewer_id"), "order_id",
        "item_type", "pet_id", "product_id", rating.cast("smallint").alias("rating"),
        F.when(F.col("comment") != "", F.col("comment")).alias("comment"), F.col("request_ts").alias("created_at"),
    )
    reviews = t["reviews"].unionByName(rows, allowMissingColumns=True)
    return Change({"reviews": reviews}, rows, rejections(refused).unionByName(late), {"reviews": ChangeSet(rows)})
