"""Settings and categories."""

from pyspark.sql import Column, DataFrame, functions as F

from ...functions import as_number, blank, js_trim
from ...functions.ordering import request_order
from ...plans.requests import Change, ChangeSet, first_reason, last, one_row_per_request, rejections, split
from ...plans.sequence import dense_sequence
from ...plans.skew import look_up, merge_facts

_NUMBER = "decimal(30,10)"


def _plain(number: Column) -> Column:
    """Number as text without trailing zeros: 12.50 -> 12.5, 12.00 -> 12."""
    return F.regexp_replace(number.cast("string"), r"\.?0+$", "")


@one_row_per_request
def upsert_settings(t, requests: DataFrame) -> Change:
    """Fee percent 0..100 and shipping cost >= 0. The fee is written before the shipping cost is looked at, so a
    request with a bad shipping cost still changes the fee. The last value of a key holds."""
    fee, shipping = (as_number(F.col(c), _NUMBER) for c in ("platform_fee_percent", "shipping_cost"))
    good_fee = F.col("platform_fee_percent").isNull() | F.coalesce(fee.between(0, 100), F.lit(False))
    good_shipping = F.col("shipping_cost").isNull() | F.coalesce(shipping >= 0, F.lit(False))
    judged = requests.withColumn("reason", first_reason(
        (F.coalesce(F.col("actor_role") != "admin", F.lit(True)), "forbidden"),
        (~(good_fee & good_shipping), "out_of_range"),
    ))
    accepted, rejected = split(judged)
    may_write = F.coalesce(F.col("actor_role") == "admin", F.lit(False)) & good_fee
    writes = requests.filter(may_write).select(
        "request_id", "request_ts", F.inline(F.array(
            F.struct(F.lit("platform_fee_percent").alias("key"), _plain(fee).alias("new_value")),
            F.struct(F.lit("shipping_cost").alias("key"),
                     F.when(good_shipping, _plain(shipping)).alias("new_value")),
        )),
    ).filter(F.col("new_value").isNotNull())
    latest = writes.groupBy("key").agg(last("new_value").alias("new_value"), F.max("request_ts").alias("new_time"))
    merged = t["app_settings"].join(latest, "key", "full_outer").select(
        "key", F.coalesce("new_value", "value").alias("value"),
        F.coalesce("new_time", "updated_at").alias("updated_at"),
    )
    written = merged.join(latest.select("key"), "key", "left_semi")
    return Change({"app_settings": merged}, accepted, rejected, {"app_settings": ChangeSet(written)})


@one_row_per_request
def create_categories(t, requests: DataFrame) -> Change:
    """New categories with the next ids; names are trimmed and unique, the first request of a name wins."""
    label = js_trim(F.col("name"))
    checked = requests.withColumn("label", label).withColumn("_order", request_order()).withColumn(
        "reason", first_reason(
            (F.coalesce(F.col("actor_role") != "admin", F.lit(True)), "forbidden"),
            (blank("name"), "missing_field"),
            (F.coalesce((F.char_length("label") > 100) | (F.char_length("icon") > 10), F.lit(False)), "constraint"),
        ))
    sound, refused = checked.filter("reason is null"), checked.filter("reason is not null")
    known = t["categories"].select(F.col("name").alias("label"), F.lit(True).alias("_known"))
    firsts = sound.groupBy("label").agg(F.min("_order").alias("_first"))
    judged = (
        look_up(sound, merge_facts(["label"], {"_known": known, "_first": firsts}), ["label"])
        .withColumn("reason", first_reason((F.col("_known") | (F.col("_order") > F.col("_first")), "duplicate")))
    )
    accepted, late = split(judged)
    numbered = dense_sequence(accepted.drop("_first", "_known"), [F.col("_order")], "_number")
    highest = t["categories"].agg(F.coalesce(F.max("category_id"), F.lit(0))).scalar()
    rows = numbered.select(
        (highest + F.col("_number")).cast("int").alias("category_id"), F.col("label").alias("name"),
        F.when(~blank("icon"), F.col("icon")).alias("icon"),
        F.when(~blank("description"), F.col("description")).alias("description"),
        F.col("request_ts").alias("created_at"),
    )
    categories = t["categories"].unionByName(rows, allowMissingColumns=True)
    return Change({"categories": categories}, rows, rejections(refused).unionByName(late), {"categories": ChangeSet(rows)})
