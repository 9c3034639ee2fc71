"""New accounts."""

from pyspark.sql import DataFrame, functions as F

from ...functions import blank, js_trim, valid_email
from ...functions.ordering import request_order
from ...plans.requests import Change, ChangeSet, first_reason, named_in, new_id, one_row_per_request, rejections, split
from ...plans.skew import look_up, merge_facts

MIN_PASSWORD = 6


@one_row_per_request
def register_users(t, requests: DataFrame) -> Change:
    """Adds users, and a cart for each new buyer.

    Roles other than buyer and seller become buyer; sellers start unverified. The first valid request of an
    e-mail wins, later ones and those of existing users are duplicates. The caller hashes passwords: password
    is only checked for its length, password_hash is what is stored.
    """
    too_long = (
        (F.char_length(js_trim(F.col("name"))) > 100) | (F.char_length("email") > 150) | (F.char_length("phone") > 20)
    )
    checked = requests.withColumn("reason", first_reason(
        (blank("name") | blank("email") | blank("password"), "missing_field"),
        (F.char_length("password") < MIN_PASSWORD, "password_too_short"),
        (~valid_email(F.col("email")), "bad_email"),
    )).withColumn("login", F.lower("email")).withColumn("_order", request_order())
    sound, refused = checked.filter("reason is null"), checked.filter("reason is not null")
    storable = sound.withColumn("oversized", F.coalesce(too_long, F.lit(False)))
    # the first storable request per e-mail; min() combines map-side, so a much repeated e-mail is no hot spot
    winners = storable.filter(~F.col("oversized")).groupBy("login").agg(F.min("_order").alias("_first"))
    taken = named_in(t["users"].select(F.col("email").alias("login")), storable, "login")
    facts = merge_facts(["login"], {"known": taken.withColumn("known", F.lit(True)), "_first": winners})
    judged = (
        look_up(storable, facts, ["login"], from_batch=True)
        .withColumn("reason", first_reason(
            (F.col("known") | (F.col("_order") > F.col("_first")), "duplicate"),
            (F.col("oversized"), "constraint"),
        ))
    )
    accepted, duplicates = split(judged)
    role = F.when(F.col("role") == "seller", "seller").otherwise("buyer")
    users = accepted.select(
        new_id("user", "request_id").alias("user_id"),
        js_trim(F.col("name")).alias("name"),
        F.col("login").alias("email"),
        F.col("password_hash").alias("password"),
        F.when(~blank("phone"), F.col("phone")).alias("phone"),
        role.alias("role"),
        F.lit(True).alias("is_active"),
        (role != "seller").alias("is_verified"),
        F.col("request_ts").alias("created_at"),
        F.col("request_ts").alias("updated_at"),
    )
    carts = users.filter(F.col("role") == "buyer").select(
        new_id("cart", "user_id").alias("cart_id"), F.col("user_id").alias("buyer_id"), "created_at", "updated_at"
    )
    tables = {
        "users": t["users"].unionByName(users, allowMissingColumns=True),
        "cart": t["cart"].unionByName(carts, allowMissingColumns=True),
    }
    sets = {"users": ChangeSet(users), "cart": ChangeSet(carts)}
    return Change(tables, users, rejections(refused).unionByName(duplicates), sets)
