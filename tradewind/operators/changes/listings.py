"""New, changed and withdrawn pets and products; changed and deactivated users."""

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ... import schema
from ...functions import blank
from ...plans.requests import Change, ChangeSet, first_reason, last_given, new_id, one_row_per_request, split, touch
from ...plans.skew import look_up
from ..items import KINDS


def breaks_rules(table: str, columns: list[str]) -> Column:
    """A given value that its column would not take: too long, too small, too large."""
    bad = []
    for field in schema.TABLES[table]:
        if field.name in columns:
            column = F.col(field.name)
            if field.length is not None:
                bad.append(F.char_length(column) > field.length)
            if field.minimum is not None:
                bad.append(column < field.minimum)
    return F.coalesce(reduce(or_, [F.coalesce(b, F.lit(False)) for b in bad], F.lit(False)), F.lit(False))


def _unknown_category(requests: DataFrame, t) -> DataFrame:
    """Adds unknown_category: a category is named that does not exist."""
    if "category_id" not in requests.columns:
        return requests.withColumn("unknown_category", F.lit(False))
    known = t["categories"].select("category_id", F.lit(True).alias("_known"))
    missing = F.col("category_id").isNotNull() & (F.col("category_id") != 0) & F.col("_known").isNull()
    # categories are few: reducing them to the named ones first would only cost a pass over the batch
    return look_up(requests, known, ["category_id"], from_batch=True).withColumn("unknown_category", missing).drop("_known")


@one_row_per_request
def create_listings(t, kind: str, requests: DataFrame) -> Change:
    """New pets or products of the acting seller, with defaults for age and stock."""
    table, key, name = KINDS[kind]
    # zero counts as missing for the price, as an empty value does
    missing = [blank(name), F.col("price").isNull() | (F.col("price") == 0)]
    bad_enum = F.lit(False)
    if kind == "pet":
        missing += [blank("species"), blank("gender")]
        bad_enum = ~F.col("gender").isin(schema.GENDERS)
    columns = [f.name for f in schema.TABLES[table] if f.name in requests.columns]
    judged = _unknown_category(requests, t).withColumn("reason", first_reason(
        (F.coalesce(F.col("actor_role") != "seller", F.lit(True)), "forbidden"),
        (reduce(or_, missing), "missing_field"),
        (bad_enum, "bad_enum"),
        (breaks_rules(table, columns) | F.col("unknown_category"), "constraint"),
    )).drop("unknown_category")
    accepted, rejected = split(judged)
    values = {c: F.when(~blank(c), F.col(c)) for c in ("breed", "image_url", "description") if c in columns}
    values |= {c: F.coalesce(c, F.lit(0)) for c in ("age_month", "stock") if c in columns}
    if "category_id" in columns:
        values["category_id"] = F.when(F.col("category_id") != 0, F.col("category_id"))
    rows = accepted.withColumns(values).withColumns({
        key: new_id(kind, "request_id"),
        "seller_id": F.col("actor_id"),
        "is_active": F.lit(True),
        "created_at": F.col("request_ts"),
        "updated_at": F.col("request_ts"),
    }).drop("request_id", "request_ts", "actor_id", "actor_role")
    return Change({table: t[table].unionByName(rows, allowMissingColumns=True)}, rows, rejected, {table: ChangeSet(rows)})


class Patch(NamedTuple):
    """Which columns a patch may set. falsy columns keep the old value for NULL, '' and 0; null columns only for
    NULL, so that FALSE and '' are taken."""

    table: str
    falsy_keeps: list[str]
    null_keeps: list[str]
    owner: str | None = None        # column that must hold the actor, unless an admin acts
    admin_only: bool = False        # neither: users change their own row


PET_PATCH = Patch("pets", ["pet_name", "species", "breed", "age_month", "gender", "price", "stock", "image_url",
                           "description"], ["is_active"], owner="seller_id")
PRODUCT_PATCH = Patch("products", ["product_name", "category_id", "description", "price", "stock", "image_url"],
                      ["is_active"], owner="seller_id")
ADMIN_USER_PATCH = Patch("users", ["role"], ["is_active", "is_verified"], admin_only=True)
PROFILE_PATCH = Patch("users", ["name", "phone", "avatar_url"], ["address", "city", "postal_code"])


def _access_checks(owned: bool, admin_only: bool, key: str) -> list[tuple[Column, str]]:
    """Checks of the actor against the row, in the order in which they are answered."""
    role = F.coalesce("actor_role", F.lit(""))
    missing = F.col("_key").isNull()
    if owned:
        other = (role == "seller") & ~F.coalesce(F.col("_owner") == F.col("actor_id"), F.lit(False))
        return [(~role.isin("seller", "admin"), "forbidden"), (missing, "not_found"), (other, "forbidden")]
    if admin_only:
        return [(role != "admin", "forbidden"), (missing, "not_found")]
    return [(~F.coalesce(F.col(key) == F.col("actor_id"), F.lit(False)), "forbidden"), (missing, "not_found")]


def _is_falsy(df: DataFrame, column: str) -> Column:
    numeric = df.schema[column].dataType.typeName() not in ("string", "boolean")
    return F.col(column) == (F.lit(0) if numeric else F.lit(""))


@one_row_per_request
def patch_rows(t, patch: Patch, requests: DataFrame, as_of: Column) -> Change:
    """Partial updates. Of several accepted patches of a row, each column takes its last given value."""
    table, key = patch.table, schema.PRIMARY_KEY[patch.table]
    columns = [c for c in patch.falsy_keeps + patch.null_keeps if c in requests.columns]
    given = requests.withColumns({
        c: F.when(~F.coalesce(_is_falsy(requests, c), F.lit(True)), F.col(c)) for c in patch.falsy_keeps if c in columns
    })
    bad_enum = [
        ~F.col(f.name).isin(f.allowed) for f in schema.TABLES[table] if f.allowed is not None and f.name in columns
    ]
    owner = F.col(patch.owner).alias("_owner") if patch.owner else F.lit(None).cast("string").alias("_owner")
    rows = t[table].select(F.col(key), F.col(key).alias("_key"), owner)
    checks = _access_checks(patch.owner is not None, patch.admin_only, key)
    enum_check = (reduce(or_, bad_enum, F.lit(False)), "bad_enum")
    # an unknown role is refused before the user is looked up, an unknown gender after the pet was found
    checks = [checks[0], enum_check, *checks[1:]] if patch.admin_only else [*checks, enum_check]
    judged = look_up(_unknown_category(given, t), rows, [key]).withColumn("reason", first_reason(
        *checks,
        (breaks_rules(table, columns) | F.col("unknown_category"), "constraint"),
    )).drop("_key", "_owner", "unknown_category")
    accepted, rejected = split(judged)
    folded = accepted.groupBy(key).agg(
        *[last_given(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_changed")
    )
    merged = t[table].join(folded, key, "left").withColumns({
        c: F.coalesce(F.col(f"_new_{c}").cast(t[table].schema[c].dataType), F.col(c)) for c in columns
    })
    merged = touch(merged, F.col("_changed"), as_of)
    written = merged.filter(F.col("_changed").isNotNull()).select(*t[table].columns)
    return Change({table: merged.select(*t[table].columns)}, accepted, rejected, {table: ChangeSet(written)})


@one_row_per_request
def soft_delete(t, table: str, requests: DataFrame, as_of: Column) -> Change:
    """Deactivates pets, products (owner or admin) or users (admin, not oneself). Requests carry target_id."""
    key = schema.PRIMARY_KEY[table]
    of_users = table == "users"
    checks = _access_checks(not of_users, of_users, key)
    if of_users:
        checks.insert(1, (F.col("target_id") == F.col("actor_id"), "self_delete"))
    owner = F.lit(None).cast("string").alias("_owner") if of_users else F.col("seller_id").alias("_owner")
    rows = t[table].select(F.col(key).alias("target_id"), F.col(key).alias("_key"), owner)
    judged = look_up(requests, rows, ["target_id"]).withColumn("reason", first_reason(*checks))
    accepted, rejected = split(judged.drop("_key", "_owner"))
    gone = accepted.select(F.col("target_id").alias(key)).distinct().withColumn("_gone", F.lit(True))
    merged = t[table].join(gone, key, "left")
    merged = touch(merged, F.col("_gone"), as_of).withColumn(
        "is_active", F.when(F.col("_gone"), F.lit(False)).otherwise(F.col("is_active"))
    )
    written = merged.filter(F.col("_gone").isNotNull()).select(*t[table].columns)
    return Change({table: merged.select(*t[table].columns)}, accepted, rejected, {table: ChangeSet(written)})
