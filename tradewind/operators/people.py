"""Users, access rules and settings."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema
from ..functions import as_number, contains, newest_first
from ..functions.money import MONEY, PERCENT
from ..plans.paging import take_page

_LISTED = ["user_id", "name", "email", "phone", "role", "avatar_url", "is_active", "is_verified", "created_at"]
_PROFILE = ["user_id", "name", "email", "phone", "role", "avatar_url", "address", "city", "postal_code",
            "is_active", "created_at", "updated_at"]


@dataclass(frozen=True)
class UserFilters:
    role: str | None = None
    search: str | None = None
    is_active: bool = True


def list_users(t, filters: UserFilters = UserFilters(), page: int | None = 1, limit: int | None = None) -> DataFrame:
    """Users by role, active flag and name-or-email text, newest first, without the password column."""
    schema.require_allowed(filters.role or None, schema.ROLES, "role")
    rows = t["users"].filter(F.col("is_active") == F.lit(filters.is_active))
    if filters.role:
        rows = rows.filter(F.col("role") == filters.role)
    if filters.search:
        rows = rows.filter(contains("name", filters.search) | contains("email", filters.search))
    rows = rows.select(*_LISTED)
    return rows if page is None else take_page(rows, newest_first("user_id"), page, limit)


def user_profiles(t, ids=None) -> DataFrame:
    """Profile columns of all users, or of some; the password never leaves the table."""
    rows = t["users"] if ids is None else t["users"].filter(F.col("user_id").isin(list(ids)))
    return rows.select(*_PROFILE)


def may_sign_in() -> Column:
    return F.coalesce(
        F.col("is_active") & ((F.col("role") != "seller") | F.col("is_verified")), F.lit(False)
    )


def login_eligible_users(t) -> DataFrame:
    """Active users; sellers only once they are verified."""
    return t["users"].filter(may_sign_in()).select("user_id", "email", "role")


def effective_settings(t) -> DataFrame:
    """One row of settings. A key without a row has its default; a value without a leading number counts as 0."""
    rows = t["app_settings"]

    def value(key: str, dtype: str) -> Column:
        stored = F.max(F.when(F.col("key") == key, F.coalesce(as_number(F.col("value"), dtype), F.lit(0).cast(dtype))))
        return F.coalesce(stored, F.lit(schema.DEFAULT_SETTINGS[key]).cast(dtype)).cast(dtype).alias(key)

    return rows.agg(value("platform_fee_percent", PERCENT), value("shipping_cost", MONEY))


def setting(t, key: str) -> Column:
    """One setting as a scalar subquery, so that reports need no join for it."""
    return effective_settings(t).select(key).scalar()


def _unrestricted(viewers: DataFrame) -> DataFrame:
    return viewers.filter((F.col("role") != "buyer") & F.col("is_active"))


def visible_rows(df: DataFrame, viewers: DataFrame, owner: str) -> DataFrame:
    """Who sees which row, for many viewers at once.

    Active buyers see their own rows: scope 'own' with their viewer_id. Every other active viewer sees every
    row; that is stated once per row as scope 'all' without a viewer_id instead of once per row and viewer, so
    the result grows with the rows and not with rows x viewers. Inactive viewers see nothing.
    """
    buyers = viewers.filter((F.col("role") == "buyer") & F.col("is_active")).select(
        F.col("user_id").alias("viewer_id")
    )
    own = df.join(buyers, F.col(owner) == F.col("viewer_id")).withColumn("scope", F.lit("own"))
    anyone = _unrestricted(viewers).agg(F.count(F.lit(1)).alias("n")).select(F.col("n") > 0).scalar()
    shared = (
        df.filter(anyone)
        .withColumn("viewer_id", F.lit(None).cast(buyers.schema["viewer_id"].dataType))
        .withColumn("scope", F.lit("all"))
    )
    return own.unionByName(shared)


def visible_to(df: DataFrame, viewers: DataFrame, owner: str, viewer) -> DataFrame:
    """The rows one viewer sees."""
    rows = visible_rows(df, viewers.filter(F.col("user_id") == F.lit(viewer)), owner)
    return rows.drop("viewer_id", "scope")


def visible_counts(df: DataFrame, viewers: DataFrame, owner: str) -> DataFrame:
    """Number of visible rows per active viewer, from one count per owner and one overall count."""
    per_owner = df.groupBy(F.col(owner).alias("user_id")).agg(F.count(F.lit(1)).alias("own_rows"))
    every_row = df.agg(F.count(F.lit(1))).scalar()
    visible = F.when(F.col("role") == "buyer", F.coalesce("own_rows", F.lit(0))).otherwise(every_row)
    return (
        viewers.filter("is_active").join(per_owner, "user_id", "left")
        .select(F.col("user_id").alias("viewer_id"), "role", visible.cast("bigint").alias("visible_rows"))
    )
