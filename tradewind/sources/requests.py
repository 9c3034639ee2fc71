"""Request batches for the change operators, as JSON lines."""

from pyspark.sql import DataFrame, SparkSession, functions as F

_COMMON = "request_id string, request_ts timestamp_ntz, actor_id string, actor_role string, "
_BAD = "_malformed"

# Fields a request of each kind may carry.
REQUEST_SCHEMAS = {
    "register": _COMMON + "name string, email string, password string, password_hash string, phone string, role string",
    "create_pet": _COMMON + "pet_name string, species string, breed string, age_month int, gender string, "
                            "price decimal(12,2), stock int, image_url string, description string",
    "create_product": _COMMON + "product_name string, category_id int, description string, price decimal(12,2), "
                                "stock int, image_url string",
    "patch_pet": _COMMON + "pet_id string, pet_name string, species string, breed string, age_month int, "
                           "gender string, price decimal(12,2), stock int, image_url string, description string, "
                           "is_active boolean",
    "patch_product": _COMMON + "product_id string, product_name string, category_id int, description string, "
                               "price decimal(12,2), stock int, image_url string, is_active boolean",
    "patch_user": _COMMON + "user_id string, role string, is_active boolean, is_verified boolean",
    "patch_profile": _COMMON + "user_id string, name string, phone string, avatar_url string, address string, "
                               "city string, postal_code string",
    "delete": _COMMON + "target_id string",
    "add_to_cart": _COMMON + "item_type string, pet_id string, product_id string, quantity int",
    "edit_cart": _COMMON + "op string, item_id string, quantity int",
    "checkout": _COMMON + "shipping_address string, shipping_city string, shipping_postal string, notes string, "
                          "payment_method string, "
                          "items array<struct<item_type:string,pet_id:string,product_id:string,quantity:int>>",
    "order_status": _COMMON + "order_id string, status string",
    "payment": _COMMON + "payment_id string, status string, reference_no string",
    "review": _COMMON + "item_type string, pet_id string, product_id string, order_id string, "
                        "rating decimal(6,2), comment string",
    "settings": _COMMON + "platform_fee_percent string, shipping_cost string",
    "category": _COMMON + "name string, icon string, description string",
}


def parse_requests(lines: DataFrame, kind: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(ok, bad) of JSON text lines. A line that is not JSON, has a field of the wrong type, or has no
    request_id or request_ts is bad and is kept as text."""
    declared = REQUEST_SCHEMAS[kind]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    parsed = lines.select(
        F.col(column).alias("line"),
        F.from_json(column, f"{declared}, {_BAD} string", options).alias("request"),
    )
    usable = (
        F.col(f"request.{_BAD}").isNull()
        & F.col("request.request_id").isNotNull()
        & F.col("request.request_ts").isNotNull()
    )
    ok = parsed.filter(F.coalesce(usable, F.lit(False))).select("request.*").drop(_BAD)
    bad = parsed.filter(~F.coalesce(usable, F.lit(False))).select("line")
    return ok, bad


def load_requests(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    return parse_requests(spark.read.text(path), kind)
