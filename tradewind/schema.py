"""Tables, allowed values, constraints and references of the marketplace."""

from typing import NamedTuple

# The states and kinds the data model allows.
ROLES = ["buyer", "seller", "admin"]
ORDER_STATUS = ["pending", "processing", "shipped", "delivered", "cancelled"]
SELLER_ORDER_STATUS = ["processing", "shipped", "delivered", "cancelled"]
ONGOING = ["pending", "processing", "shipped"]
PAYMENT_STATUS = ["unpaid", "paid", "failed", "refunded"]
PAYMENT_METHODS = ["transfer", "ewallet", "cod"]
GENDERS = ["Jantan", "Betina"]
ITEM_TYPES = ["pet", "product"]

# Settings that hold when a key has no row, and the basic categories.
DEFAULT_SETTINGS = {"platform_fee_percent": "10", "shipping_cost": "15000"}
BASE_CATEGORIES = ["Makanan", "Kandang", "Grooming", "Mainan", "Kesehatan", "Aksesoris"]

# One line per column: name, type, and what its declaration demands: ! is NOT NULL, len is the longest text,
# min and max bound a number, enum names an allowed list, default fills a missing value.
_TABLES = {
    "users": """
        user_id string !
        name string ! len=100
        email string ! len=150
        password string ! len=255
        phone string len=20
        role string ! enum=ROLES
        avatar_url string
        is_active boolean default=true
        is_verified boolean default=true
        address string
        city string len=100
        postal_code string len=10
        created_at timestamp_ntz
        updated_at timestamp_ntz
    """,
    "categories": """
        category_id int !
        name string ! len=100
        icon string len=10
        description string
        created_at timestamp_ntz
    """,
    "pets": """
        pet_id string !
        seller_id string !
        pet_name string ! len=150
        species string ! len=50
        breed string len=100
        age_month int min=0 default=0
        gender string ! enum=GENDERS
        price decimal(12,2) ! min=0
        stock int ! min=0 default=0
        image_url string
        description string
        is_active boolean default=true
        created_at timestamp_ntz
        updated_at timestamp_ntz
    """,
    "products": """
        product_id string !
        seller_id string !
        category_id int
        product_name string ! len=200
        description string
        price decimal(12,2) ! min=0
        stock int ! min=0 default=0
        image_url string
        is_active boolean default=true
        created_at timestamp_ntz
        updated_at timestamp_ntz
    """,
    "cart": """
        cart_id string !
        buyer_id string !
        created_at timestamp_ntz
        updated_at timestamp_ntz
    """,
    "cart_items": """
        item_id string !
        cart_id string !
        item_type string ! enum=ITEM_TYPES
        pet_id string
        product_id string
        quantity int ! min=1 default=1
        created_at timestamp_ntz
    """,
    "orders": """
        order_id string !
        buyer_id string !
        status string ! enum=ORDER_STATUS default=pending
        total_price decimal(12,2) ! min=0
        shipping_cost decimal(12,2) ! default=0
        platform_fee decimal(12,2) ! default=0
        seller_payout decimal(12,2) ! default=0
        shipping_address string !
        shipping_city string
        shipping_postal string len=20
        notes string
        created_at timestamp_ntz
        updated_at timestamp_ntz
    """,
    "order_items": """
        order_item_id string !
        order_id string !
        item_type string ! enum=ITEM_TYPES
        pet_id string
        product_id string
        seller_id string !
        quantity int ! min=1 default=1
        unit_price decimal(12,2) ! min=0
        subtotal decimal(12,2) ! default=0
    """,
    "payments": """
        payment_id string !
        order_id string !
        amount decimal(12,2) ! min=0
        method string ! enum=PAYMENT_METHODS default=transfer
        status string ! enum=PAYMENT_STATUS default=unpaid
        reference_no string len=100
        paid_at timestamp_ntz
        created_at timestamp_ntz
        updated_at timestamp_ntz
    """,
    "reviews": """
        review_id string !
        reviewer_id string !
        order_id string
        item_type string ! enum=ITEM_TYPES
        pet_id string
        product_id string
        rating smallint ! min=1 max=5
        comment string
        created_at timestamp_ntz
    """,
    "app_settings": """
        key string ! len=100
        value string !
        updated_at timestamp_ntz
    """,
}


class Field(NamedTuple):
    name: str
    type: str
    required: bool
    length: int | None
    minimum: int | None
    maximum: int | None
    allowed: list[str] | None
    default: str | None


def _field(line: str) -> Field:
    name, dtype, *marks = line.split()
    rules = dict(mark.split("=") for mark in marks if "=" in mark)
    number = lambda key: int(rules[key]) if key in rules else None
    return Field(name, dtype, "!" in marks, number("len"), number("min"), number("max"),
                 globals()[rules["enum"]] if "enum" in rules else None, rules.get("default"))


TABLES: dict[str, list[Field]] = {
    table: [_field(line) for line in text.strip().splitlines()] for table, text in _TABLES.items()
}

PRIMARY_KEY = {table: fields[0].name for table, fields in TABLES.items()}
UNIQUE = [("users", "email"), ("categories", "name"), ("cart", "buyer_id"), ("payments", "order_id")]

# Tables whose changed rows get a new updated_at.
TOUCHED = ["users", "pets", "products", "cart", "orders", "payments"]


# The largest amount that a money column takes, the largest quantity.
MAX_MONEY, MAX_INT = "9999999999.99", 2_147_483_647


class Reference(NamedTuple):
    table: str
    column: str
    parent: str
    on_delete: str  # cascade, set_null or restrict


REFERENCES = [
    Reference("pets", "seller_id", "users", "cascade"),
    Reference("products", "seller_id", "users", "cascade"),
    Reference("products", "category_id", "categories", "set_null"),
    Reference("cart", "buyer_id", "users", "cascade"),
    Reference("cart_items", "cart_id", "cart", "cascade"),
    Reference("cart_items", "pet_id", "pets", "cascade"),
    Reference("cart_items", "product_id", "products", "cascade"),
    Reference("orders", "buyer_id", "users", "restrict"),
    Reference("order_items", "order_id", "orders", "cascade"),
    Reference("order_items", "pet_id", "pets", "set_null"),
    Reference("order_items", "product_id", "products", "set_null"),
    Reference("order_items", "seller_id", "users", "restrict"),
    Reference("payments", "order_id", "orders", "cascade"),
    Reference("reviews", "reviewer_id", "users", "cascade"),
    Reference("reviews", "order_id", "orders", "set_null"),
    Reference("reviews", "pet_id", "pets", "cascade"),
    Reference("reviews", "product_id", "products", "cascade"),
]


def ddl(table: str) -> str:
    """Schema text of a table, as readers take it."""
    return ", ".join(f"{f.name} {f.type}{' NOT NULL' if f.required else ''}" for f in TABLES[table])


def require_allowed(value: str | None, allowed: list[str], what: str) -> None:
    """Unknown enum values are an error, as they are in the source database."""
    if value is not None and value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}; got {value!r}")
