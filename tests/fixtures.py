"""Small hand-made tables."""

import datetime as dt
from decimal import Decimal

from tradewind import schema
from tradewind.sources.evolve import evolve_schema

START = dt.datetime(2024, 1, 1)

BASE = {
    "users": {"password": "h", "role": "buyer", "is_active": True, "is_verified": True, "created_at": START},
    "categories": {"created_at": START},
    "pets": {"pet_name": "cat", "species": "cat", "gender": "Jantan", "price": 10, "stock": 5, "is_active": True,
             "seller_id": "s1", "created_at": START, "updated_at": START},
    "products": {"product_name": "bowl", "price": 10, "stock": 5, "is_active": True, "seller_id": "s1",
                 "created_at": START, "updated_at": START},
    "cart": {"created_at": START},
    "cart_items": {"quantity": 1, "created_at": START},
    "orders": {"status": "pending", "total_price": 100, "shipping_cost": 15, "platform_fee": 8, "seller_payout": 77,
               "shipping_address": "x", "created_at": START, "updated_at": START},
    "order_items": {"seller_id": "s1", "quantity": 1, "unit_price": 10, "subtotal": 10},
    "payments": {"amount": 100, "method": "transfer", "status": "unpaid", "created_at": START, "updated_at": START},
    "reviews": {"rating": 5, "created_at": START},
    "app_settings": {},
}


def frame(spark, columns: str, rows: list[dict]):
    """DataFrame with the given DDL from dicts; missing keys are NULL."""
    names = [c.strip().split(" ")[0] for c in split_ddl(columns)]
    decimals = {c.strip().split(" ")[0] for c in split_ddl(columns) if "decimal" in c and "<" not in c}

    def value(row, name):
        v = row.get(name)
        return Decimal(str(v)) if name in decimals and v is not None else v

    return spark.createDataFrame([tuple(value(row, n) for n in names) for row in rows], columns)


def split_ddl(columns: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for ch in columns:
        depth += ch in "(<"
        depth -= ch in ")>"
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return [p for p in [*parts, current] if p.strip()]


def tables(spark, **rows: list[dict]):
    """All marketplace tables; rows fill in the defaults above."""
    made = {}
    for table in schema.TABLES:
        filled = [{**BASE[table], **row} for row in rows.get(table, [])]
        made[table] = evolve_schema(frame(spark, schema.ddl(table).replace(" NOT NULL", ""), filled), table)
    return made


def at(minute: float) -> dt.datetime:
    return START + dt.timedelta(minutes=minute)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
