"""State changes as batches: (tables, requests) -> (new tables, accepted, rejected with a reason)."""

from .carts import add_to_cart, edit_cart
from .checkout import checkout
from .listings import (ADMIN_USER_PATCH, PET_PATCH, PRODUCT_PATCH, PROFILE_PATCH, create_listings, patch_rows,
                       soft_delete)
from .registration import register_users
from .reviewing import create_reviews
from .settings import create_categories, upsert_settings
from .status import apply_payments, set_order_status

__all__ = [
    "add_to_cart", "edit_cart", "checkout", "create_listings", "patch_rows", "soft_delete", "register_users",
    "create_reviews", "create_categories", "upsert_settings", "apply_payments", "set_order_status",
    "ADMIN_USER_PATCH", "PET_PATCH", "PRODUCT_PATCH", "PROFILE_PATCH",
]
