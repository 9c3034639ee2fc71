from .money import MONEY, TOTAL, platform_fee, round_half_up, seller_share
from .ordering import newest_first, ntz, request_order
from .text import as_number, blank, contains, js_trim, valid_email

__all__ = [
    "MONEY", "TOTAL", "platform_fee", "round_half_up", "seller_share",
    "newest_first", "ntz", "request_order",
    "as_number", "blank", "contains", "js_trim", "valid_email",
]
