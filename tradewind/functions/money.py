"""Money expressions. Everything stays in decimals: sums of cents must not drift."""

from decimal import Decimal

from pyspark.sql import Column, functions as F

MONEY = "decimal(12,2)"   # a stored amount
TOTAL = "decimal(22,2)"   # a sum of stored amounts; what Spark's sum() gives for MONEY
PERCENT = "decimal(9,4)"

_HALF = Decimal("0.5")
_CENT = Decimal("0.01")


def round_half_up(value: Column) -> Column:
    """Whole units, halves towards +infinity (2.5 -> 3, -2.5 -> -2)."""
    return F.floor(value + F.lit(_HALF))


def platform_fee(amount: Column, percent: Column) -> Column:
    return round_half_up(amount.cast(TOTAL) * percent.cast(PERCENT) * F.lit(_CENT)).cast(TOTAL)


def seller_share(amount: Column, percent: Column) -> Column:
    """What is left for the seller after the fee, rounded once on the remaining share."""
    kept = (F.lit(Decimal(100)) - percent.cast(PERCENT)).cast(PERCENT)
    return round_half_up(amount.cast(TOTAL) * kept * F.lit(_CENT)).cast(TOTAL)


def total_of(amount: Column | str) -> Column:
    """Sum with 0 for no rows."""
    return F.coalesce(F.sum(amount).cast(TOTAL), F.lit(0).cast(TOTAL))
