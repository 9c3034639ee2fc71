"""Sort orders. Each one ends in a key so that pages are repeatable."""

from pyspark.sql import Column, functions as F


def ntz(value: Column | str) -> Column:
    """A point in time given as text or as a column; all stored times are UTC without zone."""
    return (F.lit(value) if isinstance(value, str) else value).cast("timestamp_ntz")


def newest_first(key: str, time: str = "created_at") -> list[Column]:
    """Rows without a time come first, as DESC does in the source database."""
    return [F.col(time).desc_nulls_first(), F.col(key).asc()]


def request_order() -> Column:
    """Position of a request inside its batch, as one comparable value."""
    return F.struct("request_ts", "request_id")
