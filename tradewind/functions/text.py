"""Text expressions used by filters and request checks."""

from pyspark.sql import Column, functions as F

# The characters a JavaScript trim() removes and \s matches.
JS_WHITESPACE = (
    "\t\n\u000b\u000c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

EMAIL_PATTERN = rf"\A[^{JS_WHITESPACE}@]+@[^{JS_WHITESPACE}@]+\.[^{JS_WHITESPACE}@]+\z"
NUMBER_PREFIX = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def contains(column: Column | str, needle: str) -> Column:
    """Case-insensitive 'contains'. % and _ in the needle stay wildcards."""
    return (F.col(column) if isinstance(column, str) else column).ilike(f"%{needle}%")


def js_trim(column: Column) -> Column:
    return F.btrim(column, F.lit(JS_WHITESPACE))


def blank(column: Column | str) -> Column:
    """Missing or empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return column.isNull() | (column == "")


def valid_email(column: Column) -> Column:
    return column.rlike(EMAIL_PATTERN)


def as_number(column: Column, dtype: str) -> Column:
    """Leading number of a text ('12abc' -> 12); NULL when there is none."""
    return F.regexp_extract(column, NUMBER_PREFIX, 1).try_cast(dtype)
