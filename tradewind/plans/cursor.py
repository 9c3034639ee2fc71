"""Pages that go on from the last row of the page before, by a bound on the order instead of a number of rows to skip."""

import base64
import datetime as dt
import json
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, functions as F

from .paging import page_of


class By(NamedTuple):
    """One column of an order. Missing values come where the lists have them: first when falling, last when rising."""

    column: str
    descending: bool = False
    nulls_first: bool | None = None

    @property
    def missing_first(self) -> bool:
        return self.descending if self.nulls_first is None else self.nulls_first

    def sort(self) -> Column:
        name = F.col(self.column)
        if self.descending:
            return name.desc_nulls_first() if self.missing_first else name.desc_nulls_last()
        return name.asc_nulls_first() if self.missing_first else name.asc_nulls_last()


def newest(key: str) -> list[By]:
    """Newest first, missing times before all, ties by key: the order of most lists."""
    return [By("created_at", descending=True), By(key)]


def page_after(df: DataFrame, order: list[By], cursor: str | None = None, limit: int | None = None) -> DataFrame:
    """The rows that follow the cursor in the order, `limit` (1..100, default 12) at most; without a cursor the first ones.

    The last column of the order must be a key without missing values. What lies before the cursor is excluded by a range
    on the first column, which the file reader gets as a filter, and by the rest of the order among its ties. The cost of
    a page is thus that of the rows behind its start, and its top-k holds `limit` rows however far down the list it is.
    Rows that are added or removed before the cursor do not shift later pages.
    """
    rows = df if cursor is None else df.filter(_after(order, _values(cursor)))
    return rows.orderBy(*[by.sort() for by in order]).limit(page_of(limit=limit).limit)


def cursor_of(row: Row, order: list[By]) -> str:
    """The cursor that goes on after a row: its values in the order, as text that keeps their types."""
    values = [_plain(row[by.column]) for by in order]
    return base64.urlsafe_b64encode(json.dumps(values).encode()).decode()


def _after(order: list[By], values: list) -> Column:
    """Rows strictly behind the values, as one condition per column: equal before it, behind in it."""
    first, *_ = order
    behind = _no_earlier(first, values[0])
    same: Column = F.lit(True)
    strictly: Column = F.lit(False)
    for by, value in zip(order, values):
        strictly = strictly | (same & _behind(by, value))
        same = same & (F.col(by.column).isNull() if value is None else F.coalesce(F.col(by.column) == F.lit(value), F.lit(False)))
    return strictly if behind is None else behind & strictly


def _behind(by: By, value) -> Column:
    name = F.col(by.column)
    if value is None:  # behind the missing values are all others, or nothing
        return name.isNotNull() if by.missing_first else F.lit(False)
    later = name < F.lit(value) if by.descending else name > F.lit(value)
    return F.coalesce(later, F.lit(False)) if by.missing_first else name.isNull() | F.coalesce(later, F.lit(False))


def _no_earlier(by: By, value) -> Column | None:
    """A bound that a file reader understands: implied by the exact condition, and free of anything but the column."""
    name = F.col(by.column)
    if value is None:
        return None if by.missing_first else name.isNull()
    bound = name <= F.lit(value) if by.descending else name >= F.lit(value)
    return bound if by.missing_first else bound | name.isNull()


def _plain(value):
    if isinstance(value, dt.datetime):
        return {"time": value.isoformat()}
    if isinstance(value, dt.date):
        return {"date": value.isoformat()}
    return {"number": str(value)} if isinstance(value, Decimal) else value


def _values(cursor: str) -> list:
    kinds = {"time": dt.datetime.fromisoformat, "date": dt.date.fromisoformat, "number": Decimal}
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        return [kinds[next(iter(v))](next(iter(v.values()))) if isinstance(v, dict) else v for v in found]
    except (ValueError, KeyError) as bad:
        raise ValueError(f"no cursor of a page: {cursor!r}") from bad
