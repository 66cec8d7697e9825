"""Column expressions: exact means, enumeration order, calendar, reasons, ids."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardbook.model import WEEKDAYS


def ratio(total: Column | str, count: Column | str, decimals: int = 2) -> Column:
    """``total / count`` rounded half away from zero, exact; NULL when count is 0.

    Takes integer totals, so that the aggregation itself runs on longs. The
    quotient keeps 18 decimals before it is rounded, which cannot turn a
    non-tie into a tie for any count below 10^15.
    """
    total, count = (F.col(c) if isinstance(c, str) else c for c in (total, count))
    divisor = F.when(count != 0, count.cast("decimal(20,0)"))
    return F.round(total.cast("decimal(20,0)") / divisor, decimals)


def in_order_of(column: str | Column, labels: Sequence[str]) -> Column:
    """Position of an enumeration label, for sorting; NULL when it is not one of them."""
    label = F.col(column) if isinstance(column, str) else column  # a string would be taken as a label
    return F.nullif(F.array_position(F.array(*map(F.lit, labels)), label), F.lit(0).cast("long"))


def weekday_label(day: str | Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(day) + 1)


def month_of(instant: str | Column) -> Column:
    return F.trunc(instant, "month")


def month_bounds(year: int, month: int) -> tuple[date, date]:
    """First day of the month and of the next one: a half-open range a scan can push down."""
    return date(year, month, 1), date(year + month // 12, month % 12 + 1, 1)


def blank(column: str) -> Column:
    """Missing for the purposes of a mandatory field: NULL or empty text."""
    return F.col(column).isNull() | (F.col(column).cast("string") == "")


def first_failure(reasons: Sequence[tuple[Column, str]]) -> Column:
    """The label of the first condition that holds, NULL when none does."""
    return F.coalesce(*(F.when(condition, F.lit(label)) for condition, label in reasons), F.lit(None).cast("string"))


def stable_id(*columns: str | Column) -> Column:
    """A surrogate id that is the same on every run: a digest of the natural key."""
    texts = (F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\x00")) for c in columns)
    return F.sha2(F.concat_ws("\x1f", *texts), 256)
