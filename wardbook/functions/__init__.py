"""Column helpers shared by the operators."""

from wardbook.functions.columns import (
    blank,
    first_failure,
    in_order_of,
    month_bounds,
    month_of,
    ratio,
    stable_id,
    weekday_label,
)
from wardbook.functions.frames import distinct_keys, named, splittable

__all__ = [
    "blank", "distinct_keys", "first_failure", "in_order_of", "month_bounds", "month_of",
    "named", "ratio", "splittable", "stable_id", "weekday_label",
]
