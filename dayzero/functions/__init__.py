"""Column expressions.  All are built-in Spark functions, no Python UDFs."""

from dayzero.functions.dates import (
    as_date,
    as_timestamp,
    date_range,
    days_after,
    days_between,
    epoch_to_date,
    minutes_between,
    next_midnight,
    time_range,
    usable_minutes,
    week_of_year,
)
from dayzero.functions.labels import bucketize, minutes_label, stage_label
from dayzero.functions.text import nested_split

__all__ = [
    "as_date",
    "as_timestamp",
    "bucketize",
    "date_range",
    "days_after",
    "days_between",
    "epoch_to_date",
    "minutes_between",
    "minutes_label",
    "nested_split",
    "next_midnight",
    "stage_label",
    "time_range",
    "usable_minutes",
    "week_of_year",
]
