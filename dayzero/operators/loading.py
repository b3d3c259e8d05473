"""Loading times found in the login rows of the money log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayzero.constants import (
    ENGAGEMENT_EDGES,
    ENGAGEMENT_ELSE,
    ENGAGEMENT_LABELS,
    LOADING_EDGES,
    LOADING_ELSE,
    LOADING_LABELS,
    LOGIN_REASONS,
    NO_PAYLOAD,
    UNREADABLE,
)
from dayzero.functions.dates import TimeLike, time_range, usable_minutes
from dayzero.functions.labels import bucketize
from dayzero.functions.text import nested_split


def loading_time(payload: str = "add_rsn", strict: bool = False) -> Column:
    """Second comma field, up to its first semicolon, divided by 1000."""
    return nested_split(payload, [(",", 1), (";", 0)], "long", strict) / 1000


def engagement_bucket(value: Column) -> Column:
    return bucketize(value, ENGAGEMENT_EDGES, ENGAGEMENT_LABELS, ENGAGEMENT_ELSE)


def loading_bucket(value: Column) -> Column:
    return bucketize(value, LOADING_EDGES, LOADING_LABELS, LOADING_ELSE)


def login_loading(
    money_log: DataFrame,
    before: TimeLike | None = None,
    reasons: Sequence[str] = LOGIN_REASONS,
    strict: bool = False,
    every_hour: bool = True,
) -> DataFrame:
    """Distinct (user, day, loading-time bucket) of the login rows: at most one
    row per bucket for a user's day, combined before the shuffle.  Unreadable
    times have a bucket of their own, or raise when ``strict``."""
    logins = money_log.filter(
        F.col("rsn").isin(*reasons)
        & (F.col("add_rsn") != NO_PAYLOAD)
        & usable_minutes("_i_t", every_hour=every_hour)
        & time_range("_i_t", None, before)
    )
    # A column of its own, so that the text is split once and not per bucket.
    times = logins.select(
        "nid",
        F.to_date("_i_t").alias("reg_datekey"),
        loading_time(strict=strict).alias("loading_time"),
    )
    bucket = F.when(F.col("loading_time").isNull(), F.lit(UNREADABLE)).otherwise(
        engagement_bucket(F.col("loading_time"))
    )
    return times.select(
        "nid", "reg_datekey", bucket.alias("avg_loading_time")
    ).distinct()
