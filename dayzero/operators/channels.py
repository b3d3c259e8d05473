"""Acquisition channels and the revenue of their users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayzero.constants import DEFAULT_CHANNEL
from dayzero.functions.dates import TimeLike, time_range, usable_minutes


def channel(default: str = DEFAULT_CHANNEL) -> Column:
    return F.coalesce("network_name", F.lit(default))


def attribute(
    registers: DataFrame,
    conversions: DataFrame,
    default: str = DEFAULT_CHANNEL,
    start: TimeLike | None = None,
    before: TimeLike | None = None,
    every_hour: bool = True,
) -> DataFrame:
    """Registered users and their channels, one row per user and channel; users
    without a conversion have the ``default`` channel.

    Sums over registrations joined to conversions count a user once per row of
    that join.  The number of rows is kept instead of the rows:
    ``registrations`` and ``clocks`` are the user's registration rows and their
    distinct hours and minutes, ``spellings`` the conversions that end up in
    the channel (two when both the default's name and NULL occur).
    ``every_hour`` is explained at ``usable_minutes``.
    """
    minute_of_day = F.hour("_i_t") * 60 + F.minute("_i_t")
    users = (
        registers.filter(
            F.col("nid").isNotNull()
            & usable_minutes("_i_t", every_hour=every_hour)
            & time_range("_i_t", start, before)
        )
        .groupBy("nid")
        .agg(
            F.count(F.lit(1)).alias("registrations"),
            F.count_distinct(minute_of_day).alias("clocks"),
        )
    )
    unnamed = F.col("network_name").isNull()
    channels = conversions.groupBy("nid", channel(default).alias("channel")).agg(
        (F.bool_or(unnamed).cast("int") + F.bool_or(~unnamed).cast("int")).alias(
            "spellings"
        )
    )
    return users.join(channels, "nid", "left").select(
        "nid",
        F.coalesce("channel", F.lit(default)).alias("network_name"),
        "registrations",
        "clocks",
        F.coalesce("spellings", F.lit(1)).alias("spellings"),
    )


def user_payments(user_days: DataFrame, in_window: Column | None = None) -> DataFrame:
    """Per user: all revenue, and revenue and presence inside the window."""
    inside = F.lit(True) if in_window is None else in_window
    return user_days.groupBy("nid").agg(
        F.sum("daily_revenue").alias("revenue"),
        F.sum(F.when(inside, F.col("daily_revenue"))).alias("window_revenue"),
        F.bool_or(F.coalesce(inside, F.lit(False))).alias("in_window"),
    )
