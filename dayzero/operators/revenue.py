"""Revenue by cohort age."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayzero.constants import (
    GRID_DEFAULT_CHANNEL,
    REVENUE_CHANNELS,
    REVENUE_HORIZON,
)
from dayzero.functions.dates import DateLike, date_range
from dayzero.operators.channels import channel
from dayzero.operators.grid import axis_grid, densify, running_total


def cumulative_revenue(
    user_days: DataFrame,
    horizon: int = REVENUE_HORIZON,
    channels: Sequence[str] = REVENUE_CHANNELS,
    default: str = GRID_DEFAULT_CHANNEL,
    min_reg: DateLike | None = None,
) -> DataFrame:
    """Running revenue per channel over days 1..horizon since registration, for
    every listed channel and day.

    The default name is filled in after summing, so a day on which it also
    occurs literally has two rows; they are added by size.  Only days and
    channels of the grid are read, so there are at most
    ``horizon * (len(channels) + 1)`` sums, however long the table is.
    """
    listed = F.col("network_name").isin(*channels)
    if default in channels:
        listed = listed | F.col("network_name").isNull()
    sums = (
        user_days.filter(
            F.col("date_diff_reg").between(1, horizon)
            & listed
            & date_range("reg_datekey", min_reg)
        )
        .groupBy("date_diff_reg", "network_name")
        .agg(F.sum("daily_revenue").alias("revenue"))
        .filter(F.col("revenue").isNotNull())
        .select("date_diff_reg", channel(default).alias("network_name"), "revenue")
    )
    cells = axis_grid(
        user_days.sparkSession,
        date_diff_reg=range(1, horizon + 1),
        network_name=channels,
    )
    filled = densify(cells, F.broadcast(sums), ["date_diff_reg", "network_name"])
    total = running_total("revenue", ["network_name"], ["date_diff_reg", "revenue"])
    return filled.select("date_diff_reg", "network_name", total.alias("daily_revenue"))
