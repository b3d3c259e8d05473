"""Acquisition channels: who plays, who pays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayzero.constants import (
    DEFAULT_CHANNEL,
    GRID_DEFAULT_CHANNEL,
    RECENT_REVENUE_HORIZON,
    REVENUE_CHANNELS,
    REVENUE_HORIZON,
)
from dayzero.functions import date_range, week_of_year
from dayzero.functions.dates import DateLike, TimeLike
from dayzero.operators import (
    attribute,
    cohort_members,
    cumulative_revenue,
    day0_cohort,
    distinct_counts,
    distinct_fold,
    join_metrics,
    none_if_zero,
    number_users,
    user_payments,
)
from dayzero.operators.channels import channel
from dayzero.sources.tables import Tables


def _is_new() -> Column:
    return F.col("nru") == 1


def _with_ratio(counts: DataFrame) -> DataFrame:
    everyone = F.col("play_UU") + F.col("not_play_UU")
    return counts.select(
        "network_name",
        "not_play_UU",
        "play_UU",
        (F.col("not_play_UU") / everyone).alias("ratio"),
    )


def _all_channels(tables: Tables, default: str) -> DataFrame:
    return tables.f_user_map.select(channel(default).alias("network_name")).distinct()


def channel_ratio_window(
    tables: Tables,
    reg_from: DateLike = "2019-08-26",
    reg_to: DateLike = "2019-10-09",
    default: str = DEFAULT_CHANNEL,
) -> DataFrame:
    """Share of users who did not enter, per channel of the registration row,
    for registrations inside the window.

    The channel list and both counts come from one pass over each table.
    """
    members = cohort_members(tables.f_max_campaign, ["strict", "played"], reg_from, reg_to)
    users = (
        tables.f_user_map.filter(date_range("reg_datekey", reg_from, reg_to))
        .groupBy("nid", channel(default).alias("network_name"))
        .agg(F.bool_or(_is_new()).alias("is_new"))
    )
    counts = (
        users.join(members, "nid", "left")
        .groupBy("network_name")
        .agg(
            none_if_zero(F.count_if(F.col("is_new") & (F.col("strict") > 0))).alias(
                "not_play_UU"
            ),
            none_if_zero(F.count_if(F.col("is_new") & (F.col("played") > 0))).alias(
                "play_UU"
            ),
        )
    )
    return _with_ratio(counts)


def channel_ratio(
    tables: Tables, default: str = DEFAULT_CHANNEL, every_hour: bool = True
) -> DataFrame:
    """The same over all dates, with channels from the conversions."""
    members = cohort_members(tables.f_max_campaign, ["strict", "played"])
    channels = attribute(
        tables.common_register, tables.adjust_conversion, default, every_hour=every_hour
    )
    counts = (
        channels.join(members, "nid")
        .groupBy("network_name")
        .agg(
            none_if_zero(F.count_if(F.col("strict") > 0)).alias("not_play_UU"),
            none_if_zero(F.count_if(F.col("played") > 0)).alias("play_UU"),
        )
    )
    spine = _all_channels(tables, default)
    return _with_ratio(join_metrics(spine, [(counts, ["network_name"])]))


def channel_revenue_window(
    tables: Tables,
    first: DateLike = "2019-08-26",
    last: DateLike = "2019-10-09",
    before: TimeLike = "2019-10-10",
    default: str = DEFAULT_CHANNEL,
    every_hour: bool = True,
) -> DataFrame:
    """Revenue per user by channel for registrations inside the window, users
    who did not enter against players.  Only the former are limited to revenue
    of the window."""
    inside = date_range("reg_datekey", first, last) & date_range("datekey", first, last)
    channels = attribute(
        tables.common_register,
        tables.adjust_conversion,
        default,
        first,
        before,
        every_hour,
    )
    return _revenue_per_user(
        _all_channels(tables, default),
        user_payments(tables.f_user_map, inside),
        channels.withColumn("idle_rows", F.col("registrations")),
        cohort_members(tables.f_max_campaign, ["strict", "played"], first, last),
    )


def channel_revenue(
    tables: Tables, default: str = DEFAULT_CHANNEL, every_hour: bool = True
) -> DataFrame:
    """The same over all dates."""
    channels = attribute(
        tables.common_register, tables.adjust_conversion, default, every_hour=every_hour
    )
    return _revenue_per_user(
        _all_channels(tables, default),
        user_payments(tables.f_user_map),
        channels.withColumn("idle_rows", F.col("registrations") * F.col("spellings")),
        cohort_members(tables.f_max_campaign, ["strict", "played"]),
    )


def _revenue_per_user(
    listed: DataFrame, payments: DataFrame, channels: DataFrame, members: DataFrame
) -> DataFrame:
    """Revenue counts once per joined row, users count once.

    Players are joined per progress row and per distinct registration clock,
    users who did not enter per ``idle_rows``.

    The channels to list are those of the user table, the revenue belongs to
    the attributed channel, so the list is a scan of its own that reads one
    column.  Payments are one row per user and attributions one row per user
    and channel, so no pairs of channels are formed.
    """
    users = channels.join(members, "nid").join(payments, "nid")
    idle = (F.col("strict") > 0) & F.col("in_window")
    player = F.col("played") > 0
    idle_revenue = F.col("window_revenue") * F.col("idle_rows")
    player_revenue = F.col("revenue") * F.col("clocks") * F.col("played")
    by_channel = users.groupBy("network_name").agg(
        (F.sum(F.when(idle, idle_revenue)) / none_if_zero(F.count_if(idle))).alias(
            "not_play_revenue"
        ),
        (F.sum(F.when(player, player_revenue)) / none_if_zero(F.count_if(player))).alias(
            "play_revenue"
        ),
    )
    return join_metrics(listed, [(by_channel, ["network_name"])])


def weekly_not_entered(tables: Tables) -> DataFrame:
    """Per Sunday week and channel: registered users, and those without a
    tutorial that day.  Users without a channel form a group of their own."""
    users = (
        _new_users(tables)
        .groupBy(week_of_year("reg_datekey").alias("week"), "network_name", "nid")
        .agg(F.bool_or("idle").alias("idle"))
    )
    return (
        users.groupBy(F.col("week").alias("reg_datekey"), "network_name")
        .agg(
            F.count("nid").alias("reg_UU"),
            F.count_if("idle").alias("not_play_UU"),
        )
        .orderBy("reg_datekey", "network_name")
    )


def _new_users(tables: Tables) -> DataFrame:
    """Registrations by day and channel, with those without a tutorial that day."""
    new = (
        tables.f_user_map.filter(_is_new())
        .select("reg_datekey", "nid", "network_name")
        .distinct()
    )
    idle = day0_cohort(
        tables.f_max_campaign, "loose", keys=["reg_datekey", "nid"]
    ).withColumn("idle", F.lit(True))
    return new.join(idle, ["reg_datekey", "nid"], "left")


def not_entered_fold(tables: Tables) -> DataFrame:
    """Bitmaps of the registered and of the idle users per day and channel, to be
    stored once and counted by any longer period (``not_entered_by``)."""
    users = _new_users(tables)
    numbers = number_users(users, order="reg_datekey")
    idle = F.coalesce("idle", F.lit(False))
    return distinct_fold(users, numbers, ["reg_datekey", "network_name"], among={"idle": idle})


def not_entered_by(fold: DataFrame, period: Column) -> DataFrame:
    """``weekly_not_entered`` for a period that is worked out of ``reg_datekey``,
    from a stored fold alone."""
    groups = [period.alias("reg_datekey"), "network_name"]
    counts = distinct_counts(fold, groups, reg_UU="users", not_play_UU="idle")
    return counts.orderBy("reg_datekey", "network_name")


def revenue_by_age(
    tables: Tables,
    horizon: int = REVENUE_HORIZON,
    channels: Sequence[str] = REVENUE_CHANNELS,
    default: str = GRID_DEFAULT_CHANNEL,
    min_reg: DateLike | None = None,
) -> DataFrame:
    """Running revenue per channel and day since registration."""
    return cumulative_revenue(tables.f_user_map, horizon, channels, default, min_reg)


def recent_revenue_by_age(
    tables: Tables,
    min_reg: DateLike = "2019-09-01",
    horizon: int = RECENT_REVENUE_HORIZON,
    channels: Sequence[str] = REVENUE_CHANNELS,
    default: str = GRID_DEFAULT_CHANNEL,
) -> DataFrame:
    """The same for registrations from ``min_reg`` on."""
    return revenue_by_age(tables, horizon, channels, default, min_reg)
