"""How far and how long users play."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dayzero.constants import LATE_ENTRY_DAYS, LOGIN_REASONS, STAGE_CAP
from dayzero.functions import (
    date_range,
    days_after,
    days_between,
    stage_label,
    time_range,
    usable_minutes,
)
from dayzero.functions.dates import DateLike, TimeLike
from dayzero.operators import (
    consecutive_day_counts,
    day0_cohort,
    likely_members,
    login_loading,
    none_if_zero,
    transition_matrix,
    two_day_matrix,
)
from dayzero.operators.cohorts import in_cohort
from dayzero.operators.engagement import day_counts
from dayzero.sources.tables import Tables


def two_days_played(tables: Tables, reg_to: DateLike = "2019-10-01") -> DataFrame:
    """Day-0 players by distinct stages of day 0 and day 1."""
    players = day0_cohort(tables.f_max_campaign, "played", reg_to=reg_to)
    counts = day_counts(tables.f_pve_campaign_result, reg_to)
    return two_day_matrix(counts.join(players, "nid", "left_semi"))


def two_days_not_entered(tables: Tables, reg_to: DateLike = "2019-10-01") -> DataFrame:
    """The same for users who did not enter, by first and second play."""
    idle = day0_cohort(tables.f_max_campaign, "strict", reg_to=reg_to)
    return two_day_matrix(
        consecutive_day_counts(tables.f_pve_campaign_result, idle, reg_to)
    )


def stage_transitions_played(
    tables: Tables, reg_to: DateLike = "2019-10-01", cap: int = STAGE_CAP
) -> DataFrame:
    """Day-0 players by their lowest and second lowest progress row."""
    return transition_matrix(
        tables.f_max_campaign.filter(date_range("reg_datekey", None, reg_to)),
        n=1,
        member=in_cohort("played"),
        label=lambda stage: stage_label(stage, cap),
    )


def stage_transitions_not_entered(
    tables: Tables,
    reg_to: DateLike = "2019-10-01",
    cap: int = STAGE_CAP,
    every_hour: bool = True,
) -> DataFrame:
    """Users without a tutorial by second and third lowest progress row, where
    each row counts once per registration of the user."""
    stages = (
        tables.f_max_campaign.filter(date_range("reg_datekey", None, reg_to))
        .groupBy("nid", "id_campaign")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.bool_or(in_cohort("loose")).alias("member"),
        )
    )
    registrations = (
        tables.common_register.filter(usable_minutes("_i_t", every_hour=every_hour))
        .groupBy("nid")
        .agg(F.count(F.lit(1)).alias("registrations"))
    )
    repeated = stages.join(registrations, "nid").withColumn(
        "copies", F.col("rows") * F.col("registrations")
    )
    return transition_matrix(
        repeated,
        n=2,
        copies="copies",
        member=F.col("member"),
        label=lambda stage: stage_label(stage, cap),
    )


def loading_time_engagement(
    tables: Tables,
    reg_from: DateLike = "2019-08-26",
    reg_to: DateLike = "2019-10-01",
    before: TimeLike = "2019-10-02",
    late_days: int = LATE_ENTRY_DAYS,
    reasons: Sequence[str] = LOGIN_REASONS,
    strict: bool = False,
    every_hour: bool = True,
    member_bits: int | None = None,
) -> DataFrame:
    """Users by registration day and loading time of that day, in four groups:
    played and advanced on day 1, played and did not advance, did not enter but
    played within ``late_days``, did not enter.

    Only days and loading times of users who advanced are listed.  Each table
    is read once: all four groups are flags of one user row.  ``member_bits``
    reads the progress once more, to drop the logins of users who registered
    outside the window before they are folded.
    """
    groups = _engagement_groups(tables.f_max_campaign, reg_from, reg_to, late_days)
    # Only logins of a registration day can match.
    in_window = time_range("_i_t", reg_from, days_after(reg_to, 1))
    money_log = tables.common_gamemoney.filter(in_window)
    if member_bits is not None:
        registered = tables.f_max_campaign.filter(date_range("reg_datekey", reg_from, reg_to))
        money_log = likely_members(money_log, registered, "nid", member_bits)
    loading = login_loading(money_log, before, reasons, strict, every_hour)
    counts = (
        loading.join(groups, ["nid", "reg_datekey"])
        .groupBy("reg_datekey", "avg_loading_time")
        .agg(
            F.count_if("late_enter").alias("late_enter_UU"),
            F.count_if("advanced").alias("enter_2dayUU"),
            none_if_zero(F.count_if("stayed")).alias("enter_not_2_dayUU"),
            F.count_if("not_entered").alias("not_enter_UU"),
        )
    )
    return counts.filter(F.col("enter_2dayUU") > 0).orderBy(
        "reg_datekey", "avg_loading_time"
    )


def _engagement_groups(
    progress: DataFrame, reg_from: DateLike, reg_to: DateLike, late_days: int
) -> DataFrame:
    """The four groups as flags per user and registration day.

    "Some stage of day 1 is above the one of day 0" holds for the highest stage
    of day 1 if it holds for any, and "not above" for the lowest.  Day 1 is
    looked up by user alone, over all their registration days.
    """
    offset = days_between("reg_datekey", "datekey")
    stage = F.col("id_campaign")
    played = in_cohort("played")
    in_time = offset <= late_days
    next_day = (offset == 1) & (stage > 0)
    longest = max(late_days, 1)
    users = (
        progress.filter(date_range("reg_datekey", reg_from, reg_to))
        .filter(offset <= longest)
        .filter(date_range("datekey", None, days_after(reg_to, longest)))
        .groupBy("nid", "reg_datekey")
        .agg(
            F.bool_or(in_cohort("strict")).alias("idle"),
            F.bool_or(in_time & (stage > 0)).alias("played_in_time"),
            F.bool_or(in_time & (stage == 0)).alias("idle_in_time"),
            F.min(F.when(played, stage)).alias("day0_low"),
            F.max(F.when(played, stage)).alias("day0_high"),
            F.min(F.when(next_day, stage)).alias("day1_low"),
            F.max(F.when(next_day, stage)).alias("day1_high"),
        )
    )
    user = W.partitionBy("nid")
    return users.select(
        "nid",
        "reg_datekey",
        (F.col("idle") & F.col("played_in_time")).alias("late_enter"),
        (F.col("idle") & F.col("idle_in_time")).alias("not_entered"),
        (F.col("day0_low") < F.max("day1_high").over(user)).alias("advanced"),
        (F.col("day0_high") >= F.min("day1_low").over(user)).alias("stayed"),
    )
