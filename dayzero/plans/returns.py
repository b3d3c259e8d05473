"""Whether users who did not enter on day 0 come back."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dayzero.constants import (
    CAPPED_STAGE_ENTERED,
    RETURN_DEPTH_DAYS,
    RETURN_HORIZON,
    STAGE_CAP,
)
from dayzero.functions.dates import DateLike, date_range
from dayzero.operators import (
    cohort_returns,
    return_curve,
    return_depth,
    return_stats,
    state_users,
)
from dayzero.sources.tables import Tables


def return_curve_report(
    tables: Tables, reg_to: DateLike = "2019-10-01", horizon: int = RETURN_HORIZON
) -> DataFrame:
    """First returns by day since registration, with their running total.
    Returns after the horizon are not read: they are in no row of the curve."""
    users = cohort_returns(tables.f_max_campaign, "strict", reg_to, horizon)
    return return_curve(users, horizon)


def return_stats_report(tables: Tables, reg_to: DateLike = "2019-10-09") -> DataFrame:
    """Mean and longest wait until the first return."""
    return return_stats(cohort_returns(tables.f_max_campaign, "strict", reg_to))


def return_depth_report(
    tables: Tables,
    reg_to: DateLike = "2019-10-09",
    max_days: int = RETURN_DEPTH_DAYS,
    cap: int = STAGE_CAP,
) -> DataFrame:
    """Lowest and highest stage of the returns within ``max_days``."""
    users = cohort_returns(tables.f_max_campaign, "strict", reg_to, max_days)
    return return_depth(users, cap, CAPPED_STAGE_ENTERED)


# The same three reports from a state that is kept up day by day
# (``operators.state``), of which they read one row per user and no log.


def return_curve_from_state(
    state: DataFrame, reg_to: DateLike = "2019-10-01", horizon: int = RETURN_HORIZON
) -> DataFrame:
    """``return_curve_report``."""
    known = state.filter(date_range("reg_datekey", None, reg_to))
    return return_curve(state_users(known, max_days=horizon), horizon)


def return_stats_from_state(state: DataFrame, reg_to: DateLike = "2019-10-09") -> DataFrame:
    """``return_stats_report``."""
    return return_stats(state_users(state.filter(date_range("reg_datekey", None, reg_to))))


def return_depth_from_state(
    state: DataFrame, reg_to: DateLike = "2019-10-09", cap: int = STAGE_CAP
) -> DataFrame:
    """``return_depth_report``; the state says how many days count as near."""
    known = state.filter(date_range("reg_datekey", None, reg_to))
    return return_depth(state_users(known, near=True), cap, CAPPED_STAGE_ENTERED)
