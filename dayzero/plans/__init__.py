"""The finished reports: ``Tables`` in, one result DataFrame out.

All dates, horizons, thresholds and names are arguments.  The defaults are the
windows of the original study.
"""

from dayzero.plans.channels import (
    channel_ratio,
    channel_ratio_window,
    channel_revenue,
    channel_revenue_window,
    not_entered_by,
    not_entered_fold,
    recent_revenue_by_age,
    revenue_by_age,
    weekly_not_entered,
)
from dayzero.plans.devices import (
    country_month,
    first_login_loading,
    install_to_login,
)
from dayzero.plans.engagement import (
    loading_time_engagement,
    stage_transitions_not_entered,
    stage_transitions_played,
    two_days_not_entered,
    two_days_played,
)
from dayzero.plans.registration import (
    daily_count_as_of,
    minutes_to_stage_clear,
    register_time_distribution,
)
from dayzero.plans.returns import (
    return_curve_from_state,
    return_curve_report,
    return_depth_from_state,
    return_depth_report,
    return_stats_from_state,
    return_stats_report,
)

__all__ = [
    "channel_ratio",
    "channel_ratio_window",
    "channel_revenue",
    "channel_revenue_window",
    "country_month",
    "daily_count_as_of",
    "first_login_loading",
    "install_to_login",
    "loading_time_engagement",
    "minutes_to_stage_clear",
    "not_entered_by",
    "not_entered_fold",
    "recent_revenue_by_age",
    "register_time_distribution",
    "return_curve_from_state",
    "return_curve_report",
    "return_depth_from_state",
    "return_depth_report",
    "return_stats_from_state",
    "return_stats_report",
    "revenue_by_age",
    "stage_transitions_not_entered",
    "stage_transitions_played",
    "two_days_not_entered",
    "two_days_played",
    "weekly_not_entered",
]
