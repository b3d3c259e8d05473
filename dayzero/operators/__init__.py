"""DataFrame-to-DataFrame building blocks of the reports.

Shared rule: every log or mart is first reduced to one row per user and
attribute (Spark combines these on the map side, so a user or channel that owns
a large part of the rows never reaches one task whole).  Joins, windows and
counts then work on those rows, and a distinct-user count is a plain count.
"""

from dayzero.operators.blocks import as_of_join, running_total_in_blocks
from dayzero.operators.channels import attribute, user_payments
from dayzero.operators.cohorts import COHORTS, cohort_members, day0_cohort
from dayzero.operators.distinct import distinct_counts, distinct_fold, number_users
from dayzero.operators.engagement import consecutive_day_counts, two_day_matrix
from dayzero.operators.first_event import first_event
from dayzero.operators.funnel import device_funnel
from dayzero.operators.grid import densify, densify_runs, grid, running_total
from dayzero.operators.loading import login_loading
from dayzero.operators.metrics import join_metrics, none_if_zero
from dayzero.operators.minutes import minutes_between_hist
from dayzero.operators.prefilter import likely_members
from dayzero.operators.returns import (
    cohort_returns,
    first_return,
    return_curve,
    return_depth,
    return_stats,
)
from dayzero.operators.revenue import cumulative_revenue
from dayzero.operators.state import advance, return_state, state_users
from dayzero.operators.transitions import transition_matrix

__all__ = [
    "COHORTS",
    "advance",
    "as_of_join",
    "attribute",
    "cohort_members",
    "cohort_returns",
    "consecutive_day_counts",
    "cumulative_revenue",
    "day0_cohort",
    "densify",
    "densify_runs",
    "device_funnel",
    "distinct_counts",
    "distinct_fold",
    "first_event",
    "first_return",
    "grid",
    "join_metrics",
    "likely_members",
    "login_loading",
    "minutes_between_hist",
    "none_if_zero",
    "number_users",
    "return_curve",
    "return_depth",
    "return_state",
    "return_stats",
    "running_total",
    "running_total_in_blocks",
    "state_users",
    "transition_matrix",
    "two_day_matrix",
    "user_payments",
]
