"""First returns kept up day by day.

Everything that the return reports need of a user fits into one row, and two such
rows of one user, from different days of the log, merge into one by minimum, maximum and OR.
So the rows of a new day are folded and merged into the state, and no earlier day
is read again. The state of n days and day n + 1 equals that of n + 1 days.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayzero.constants import RETURN_DEPTH_DAYS
from dayzero.functions.dates import days_between
from dayzero.operators.cohorts import in_cohort

USER = ("reg_datekey", "nid")
# How each column of two rows of one user becomes one.
MERGES: Mapping[str, str] = {
    "member": "bool_or",
    "first_day": "min",
    "near_stage_low": "min",
    "near_stage_high": "max",
}


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*USER).agg(
        *[getattr(F, how)(name).alias(name) for name, how in MERGES.items()]
    )


def return_state(
    progress: DataFrame, kind: str = "strict", near_days: int = RETURN_DEPTH_DAYS
) -> DataFrame:
    """One row per user and registration day: cohort member or not, first later
    day with a stage, lowest and highest stage of the returns within
    ``near_days``. Of any number of days of the log."""
    member = in_cohort(kind)
    back = (F.col("datekey") > F.col("reg_datekey")) & (F.col("id_campaign") > 0)
    back = back & F.col("nid").isNotNull()
    near = back & (days_between("reg_datekey", "datekey") <= near_days)

    def only(condition: Column, name: str) -> Column:
        return F.when(condition, F.col(name))

    rows = progress.filter(member | back).select(
        *USER,
        F.coalesce(member, F.lit(False)).alias("member"),
        only(back, "datekey").alias("first_day"),
        only(near, "id_campaign").alias("near_stage_low"),
        only(near, "id_campaign").alias("near_stage_high"),
    )
    return _merged(rows)


def advance(state: DataFrame, new_days: DataFrame) -> DataFrame:
    """A state with the state of further days merged in. Days may come in any
    order and more than once."""
    return _merged(state.unionByName(new_days))


def state_users(state: DataFrame, max_days: int | None = None, near: bool = False) -> DataFrame:
    """The cohort as ``cohort_returns`` gives it: days to the first return, and
    lowest and highest stage (of the returns within the state's ``near_days``).

    ``max_days`` leaves out first returns after it. With ``near``, users whose only
    returns are later than ``near_days`` count as not returned.
    """
    days = days_between("reg_datekey", "first_day")
    if max_days is not None:
        days = F.when(days <= max_days, days)
    if near:
        days = F.when(F.col("near_stage_low").isNotNull(), days)
    return state.filter("member").select(
        *USER,
        days.alias("days"),
        F.col("near_stage_low").alias("first_stage"),
        F.col("near_stage_high").alias("last_stage"),
    )
