"""Who of a cohort comes back, when, and how far they get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dayzero.constants import RETURN_HORIZON
from dayzero.functions.dates import DateLike, date_range, days_after, days_between
from dayzero.functions.labels import stage_label
from dayzero.operators.cohorts import in_cohort
from dayzero.operators.grid import running_total
from dayzero.operators.metrics import none_if_zero


def _returned(max_days: int | None) -> Column:
    """A stage reached on a later day than the registration."""
    later = (F.col("datekey") > F.col("reg_datekey")) & (F.col("id_campaign") > 0)
    if max_days is not None:
        later = later & (days_between("reg_datekey", "datekey") <= max_days)
    return later


def _in_reach(reg_to: DateLike | None, max_days: int | None) -> Column:
    """Registration limit, and the latest day that can matter under it.  The
    second follows from the first but prunes files or partitions by day."""
    reach = date_range("reg_datekey", None, reg_to)
    if reg_to is not None and max_days is not None:
        reach = reach & date_range("datekey", None, days_after(reg_to, max_days))
    return reach


def first_return(
    progress: DataFrame, reg_to: DateLike | None = None, max_days: int | None = None
) -> DataFrame:
    """First later day with a stage, per registration day and user."""
    rows = progress.filter(_returned(max_days) & _in_reach(reg_to, max_days))
    return rows.groupBy("reg_datekey", "nid").agg(F.min("datekey").alias("datekey"))


def cohort_returns(
    progress: DataFrame,
    kind: str = "strict",
    reg_to: DateLike | None = None,
    max_days: int | None = None,
) -> DataFrame:
    """One row per cohort user: days to the first return and the lowest and
    highest stage of all returns, NULL for users who never return.

    Cohort and returns come out of one aggregate over one scan.
    """
    member = in_cohort(kind)
    back = _returned(max_days) & F.col("nid").isNotNull()
    rows = progress.filter((member | back) & _in_reach(reg_to, max_days))
    users = rows.groupBy("reg_datekey", "nid").agg(
        F.bool_or(member).alias("member"),
        F.min(F.when(back, F.col("datekey"))).alias("first_day"),
        F.min(F.when(back, F.col("id_campaign"))).alias("first_stage"),
        F.max(F.when(back, F.col("id_campaign"))).alias("last_stage"),
    )
    return users.filter("member").select(
        "reg_datekey",
        "nid",
        days_between("reg_datekey", "first_day").alias("days"),
        "first_stage",
        "last_stage",
    )


def return_curve(users: DataFrame, horizon: int = RETURN_HORIZON) -> DataFrame:
    """Per registration day and day 1..horizon: cohort size, users whose first
    return is that day, and their running total (NULL before the first one).

    ``users`` has one row per user with ``reg_datekey`` and ``days``.  The
    counts of one registration day form a map with an entry per day, so the
    dense day axis is looked up instead of joined.
    """
    by_day = users.groupBy("reg_datekey", "days").agg(F.count("nid").alias("n"))
    returned = F.when(F.col("days").isNotNull(), F.struct("days", "n"))
    cohorts = by_day.groupBy("reg_datekey").agg(
        F.sum("n").alias("not_play_UU"),
        F.map_from_entries(F.collect_list(returned)).alias("returns"),
    )
    axis = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    curve = cohorts.withColumn("diff", axis).withColumn(
        "found", F.try_element_at("returns", F.col("diff"))
    )
    return curve.select(
        "reg_datekey",
        "not_play_UU",
        "diff",
        F.coalesce("found", F.lit(0)).alias("return_UU"),
        running_total("found", ["reg_datekey"], ["diff"]).alias("return_UU_cum"),
    ).orderBy("reg_datekey", "diff")


def return_stats(users: DataFrame) -> DataFrame:
    """Per registration day: cohort size, returners, mean and longest wait."""
    return users.groupBy("reg_datekey").agg(
        F.count("nid").alias("not_play_UU"),
        none_if_zero(F.count("days")).alias("play_UU"),
        F.avg("days").alias("avg_diff"),
        F.max("days").alias("avg_diff_max"),
    )


def return_depth(users: DataFrame, cap: int, label: str) -> DataFrame:
    """Per registration day: cohort size and returners by lowest and highest
    stage.  Groups are formed before the stages are labelled, so a label can
    repeat; a day without returners keeps one row without stages."""
    stages = users.groupBy("reg_datekey", "first_stage", "last_stage").agg(
        F.count("nid").alias("n")
    )
    day = W.partitionBy("reg_datekey")
    stages = stages.select(
        "*",
        F.sum("n").over(day).alias("not_play_UU"),
        F.max("first_stage").over(day).isNotNull().alias("any_return"),
    )
    returned = F.col("first_stage").isNotNull()
    return (
        stages.filter(returned | ~F.col("any_return"))
        .select(
            "reg_datekey",
            stage_label("first_stage", cap, label).alias("id_campaign"),
            stage_label("last_stage", cap, label).alias("id_campaign_max"),
            "not_play_UU",
            F.when(returned, F.col("n")).alias("UU"),
        )
        .orderBy("reg_datekey", "id_campaign")
    )
