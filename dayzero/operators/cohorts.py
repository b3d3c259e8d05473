"""Cohorts picked by what a user did on the day of registration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayzero.constants import NOT_ENTERED
from dayzero.functions.dates import DateLike, date_range

# strict: neither tutorial nor stage; loose: no tutorial; played: some stage.
COHORTS = ("strict", "loose", "played")


def on_day0() -> Column:
    return F.col("datekey") == F.col("reg_datekey")


def in_cohort(kind: str) -> Column:
    """Whether a progress row puts its user into the cohort."""
    if kind not in COHORTS:
        raise ValueError(f"cohort {kind!r} is not one of {COHORTS}")
    if kind == "played":
        return on_day0() & (F.col("id_campaign") > 0)
    idle = on_day0() & (F.col("last_tutorial") == NOT_ENTERED)
    return idle & (F.col("id_campaign") == 0) if kind == "strict" else idle


def day0_cohort(
    progress: DataFrame,
    kind: str,
    reg_from: DateLike | None = None,
    reg_to: DateLike | None = None,
    keys: Sequence[str] = ("nid",),
    distinct: bool = True,
) -> DataFrame:
    """``keys`` of the users in a cohort; ``distinct=False`` keeps one row per
    progress row."""
    rows = progress.filter(
        in_cohort(kind) & date_range("reg_datekey", reg_from, reg_to)
    ).select(*keys)
    return rows.distinct() if distinct else rows


def cohort_members(
    progress: DataFrame,
    kinds: Sequence[str] = ("strict", "played"),
    reg_from: DateLike | None = None,
    reg_to: DateLike | None = None,
) -> DataFrame:
    """Several cohorts in one pass: per user the number of progress rows that
    put them into each cohort (0 if none), one column per cohort."""
    rows = progress.filter(
        on_day0() & F.col("nid").isNotNull() & date_range("reg_datekey", reg_from, reg_to)
    )
    counts = rows.groupBy("nid").agg(*[F.count_if(in_cohort(k)).alias(k) for k in kinds])
    return counts.filter(F.greatest(*kinds) > 0 if len(kinds) > 1 else F.col(kinds[0]) > 0)
