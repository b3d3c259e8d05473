"""How much users play on two days in a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dayzero.functions.dates import DateLike, date_range, days_between


def day_counts(plays: DataFrame, reg_to: DateLike | None = None) -> DataFrame:
    """Per user who played on day 0: distinct stages of day 0 and of day 1."""
    days = days_between("reg_datekey", "datekey")
    stages = (
        plays.filter(
            date_range("reg_datekey", None, reg_to)
            & date_range("datekey", None, reg_to)
            & F.col("id_campaign").isNotNull()
            & days.isin(0, 1)
        )
        .groupBy("nid", "id_campaign")
        .agg(F.bool_or(days == 0).alias("day0"), F.bool_or(days == 1).alias("day1"))
    )
    counts = stages.groupBy("nid").agg(
        F.count_if("day0").alias("cnt_1"), F.count_if("day1").alias("cnt_2")
    )
    return counts.filter(F.col("cnt_1") > 0)


def consecutive_day_counts(
    plays: DataFrame, cohort: DataFrame, reg_to: DateLike | None = None
) -> DataFrame:
    """Per cohort user with plays: distinct stages of the first play of each
    day (``cnt_1``), and of the second plays whose day follows a day that has a
    first play (``cnt_2``).  Plays of a day are ordered by stage.

    Equal plays are first folded into one row with a count.  Only the first two
    plays of a day matter, so a count of two stands for any larger one.
    """
    folded = (
        plays.filter(
            date_range("reg_datekey", None, reg_to) & date_range("datekey", None, reg_to)
        )
        .groupBy("nid", "reg_datekey", "datekey", "id_campaign")
        .agg(F.least(F.count(F.lit(1)), F.lit(2)).alias("copies"))
        .join(cohort, "nid", "left_semi")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    )
    offset = days_between("reg_datekey", "datekey")
    in_day = W.partitionBy("nid", "diff").orderBy("datekey", "id_campaign")
    ranked = (
        folded.withColumn("diff", offset)
        .withColumn("rn", F.row_number().over(in_day))
        .filter(F.col("rn") <= 2)
    )
    day_before = (
        W.partitionBy("nid").orderBy(F.unix_date("datekey")).rangeBetween(-1, -1)
    )
    first, second = F.col("rn") == 1, F.col("rn") == 2
    follows = F.coalesce(F.bool_or(first).over(day_before), F.lit(False))
    marked = ranked.withColumn("follows", follows)
    # One or two rows per user and day are left, so the sets stay small.
    return marked.groupBy("nid").agg(
        F.size(F.collect_set(F.when(first, F.col("id_campaign")))).alias("cnt_1"),
        F.size(F.collect_set(F.when(second & F.col("follows"), F.col("id_campaign")))).alias(
            "cnt_2"
        ),
    )


def two_day_matrix(counts: DataFrame) -> DataFrame:
    """Users by ``cnt_1`` and ``cnt_2``; ``counts`` has one row per user."""
    return (
        counts.groupBy("cnt_1", "cnt_2")
        .agg(F.count("nid").alias("UU"))
        .orderBy("cnt_1", "cnt_2")
    )
