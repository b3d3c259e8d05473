"""From the n-th to the next row of each user."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dayzero.functions.labels import stage_label


def transition_matrix(
    rows: DataFrame,
    n: int = 1,
    key: str = "nid",
    value: str = "id_campaign",
    copies: str | None = None,
    member: Column | None = None,
    label: Callable[[str], Column] = stage_label,
) -> DataFrame:
    """Users by the labels of their n-th and (n+1)-th row in order of ``value``.

    ``copies`` names a column saying how often a row counts, for rows that a
    join would have repeated.  ``member`` keeps only keys with a row for which
    it holds.  Keys with fewer rows are left out.

    Equal rows of a key become one row with a count, and a running total of the
    counts tells which positions it covers.  So both positions are read in one
    window pass, and repeated rows are never written out.
    """
    weight = F.count(F.lit(1)) if copies is None else F.sum(copies)
    runs = (
        rows.filter(F.col(key).isNotNull())
        .groupBy(key, value)
        .agg(
            weight.alias("copies"),
            F.bool_or(F.lit(True) if member is None else member).alias("member"),
        )
    )
    return _pairs(runs, n, key, value, label)


def _pairs(
    runs: DataFrame, n: int, key: str, value: str, label: Callable[[str], Column]
) -> DataFrame:
    in_order = W.partitionBy(key).orderBy(value)
    up_to_here = in_order.rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.col("last")

    def at(position: int) -> Column:
        covers = (last - F.col("copies") < position) & (last >= position)
        return F.max(F.when(covers, F.col(value)))

    users = (
        runs.withColumn("last", F.sum("copies").over(up_to_here))
        .groupBy(key)
        .agg(
            at(n).alias("from_value"),
            at(n + 1).alias("to_value"),
            F.max("last").alias("n_rows"),
            F.bool_or("member").alias("member"),
        )
        .filter((F.col("n_rows") > n) & F.col("member"))
    )
    return (
        users.groupBy(
            label("from_value").alias("diff_0"), label("to_value").alias("diff_1")
        )
        .agg(F.count(F.lit(1)).alias("UU"))
        .orderBy("diff_0", "diff_1")
    )
