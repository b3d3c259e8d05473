"""Dense axes and running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def grid(rows: DataFrame, **axes: range | Sequence) -> DataFrame:
    """Each row of ``rows`` with each combination of the axis values.  The
    values are literals, so they are generated in place and not joined."""
    for name, values in axes.items():
        if isinstance(values, range):
            ends = F.lit(values.start), F.lit(values[-1]), F.lit(values.step)
            axis = F.sequence(*ends)
        else:
            axis = F.array(*[F.lit(value) for value in values])
        rows = rows.select("*", F.explode(axis).alias(name))
    return rows


def axis_grid(spark: SparkSession, **axes: range | Sequence) -> DataFrame:
    """All combinations of the axis values."""
    one_row = spark.range(0, 1, 1, 1)
    return grid(one_row, **axes).drop("id")


def densify(spine: DataFrame, facts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every row of the dense ``spine``, with its facts or NULLs."""
    return spine.join(facts, list(on), "left")


def running_total(
    column: str, partition: Sequence[str], order: Sequence[str]
) -> Column:
    """Sum of all rows up to the current one, NULL until a value occurs."""
    frame = W.partitionBy(*partition).orderBy(*order)
    return F.sum(column).over(frame.rowsBetween(W.unboundedPreceding, W.currentRow))


def densify_runs(
    keys: DataFrame,
    facts: DataFrame,
    on: Sequence[str],
    axis: str,
    steps: range,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Every key with every step of a long axis, and its facts or NULLs.

    Equals ``densify`` over the grid of keys and steps, but no grid is joined:
    each fact stands for the run of steps up to the next fact of its key, and
    runs are spread out where they are, after the only shuffle, which holds
    the facts and one row per key. Columns in ``carry`` keep their value over the
    run (a running total, a state), the others hold in the fact's own step.

    ``facts`` has one row per key and step at most; others than ``keys`` and
    ``steps`` are left out. Steps are whole numbers in ascending order.
    """
    if not len(steps) or steps.step <= 0:
        raise ValueError("the axis needs steps in ascending order")
    values = [name for name in facts.columns if name not in (*on, axis)]
    inside = (F.col(axis) >= steps[0]) & (F.col(axis) <= steps[-1])
    if steps.step > 1:
        inside = inside & ((F.col(axis) - steps[0]) % steps.step == 0)
    kind = facts.schema[axis].dataType
    before = F.lit(steps[0] - steps.step).cast(kind)
    known = keys.select(*on).distinct().withColumns({axis: before, "_is_key": F.lit(True)})
    rows = facts.filter(inside).unionByName(known, allowMissingColumns=True)
    by_key = W.partitionBy(*on)
    following = F.lead(axis).over(by_key.orderBy(axis))
    rows = rows.withColumns(
        {
            "_until": F.coalesce(following, F.lit(steps[-1] + steps.step).cast(kind)) - F.lit(steps.step).cast(kind),
            "_known": F.max("_is_key").over(by_key),
        }
    )
    rows = rows.filter(F.col("_known") & ~((F.col(axis) == before) & (F.col("_until") == before)))
    first = F.when(F.col("_is_key"), F.lit(steps[0]).cast(kind)).otherwise(F.col("_from"))
    run = F.sequence(first, F.col("_until"), F.lit(steps.step).cast(kind))
    spread = rows.withColumnRenamed(axis, "_from").withColumn(axis, F.explode(run))
    own = F.col(axis) == F.col("_from")
    return spread.select(
        *on, axis, *[F.col(v) if v in carry else F.when(own, F.col(v)).alias(v) for v in values]
    )
