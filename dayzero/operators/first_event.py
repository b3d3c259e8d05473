"""The first row of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Values of these types have a fixed place in an aggregation buffer.
FIXED_WIDTH = (
    T.BooleanType,
    T.DateType,
    T.DecimalType,
    T.NumericType,
    T.TimestampNTZType,
    T.TimestampType,
)


def time_order(time: str, number: str) -> Column:
    """One DECIMAL(38) that sorts like (time, number), NULLs first.

    It has a fixed width, so ``min_by`` on it is a hash aggregate, where a
    struct would have every map task sort its rows.  Numbers have to be 0 or
    more; others raise an error rather than being sorted wrongly.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    before_all = F.lit(str(-(2**63))).cast("decimal(19,0)")
    major = F.coalesce(micros.cast("decimal(19,0)"), before_all)
    minor = F.when(
        F.col(number) < 0,
        F.raise_error(F.concat(F.lit(f"{number} is below zero: "), F.col(number))).cast("long"),
    ).otherwise(F.col(number))
    minor = F.coalesce(minor.cast("decimal(19,0)") + F.lit(1), F.lit(0).cast("decimal(20,0)"))
    shifted = major * F.lit(str(10**19)).cast("decimal(20,0)")
    return (shifted + minor).cast("decimal(38,0)")


def first_event(
    events: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """``columns`` of the first row of each key by ``order`` (NULLs first).

    An aggregate rather than a numbering window: each map task sends one row
    per key, however many events the key has.  End ``order`` with a unique
    column, otherwise tied first rows are picked at random.

    Ordered by a time and a whole number, and with no text among ``columns``,
    it is a hash aggregate; else every map task sorts its rows by key first.
    """
    kinds = {field.name: field.dataType for field in events.schema}
    timed = (
        len(order) == 2
        and isinstance(kinds[order[0]], (T.TimestampType, T.TimestampNTZType))
        and isinstance(kinds[order[1]], T.IntegralType)
    )
    if timed and all(isinstance(kinds[name], FIXED_WIDTH) for name in columns):
        rank = time_order(*order)
        firsts = [F.min_by(name, "_rank").alias(name) for name in columns]
        return events.withColumn("_rank", rank).groupBy(key).agg(*firsts)
    first = F.min_by(F.struct(*columns), F.struct(*order))
    return events.groupBy(key).agg(first.alias("_first")).select(key, "_first.*")
