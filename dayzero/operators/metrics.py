"""Putting separately computed metrics side by side."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_metrics(
    spine: DataFrame, metrics: Iterable[tuple[DataFrame, Sequence[str]]]
) -> DataFrame:
    """``spine`` with the columns of each metric; rows a metric does not have
    stay NULL and rows the spine does not have are dropped."""
    for metric, on in metrics:
        spine = spine.join(metric, list(on), "left")
    return spine


def none_if_zero(count: Column) -> Column:
    """A count of nobody shown as missing, as a left join would leave it."""
    return F.nullif(count, F.lit(0))
