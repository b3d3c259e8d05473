"""Labels that stand for numeric ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dayzero.constants import (
    CAPPED_STAGE,
    MINUTE_CAP,
    OVER_MINUTES,
    STAGE_CAP,
)


def bucketize(
    value: Column, edges: Sequence[float], labels: Sequence[str], else_label: str
) -> Column:
    """Label of the first edge that ``value`` is below; NULL and everything
    from the last edge on get ``else_label``."""
    if len(edges) != len(labels):
        raise ValueError("bucketize needs one label per edge")
    if not edges:
        return F.lit(else_label)
    ladder = F.when(value < edges[0], F.lit(labels[0]))
    for edge, label in zip(edges[1:], labels[1:]):
        ladder = ladder.when(value < edge, F.lit(label))
    return ladder.otherwise(F.lit(else_label))


def stage_label(
    stage: str | Column, cap: int = STAGE_CAP, label: str = CAPPED_STAGE
) -> Column:
    """The stage number as text, or ``label`` beyond ``cap``."""
    stage = F.col(stage) if isinstance(stage, str) else stage
    return F.when(stage > cap, F.lit(label)).otherwise(stage.cast("string"))


def minutes_label(
    minutes: str | Column, cap: int = MINUTE_CAP, over_label: str | None = None
) -> Column:
    """One label per minute up to ``cap`` (a zero in front below 10, so also
    in front of a minus sign), one shared label beyond it."""
    minutes = F.col(minutes) if isinstance(minutes, str) else minutes
    text = minutes.cast("string")
    return (
        F.when(minutes < 10, F.concat(F.lit("0"), text))
        .when(minutes <= cap, text)
        .when(minutes > cap, F.lit(over_label or OVER_MINUTES.format(cap=cap)))
    )
