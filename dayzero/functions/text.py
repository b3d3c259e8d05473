"""Values packed in delimited text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def nested_split(
    text: str | Column,
    steps: Sequence[tuple[str, int]],
    cast: str | None = None,
    strict: bool = False,
) -> Column:
    """Split on each delimiter in turn and keep the element at that position
    (from 0).  A missing element or bad number is NULL, or an error when
    ``strict``, which is refused without ANSI mode."""
    if strict:
        session = SparkSession.getActiveSession()
        if session is not None and session.conf.get("spark.sql.ansi.enabled") != "true":
            raise ValueError("strict needs spark.sql.ansi.enabled=true: errors would be NULL")
    value = F.col(text) if isinstance(text, str) else text
    for delimiter, position in steps:
        parts = F.split(value, re.escape(delimiter))
        value = parts[position] if strict else F.get(parts, F.lit(position))
    if cast is not None:
        value = value.cast(cast) if strict else value.try_cast(cast)
    return value
