"""Column expressions on hand-written values."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dayzero.constants import (
    ENGAGEMENT_EDGES,
    ENGAGEMENT_ELSE,
    ENGAGEMENT_LABELS,
    LOADING_EDGES,
    LOADING_LABELS,
)
from dayzero.functions import (
    bucketize,
    days_after,
    epoch_to_date,
    minutes_between,
    minutes_label,
    nested_split,
    next_midnight,
    stage_label,
    time_range,
    usable_minutes,
    week_of_year,
)
from dayzero.operators.loading import loading_bucket, loading_time


def values(df, column):
    return [row[0] for row in df.select(column).collect()]


@pytest.mark.parametrize(
    ("seconds", "minutes"),
    [(59, 0), (60, 1), (540, 9), (600, 10), (6000, 100), (9000, 150), (-59, 0), (-90, -1)],
)
def test_minutes_are_cut_toward_zero(frame, seconds, minutes):
    start = dt.datetime(2024, 1, 1, 10, 0, 30)
    end = start + dt.timedelta(seconds=seconds)
    df = frame("a timestamp, b timestamp", (str(start), str(end)))
    assert values(df, minutes_between("a", "b")) == [minutes]


def test_minutes_label(frame):
    df = frame("m bigint", (-3,), (0,), (9,), (10,), (100,), (101,), (None,))
    expected = ["0-3", "00", "09", "10", "100", "100분 초과", None]
    assert values(df, minutes_label("m")) == expected
    assert values(df, minutes_label("m", cap=9, over_label="x"))[2:5] == ["09", "x", "x"]


def test_week_starts_on_sunday(frame):
    days = ["2023-01-01", "2022-01-01", "2020-12-31", "2024-01-06", "2024-01-07"]
    df = frame("d date", *[(day,) for day in days])
    assert values(df, week_of_year("d")) == [1, 0, 52, 0, 1]


def test_week_equals_the_calendar_of_many_years(spark):
    days = spark.range(365 * 12).select(
        F.date_add(F.lit("2015-01-01"), F.col("id").cast("int")).alias("d")
    )
    for day, week in days.select("d", week_of_year("d")).collect():
        assert week == int(day.strftime("%U")), day


def test_minutes_of_every_hour(frame):
    clock = ["10:54:59", "10:55:00", "23:54:59", "23:55:00"]
    df = frame("t timestamp", *[(f"2024-01-01 {time}",) for time in clock])
    assert values(df, usable_minutes("t")) == [True, False, True, False]
    assert values(df, usable_minutes("t", every_hour=False)) == [True, True, True, False]


def test_nested_split(frame):
    texts = ["a,100000;x", "a", "UNDEFINED", None, "a,xx;y", "a,7"]
    df = frame("add_rsn string", *[(text,) for text in texts])
    assert values(df, loading_time()) == [100.0, None, None, None, None, 0.007]
    assert values(df, nested_split("add_rsn", [(",", 0)]))[:3] == ["a", "a", "UNDEFINED"]


@pytest.mark.parametrize("text", ["a", "a,xx;y"])
def test_strict_split_raises(frame, text):
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX|CAST_INVALID_INPUT"):
        frame("add_rsn string", (text,)).select(loading_time(strict=True)).collect()


def test_split_delimiters_are_literal(frame):
    df = frame("t string", ("a.b|c.d",))
    assert values(df, nested_split("t", [("|", 1), (".", 0)])) == ["c"]


def test_buckets(frame):
    df = frame("v double", (99.999,), (100.0,), (999.0,), (1000.0,), (None,), (-5.0,))
    label = bucketize(F.col("v"), ENGAGEMENT_EDGES, ENGAGEMENT_LABELS, ENGAGEMENT_ELSE)
    assert values(df, label) == [
        "a.under_100", "b.under_200", "j.under_1000", "k.over_1000", "k.over_1000",
        "a.under_100",
    ]
    assert values(df, loading_bucket(F.col("v")))[2:5] == ["over 800"] * 3
    assert len(LOADING_EDGES) == len(LOADING_LABELS) == 8
    with pytest.raises(ValueError):
        bucketize(F.col("v"), [1], [], "x")


def test_stage_label(frame):
    df = frame("s bigint", (0,), (12000,), (12001,), (None,))
    assert values(df, stage_label("s")) == ["0", "12000", "2월드", None]


def test_ranges(frame):
    df = frame("t timestamp", ("2024-01-01",), ("2024-01-02 12:00:00",), ("2024-01-03",))
    inside = time_range("t", "2024-01-01", "2024-01-03")
    assert values(df, inside) == [True, True, False]
    assert values(df, time_range("t")) == [True, True, True]


def test_epoch_to_date(frame):
    df = frame("s bigint", (0,), (86399,), (86400,), (-1,))
    expected = [(1970, 1, 1), (1970, 1, 1), (1970, 1, 2), (1969, 12, 31)]
    assert values(df, epoch_to_date(F.col("s"))) == [dt.date(*day) for day in expected]


def test_day_arithmetic():
    assert days_after("2024-02-28", 2) == dt.date(2024, 3, 1)
    assert next_midnight("2024-01-09") == dt.date(2024, 1, 9)
    assert next_midnight("2024-01-09 00:00:01") == dt.date(2024, 1, 10)
