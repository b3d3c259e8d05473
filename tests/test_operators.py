"""Operators on hand-written rows with results worked out by hand."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dayzero import operators as ops
from dayzero import plans
from dayzero.operators.engagement import consecutive_day_counts, day_counts
from dayzero.operators.grid import axis_grid
from dayzero.operators.skew import join_per_key
from dayzero.sources import Tables, snapshot_as_of

PROGRESS = (
    "nid bigint, reg_datekey date, datekey date, id_campaign bigint, last_tutorial string"
)
PLAYS = "nid bigint, reg_datekey date, datekey date, id_campaign bigint"
USER_DAYS = (
    "nid bigint, reg_datekey date, datekey date, date_diff_reg int, network_name string, "
    "daily_revenue double"
)
IDLE, DONE = "tutorial not enter", "tutorial clear"


def day(number: int) -> str:
    return str(dt.date(2024, 1, 1) + dt.timedelta(days=number))


def date(number: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(days=number)


@pytest.fixture(scope="module")
def progress(frame):
    return frame(
        PROGRESS,
        (1, day(0), day(0), 0, IDLE),  # never returns
        (2, day(0), day(0), 0, IDLE),  # returns on day 1 and 2
        (2, day(0), day(1), 11001, DONE),
        (2, day(0), day(2), 12001, DONE),
        (3, day(0), day(0), 0, IDLE),  # returns at the horizon
        (3, day(0), day(3), 11001, DONE),
        (4, day(0), day(0), 0, IDLE),  # returns one day past it
        (4, day(0), day(4), 11201, DONE),
        (5, day(0), day(0), 11001, IDLE),  # loose, but played
        (6, day(0), day(0), 0, DONE),  # tutorial entered
        (7, day(1), day(1), 0, IDLE),  # a day without returners
        (7, day(1), day(2), 0, IDLE),  # present, but no stage
    )


@pytest.mark.parametrize(
    ("kind", "expected"),
    [("strict", [1, 2, 3, 4, 7]), ("loose", [1, 2, 3, 4, 5, 7]), ("played", [5])],
)
def test_day0_cohorts(progress, rows, kind, expected):
    users = ops.day0_cohort(progress, kind).orderBy("nid")
    assert rows(users) == [(nid,) for nid in expected]


def test_unknown_cohort(progress):
    with pytest.raises(ValueError, match="unknown"):
        ops.day0_cohort(progress, "unknown")


def test_cohort_duplicates_are_kept_on_request(progress, rows):
    doubled = progress.union(progress)
    once = ops.day0_cohort(doubled, "played")
    twice = ops.day0_cohort(doubled, "played", distinct=False)
    assert (once.count(), twice.count()) == (1, 2)
    members = ops.cohort_members(doubled, ["strict", "played"])
    assert (5, 0, 2) in rows(members) and (1, 2, 0) in rows(members)


def test_first_return(progress, rows):
    found = ops.first_return(progress, max_days=3).orderBy("nid")
    assert rows(found) == [(date(0), 2, date(1)), (date(0), 3, date(3))]


def test_return_curve_is_null_until_the_first_return(progress, rows):
    late = ops.cohort_returns(progress.filter("nid <> 2"))
    assert rows(ops.return_curve(late, horizon=3).filter("not_play_UU = 3")) == [
        (date(0), 3, 1, 0, None),
        (date(0), 3, 2, 0, None),
        (date(0), 3, 3, 1, 1),
    ]


def test_return_curve_properties(progress, rows):
    curve = rows(ops.return_curve(ops.cohort_returns(progress), horizon=5))
    assert len(curve) == 2 * 5
    first = [row for row in curve if row[0] == date(0)]
    assert [row[3] for row in first] == [1, 0, 1, 1, 0]
    assert [row[4] for row in first] == [1, 1, 2, 3, 3]
    assert all((row[4] or 0) <= row[1] for row in curve)


def test_return_stats(progress, rows):
    stats = ops.return_stats(ops.cohort_returns(progress)).orderBy("reg_datekey")
    assert rows(stats) == [(date(0), 4, 3, 8 / 3, 4), (date(1), 1, None, None, None)]


def test_return_depth_keeps_days_without_returners(progress, rows):
    users = ops.cohort_returns(progress, max_days=4)
    depth = rows(ops.return_depth(users, 12000, "far"))
    assert sorted(depth, key=str) == [
        (date(0), "11001", "11001", 4, 1),
        (date(0), "11001", "far", 4, 1),
        (date(0), "11201", "11201", 4, 1),
        (date(1), None, None, 1, None),
    ]


def test_labels_repeat_after_grouping(frame, rows):
    df = frame(
        PROGRESS,
        *[(nid, day(0), day(0), 0, IDLE) for nid in (1, 2)],
        (1, day(0), day(1), 12401, DONE),
        (2, day(0), day(1), 12201, DONE),
    )
    depth = ops.return_depth(ops.cohort_returns(df), 12000, "far")
    assert rows(depth) == [(date(0), "far", "far", 2, 1)] * 2


def test_day_counts(frame, rows):
    plays = frame(
        PLAYS,
        (1, day(0), day(0), 11001),
        (1, day(0), day(0), 11001),
        (1, day(0), day(0), 11201),
        (1, day(0), day(1), 11001),
        (1, day(0), day(2), 11401),  # not one of the two days
        (2, day(0), day(0), 11001),
        (2, day(0), day(1), None),  # no stage
        (3, day(0), day(1), 11001),  # nothing on day 0
    )
    counts = day_counts(plays)
    assert sorted(rows(counts)) == [(1, 2, 1), (2, 1, 0)]
    matrix = ops.two_day_matrix(counts)
    assert rows(matrix) == [(1, 0, 1), (2, 1, 1)]


def test_consecutive_day_counts(frame, rows):
    plays = frame(
        PLAYS,
        (1, day(0), day(0), 11001),
        (1, day(0), day(0), 11001),  # second play of day 0, no day before it
        (1, day(0), day(1), 11001),
        (1, day(0), day(1), 11201),  # second play, the day before has a first
        (1, day(0), day(1), 11401),  # third play
        (2, day(0), day(1), None),  # the first play has no stage
        (2, day(0), day(3), 11001),
        (2, day(0), day(3), 11201),  # a day is missing before it
        (3, day(0), day(0), 11001),  # not in the cohort
    )
    cohort = frame("nid bigint", (1,), (2,))
    counts = consecutive_day_counts(plays, cohort)
    assert sorted(rows(counts)) == [(1, 1, 1), (2, 1, 0)]


def test_transition_matrix_against_numbered_rows(frame, rows):
    df = frame(
        "nid bigint, id_campaign bigint",
        *[(1, stage) for stage in (5, 3, 3, 9)],
        *[(2, stage) for stage in (None, 4)],
        (3, 1),
        (None, 1),
        (None, 2),
    )
    assert sorted(rows(ops.transition_matrix(df, n=1)), key=str) == [
        ("3", "3", 1),
        (None, "4", 1),
    ]
    assert rows(ops.transition_matrix(df, n=2)) == [("3", "5", 1)]


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_copies_equal_repeated_rows(spark, rows, n):
    df = spark.range(60).selectExpr(
        "id % 7 nid", "id * 31 % 11 id_campaign", "1 + id % 7 % 3 copies"
    )
    repeated = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    folded = ops.transition_matrix(df, n, copies="copies")
    assert rows(folded) == rows(ops.transition_matrix(repeated.drop("copies", "i"), n))


def test_attribution_counts_rows_instead_of_repeating_them(frame, rows):
    registers = frame(
        "nid bigint, _i_t timestamp",
        (1, "2024-01-01 10:00:00"),
        (1, "2024-01-02 10:00:59"),  # the same clock on another day
        (2, "2024-01-01 10:54:59"),
        (3, "2024-01-01 10:55:00"),  # too late in the hour
        (4, "2024-01-01 10:01:00"),
    )
    conversions = frame(
        "nid bigint, network_name string",
        (1, None),
        (1, "Nontracking-Organic"),
        (2, "Organic"),
        (2, "Organic"),
        (2, "QooApp"),
        (9, "Organic"),
    )
    assert sorted(rows(ops.attribute(registers, conversions))) == [
        (1, "Nontracking-Organic", 2, 1, 2),
        (2, "Organic", 1, 1, 1),
        (2, "QooApp", 1, 1, 1),
        (4, "Nontracking-Organic", 1, 1, 1),
    ]


def test_cumulative_revenue(frame, rows):
    df = frame(
        USER_DAYS,
        (1, day(0), day(0), 0, "A", 100.0),  # before the grid
        (1, day(0), day(2), 2, "A", 1.5),
        (2, day(0), day(2), 2, "A", 2.5),
        (1, day(0), day(3), 3, "A", 1.0),
        (3, day(0), day(2), 2, None, 5.0),  # default, as NULL
        (4, day(0), day(2), 2, "D", 2.0),  # default, by name
        (5, day(0), day(1), 1, "D", None),  # no revenue
        (6, day(0), day(1), 1, "Z", 7.0),  # not listed
    )
    total = ops.cumulative_revenue(df, 3, ["D", "A"], "D")
    assert sorted(rows(total), key=lambda r: (r[1], r[0], r[2] or 0)) == [
        (1, "A", None),
        (2, "A", 4.0),
        (3, "A", 5.0),
        (1, "D", None),
        (2, "D", 2.0),  # the smaller of the two sums first
        (2, "D", 7.0),
        (3, "D", 7.0),
    ]
    assert ops.cumulative_revenue(df).count() == 81 * 14


def test_funnel_drops_devices_with_one_login(frame, rows):
    devices = frame(
        "model string, dm string, osv string",
        ("m", "a", "x"), ("m", "b", "x"), ("n", "c", "x"), ("o", None, "x"),
    )
    events = "_id bigint, nid bigint, _i_t timestamp, dm string, osv string"
    early = "2024-01-01"
    logins = frame(
        events,
        (1, 1, early, "a", "x"), (2, 1, early, "a", "x"), (3, 2, early, "a", "x"),
        (4, 4, early, "b", "x"), (4, 5, early, "b", "x"),  # one event number
        (5, 6, early, None, "x"), (6, 7, early, None, "x"),
        (7, 8, "2024-01-05", "a", "x"),
    )
    registers = frame("nid bigint, _i_t timestamp, dm string, osv string", (1, early, "b", "x"))
    installs = logins.drop("nid")
    funnel = ops.device_funnel(devices, installs, registers, logins, "2024-01-02")
    assert sorted(rows(funnel)) == [
        ("m", 4, 1, 2),
        ("n", None, None, None),
        ("o", None, None, None),
    ]


def test_minutes_histogram(frame, rows):
    starts = frame("nid bigint, _i_t timestamp", *[(n, "2024-01-01 10:00:30") for n in range(7)])
    ends = ["10:01:29", "10:09:30", "10:10:30", "11:40:30", "11:41:30", "12:30:30", "09:59:00"]
    clears = frame(
        "nid bigint, _i_t timestamp",
        *[(n, f"2024-01-01 {time}") for n, time in enumerate(ends)],
        (0, "2024-01-02 10:00:00"),  # another day
    )
    assert rows(ops.minutes_between_hist(starts, clears)) == [
        ("0-1", 1), ("00", 1), ("09", 1), ("10", 1), ("100", 1), ("100분 초과", 2),
    ]


def test_minutes_histogram_equals_all_pairs(spark, rows):
    """Folding a clock minute to its first and last event loses nothing."""
    spread = spark.range(400).selectExpr(
        "id % 3 nid", "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id * 7919 % 2000 * 0.7) t"
    )
    starts = spread.filter("hash(t) % 2 = 0").withColumnRenamed("t", "_i_t")
    ends = spread.filter("hash(t) % 2 <> 0").withColumnRenamed("t", "_i_t")
    pairs = starts.join(ends.withColumnRenamed("_i_t", "e"), "nid")
    expected = (
        pairs.selectExpr("nid", "timestampdiff(MINUTE, _i_t, e) m").distinct()
        .groupBy("m").agg(F.count("nid").alias("n")).orderBy("m")
    )
    by_minute = {str(m) if m >= 10 else f"0{m}": n for m, n in rows(expected)}
    assert dict(rows(ops.minutes_between_hist(starts, ends))) == by_minute


def test_first_event(frame, rows):
    logins = frame(
        "nid bigint, _i_t timestamp, _id bigint, v bigint",
        (1, "2024-01-02", 1, 10), (1, "2024-01-01", 3, None), (1, "2024-01-01", 4, 30),
        (2, None, 9, 5), (2, "2024-01-01", 1, 6),
    )
    first = ops.first_event(logins, "nid", ["_i_t", "_id"], ["v", "_id"])
    assert sorted(rows(first)) == [(1, None, 3), (2, 5, 9)]


def test_first_event_is_the_same_with_and_without_text(frame, rows):
    """Text columns take the other way of ordering."""
    pick = random.Random(3)
    times = [None, "1600-01-01", "1969-12-31 23:59:59.999999", "1970-01-01", "2024-01-01", "2024-01-01 00:00:00.000001"]
    numbers = [None, 0, 1, 2, 10**18, 2**63 - 1]
    every = {(k, t, n) for k in range(40) for t, n in [(pick.choice(times), pick.choice(numbers)) for _ in range(3)]}
    events = frame("k bigint, t timestamp, n bigint, v bigint", *[(*e, i) for i, e in enumerate(sorted(every, key=str))])
    columns = ["v", "t"]
    plain = ops.first_event(events.withColumn("s", F.lit("x")), "k", ["t", "n"], [*columns, "s"]).drop("s")
    fast = ops.first_event(events, "k", ["t", "n"], columns)
    assert sorted(rows(fast), key=str) == sorted(rows(plain), key=str)


def test_first_event_refuses_negative_numbers(frame):
    events = frame("k bigint, t timestamp, n bigint, v bigint", (1, "2024-01-01", -1, 5))
    with pytest.raises(Exception, match="n is below zero: -1"):
        ops.first_event(events, "k", ["t", "n"], ["v"]).collect()


def test_return_depth_is_ordered_by_label(frame, rows):
    """Labels sort as text, so a capped stage follows all numbers."""
    stages = [(1, 11001), (2, 9000), (3, 12201), (4, 11401), (5, 12401)]
    progress = frame(
        "nid bigint, reg_datekey date, datekey date, id_campaign bigint, last_tutorial string",
        *[(n, day(0), day(0), 0, "tutorial not enter") for n, _ in stages],
        *[(n, day(0), day(1), stage, "x") for n, stage in stages],
    )
    report = plans.return_depth_report(Tables.from_frames({"f_max_campaign": progress}), reg_to=day(9))
    assert [row[1] for row in rows(report)] == ["11001", "11401", "2월드 진입", "2월드 진입", "9000"]


def test_grid_and_densify(spark, frame, rows):
    cells = axis_grid(spark, a=range(1, 4), b=["x", "y"])
    facts = frame("a int, b string, v bigint", (1, "x", 5), (3, "y", 6), (9, "x", 7))
    dense = ops.densify(cells, facts, ["a", "b"]).orderBy("a", "b")
    assert [row[2] for row in rows(dense)] == [5, None, None, None, None, 6]


def test_join_metrics(frame, rows):
    spine = frame("k string", ("a",), ("b",), (None,))
    counts = frame("k string, n bigint", ("a", 1), ("z", 2), (None, 3))
    joined = ops.join_metrics(spine, [(counts, ["k"])])
    assert sorted(rows(joined), key=str) == [("a", 1), ("b", None), (None, None)]


def test_snapshot(frame, rows):
    df = frame(
        "k bigint, v date, id bigint",
        (1, day(0), 1), (1, day(2), 2), (1, day(2), 3), (1, day(5), 4), (2, day(5), 5),
    )
    seen = snapshot_as_of(df, "v", F.lit(date(3)))
    assert sorted(row[2] for row in rows(seen)) == [1, 2, 3]
    newest = snapshot_as_of(df, "v", F.lit(date(3)), ["k"], ["id"])
    assert rows(newest) == [(1, date(2), 3)]


@pytest.mark.parametrize("slice_rows", [1, 7, 100, 1000])
def test_join_per_key_with_hot_keys(spark, rows, slice_rows):
    facts = spark.range(300).selectExpr("id", "case when id < 100 then 0 else id % 20 end k")
    facts = facts.union(spark.createDataFrame([(999, None)], "id long, k long"))
    per_key = facts.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    joined = join_per_key(facts, per_key, "k", "id", "n", slice_rows)
    plain = facts.join(per_key.drop("n"), "k")
    assert sorted(joined.columns) == sorted(plain.columns)
    assert sorted(rows(joined.select("k", "id", "top"))) == sorted(
        rows(plain.select("k", "id", "top"))
    )


def plain_minutes(starts, ends, cap):
    """All pairs of a user's day, as a loop."""
    users = {}
    for nid, start in starts:
        for other, end in ends:
            if nid == other and start.date() == end.date():
                micros = (end - start) // dt.timedelta(microseconds=1)
                minutes = abs(micros) // 60_000_000 * (1 if micros >= 0 else -1)
                users.setdefault(minutes, set()).add(nid)
    counts = {}
    for minutes, nids in users.items():
        label = f"0{minutes}" if minutes < 10 else str(minutes) if minutes <= cap else "over"
        counts[label] = counts.get(label, 0) + len(nids)
    return sorted(counts.items())


@pytest.mark.parametrize("seed", range(3))
def test_minutes_between_all_pairs(spark, rows, seed):
    """Events on and off full minutes and seconds, before and after each other."""
    pick = random.Random(seed)
    base = dt.datetime(2024, 1, 1, 23, 0)

    def events(n):
        steps = (1, 1_000_000, 30_000_000, 60_000_000)
        for _ in range(n):
            step = pick.choice(steps)
            micros = pick.randrange(0, 3 * 3600 * 1_000_000, step)
            yield pick.randrange(6), base + dt.timedelta(microseconds=micros)

    starts, ends = list(events(40)), list(events(60))
    schema = "nid bigint, _i_t timestamp"
    found = ops.minutes_between_hist(
        spark.createDataFrame(starts, schema), spark.createDataFrame(ends, schema), 30, "over"
    )
    assert sorted(rows(found)) == plain_minutes(starts, ends, 30)


def test_minutes_of_a_bot_in_every_minute(spark, rows):
    """1,440 minutes on both sides meet without a row per pair."""
    base = dt.datetime(2024, 1, 1)
    schema = "nid bigint, _i_t timestamp"
    starts = [(1, base + dt.timedelta(minutes=m, seconds=20)) for m in range(1440)]
    ends = [(1, base + dt.timedelta(minutes=m, seconds=m % 60)) for m in range(1440)]
    found = ops.minutes_between_hist(
        spark.createDataFrame(starts, schema), spark.createDataFrame(ends, schema), 5000
    )
    assert sorted(rows(found)) == plain_minutes(starts, ends, 5000)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_minutes_need_both_sides(spark, rows):
    schema = "nid bigint, _i_t timestamp"
    one = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (None, dt.datetime(2024, 1, 1)), (2, None)], schema)
    other = spark.createDataFrame([(2, dt.datetime(2024, 1, 1)), (None, dt.datetime(2024, 1, 1)), (2, None)], schema)
    assert rows(ops.minutes_between_hist(one, other)) == []
    assert rows(ops.minutes_between_hist(one.limit(0), other)) == []
