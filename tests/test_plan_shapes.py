"""What the executed plans have to look like, whatever the data size."""

from __future__ import annotations

import datetime as dt
import re
from functools import partial

import pytest
from pyspark.sql.types import LongType, StructField, StructType

from checks.registry import REPORTS, load, queries
from dayzero import plans
from dayzero.sources import SCHEMAS, Tables

SMALL = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Empty stored tables: what is planned over files, not over the adapter."""
    root = tmp_path_factory.mktemp("stored")
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(str(root / name))
    return Tables.from_files(spark, str(root))


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_pairs_and_no_python(spark, name):
    plan = physical(queries()[name](spark, SMALL))
    for operator in ("CartesianProduct", "NestedLoopJoin", "Python", "Pandas"):
        assert operator not in plan


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_no_second_distinct_count(stored, name):
    assert "Expand" not in physical(REPORTS[name](stored))


@pytest.mark.parametrize(
    ("report", "scans"),
    [
        (plans.daily_count_as_of, 1),
        (plans.register_time_distribution, 2),
        (plans.minutes_to_stage_clear, 2),
        (partial(plans.first_login_loading, kind="loose"), 3),
        (partial(plans.first_login_loading, kind="played"), 3),
        (partial(plans.first_login_loading, kind="played", countries=None), 2),
        (plans.return_curve_report, 1),
        (plans.return_stats_report, 1),
        (plans.return_depth_report, 1),
        (plans.stage_transitions_played, 1),
        (plans.stage_transitions_not_entered, 2),
        (plans.loading_time_engagement, 2),
        (plans.channel_ratio_window, 2),
        (plans.channel_ratio, 4),
        (plans.channel_revenue_window, 5),  # one of them for the list of channels
        (plans.channel_revenue, 5),
        (plans.country_month, 2),
        (plans.install_to_login, 4),
        (plans.two_days_played, 2),
        (plans.weekly_not_entered, 2),
        (plans.revenue_by_age, 1),
    ],
)
def test_each_table_is_read_once(stored, report, scans):
    assert physical(report(stored)).count("FileScan") == scans


def test_broadcast_is_only_asked_for_bounded_sides(spark, stored):
    """Without size estimates to go by, only the revenue grid is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, report in REPORTS.items():
            plan = physical(report(stored))
            expected = name in ("q13_cumulative_revenue", "q14_cumulative_revenue_recent")
            assert ("BroadcastExchange" in plan) == expected, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_columns_reach_the_scan(stored):
    plan = physical(plans.register_time_distribution(stored))
    assert "LessThan(_i_t,2019-10-02" in plan
    assert "LessThanOrEqual(reg_datekey,2019-10-01)" in plan
    assert "EqualTo(last_tutorial,tutorial not enter)" in plan
    assert "struct<nid:bigint,_i_t:timestamp>" in plan
    assert "dm:string" not in plan

    plan = physical(plans.loading_time_engagement(stored))
    assert "GreaterThanOrEqual(_i_t,2019-08-26" in plan
    assert "LessThanOrEqual(datekey,2019-10-16)" in plan
    assert "In(rsn, [" in plan

    plan = physical(plans.minutes_to_stage_clear(stored))
    assert "EqualTo(campaign_data.id_campaign,11001)" in plan
    assert "LessThan(_i_t,2019-10-02" in plan

    plan = physical(plans.return_depth_report(stored, max_days=7))
    assert "LessThanOrEqual(datekey,2019-10-16)" in plan

    plan = physical(plans.return_curve_report(stored))
    assert "LessThanOrEqual(datekey,2019-12-15)" in plan

    for plan in map(physical, (plans.channel_revenue(stored), plans.channel_revenue_window(stored))):
        assert "ReadSchema: struct<network_name:string>" in plan


def test_bounds_reach_the_scan_of_epoch_numbers(spark, tmp_path):
    as_numbers = StructType(
        [
            StructField(f.name, LongType() if f.name == "created_at" else f.dataType)
            for f in SCHEMAS["adjust_conversion"]
        ]
    )
    spark.createDataFrame([], as_numbers).write.parquet(str(tmp_path / "adjust_conversion"))
    tables = Tables.from_files(spark, str(tmp_path), schemas={"adjust_conversion": as_numbers})
    report = plans.daily_count_as_of(tables, as_of=dt.datetime(2019, 10, 20))
    plan = physical(report)
    assert "GreaterThanOrEqual(created_at,1564617600)" in plan
    assert "LessThanOrEqual(created_at,1571529600)" in plan
    assert report.count() == 0


@pytest.mark.parametrize("kind", ["loose", "played"])
def test_first_logins_are_not_sorted(stored, kind):
    assert "SortAggregate" not in physical(plans.first_login_loading(stored, kind))


def test_minutes_meet_without_a_join(stored):
    """Both sides are folded to clock minutes, then gathered per user and day."""
    plan = physical(plans.minutes_to_stage_clear(stored))
    assert "Join" not in plan
    shuffles = [line for line in plan.splitlines() if "hashpartitioning(nid" in line]
    # Two by user, day and clock minute, which fold the logs, and one by user and day.
    assert len(shuffles) == 3 and all("day" in line for line in shuffles)
    assert sum(line.count("#") == 3 for line in shuffles) == 2


def test_adapter_joins_on_users_only(spark):
    """Nothing but the bounded list of cut users is broadcast on request, and
    no event is looked up by its number."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in Tables.names():
            plan = physical(getattr(load(spark, SMALL), name))
            joins = [line for line in plan.splitlines() if "Join [" in line]
            assert not any("event_id" in line for line in joins), name
            asked = plan.count("BroadcastExchange")
            assert asked == plan.count("BroadcastHashJoin") <= 2, name
            assert "_slices" in plan or not asked, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_partition_pruning_by_day(spark, tmp_path):
    days = spark.createDataFrame(
        [(1, dt.date(2019, 9, 1), dt.date(2019, 9, d), 0, "x") for d in range(1, 29)],
        SCHEMAS["f_max_campaign"],
    )
    path = str(tmp_path / "f_max_campaign")
    days.write.partitionBy("datekey").parquet(path)
    tables = Tables.from_files(spark, str(tmp_path))
    report = plans.return_depth_report(tables, reg_to="2019-09-01", max_days=7)
    plan = physical(report)
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert filters and all("(datekey" in f and "<= 2019-09-08" in f for f in filters)


def test_rank_limit_before_the_shuffle(spark):
    plan = physical(queries()["k10_snapshot_as_of"](spark, SMALL))
    assert plan.count("WindowGroupLimit") == 2


def first_below(lines: list[str], start: int) -> str:
    """What an exchange shuffles: its first descendant that is not a mere
    projection, filter or format change."""
    passing = ("Project", "Filter", "ColumnarToRow", "Generate", "Sort [")
    for line in lines[start + 1 :]:
        operator = line.lstrip(" :+-*()0123456789")
        if not operator.startswith(passing):
            return operator
    raise AssertionError("an exchange without input")


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_logs_are_folded_before_the_shuffle(spark, stored, name):
    """No table but the small device list is shuffled as it is read."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = physical(REPORTS[name](stored)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert exchanges
    for i in exchanges:
        shuffled = first_below(lines, i)
        assert "FileScan" not in shuffled or "dim_osv_temp" in shuffled, shuffled
