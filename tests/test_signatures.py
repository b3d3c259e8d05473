"""Result columns of the reports, with their default arguments, on no data."""

from __future__ import annotations

import datetime as dt

import pytest

from dayzero import plans
from dayzero.sources import SCHEMAS, Tables

RATIO = ["network_name", "not_play_UU", "play_UU", "ratio"]
REVENUE = ["network_name", "not_play_revenue", "play_revenue"]
AGE = ["date_diff_reg", "network_name", "daily_revenue"]

REPORTS = [
    (plans.daily_count_as_of, {}, ["datekey", "cnt_2"]),
    (plans.register_time_distribution, {}, ["Hour", "min", "UU"]),
    (plans.minutes_to_stage_clear, {}, ["min_time", "UU"]),
    (
        plans.return_curve_report,
        {},
        ["reg_datekey", "not_play_UU", "diff", "return_UU", "return_UU_cum"],
    ),
    (plans.two_days_played, {}, ["cnt_1", "cnt_2", "UU"]),
    (plans.two_days_not_entered, {}, ["cnt_1", "cnt_2", "UU"]),
    (
        plans.loading_time_engagement,
        {"strict": True},
        ["reg_datekey", "avg_loading_time", "late_enter_UU", "enter_2dayUU",
         "enter_not_2_dayUU", "not_enter_UU"],
    ),
    (plans.channel_ratio_window, {}, RATIO),
    (plans.channel_ratio, {}, RATIO),
    (plans.channel_revenue_window, {}, REVENUE),
    (plans.channel_revenue, {}, REVENUE),
    (
        plans.weekly_not_entered,
        {},
        ["reg_datekey", "network_name", "reg_UU", "not_play_UU"],
    ),
    (plans.revenue_by_age, {}, AGE),
    (plans.recent_revenue_by_age, {}, AGE),
    (plans.stage_transitions_played, {}, ["diff_0", "diff_1", "UU"]),
    (plans.stage_transitions_not_entered, {}, ["diff_0", "diff_1", "UU"]),
    (
        plans.return_stats_report,
        {},
        ["reg_datekey", "not_play_UU", "play_UU", "avg_diff", "avg_diff_max"],
    ),
    (
        plans.return_depth_report,
        {},
        ["reg_datekey", "id_campaign", "id_campaign_max", "not_play_UU", "UU"],
    ),
    (plans.country_month, {}, ["reg_country", "reg_mon", "not_enter_UU", "reg_UU"]),
    (
        plans.first_login_loading,
        {"kind": "loose"},
        ["loading_time_ms", "reg_country", "UU"],
    ),
    (
        plans.first_login_loading,
        {"kind": "played", "countries": None},
        ["loading_time_ms", "UU"],
    ),
    (plans.install_to_login, {}, ["model", "install_cnt", "register_cnt", "login_UU"]),
]


@pytest.fixture(scope="module")
def empty(spark):
    return Tables(lambda name: spark.createDataFrame([], SCHEMAS[name]))


@pytest.mark.parametrize(("report", "arguments", "columns"), REPORTS)
def test_columns(empty, report, arguments, columns):
    result = report(empty, **arguments)
    assert result.columns == columns
    days = {plans.revenue_by_age: 81, plans.recent_revenue_by_age: 36}.get(report, 0)
    assert result.count() == days * 14


def test_default_snapshot_is_two_days_old(spark, frame, rows):
    now = dt.datetime.now(dt.timezone.utc)
    ages = [1, 3, 4]
    moments = [now - dt.timedelta(days=age) for age in ages]
    conversions = frame(
        "nid bigint, network_name string, created_at string",
        *[(1, None, str(int(moment.timestamp()))) for moment in moments],
    )
    tables = Tables.from_frames({"adjust_conversion": conversions})
    report = plans.daily_count_as_of(tables, first=dt.date(2019, 8, 1), last=now.date())
    expected = sorted((moment.date(), 1) for moment in moments[1:])
    assert rows(report) == expected


def test_last_day_is_included(frame, rows):
    def seconds(*moment):
        return str(int(dt.datetime(*moment, tzinfo=dt.timezone.utc).timestamp()))

    conversions = frame(
        "nid bigint, network_name string, created_at string",
        (1, None, seconds(2019, 7, 31, 23, 59, 59)),
        (1, None, seconds(2019, 8, 1)),
        (1, None, seconds(2019, 10, 21, 23, 59, 59)),
        (1, None, seconds(2019, 10, 22)),
    )
    tables = Tables.from_frames({"adjust_conversion": conversions})
    expected = [(dt.date(2019, 8, 1), 1), (dt.date(2019, 10, 21), 1)]
    assert rows(plans.daily_count_as_of(tables)) == expected
