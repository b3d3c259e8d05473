from __future__ import annotations

import pytest

from checks.events import read_events, tables_from_events
from checks.registry import REPORTS, load
from dayzero.functions import nested_split
from dayzero.operators import skew
from dayzero.sources import SCHEMAS, Tables, read_table_as_of

SMALL = "/root/testdata/sf0.001"


def test_adapter_columns(spark):
    tables = load(spark, SMALL)
    for name, schema in SCHEMAS.items():
        assert getattr(tables, name).columns == schema.names, name


def test_files_catalog_and_views(spark, tmp_path, rows):
    tables = load(spark, SMALL)
    spark.sql("CREATE DATABASE IF NOT EXISTS marts")
    name = "dim_osv_temp"
    tables.dim_osv_temp.write.parquet(str(tmp_path / name))
    spark.read.parquet(str(tmp_path / name)).write.mode("overwrite").saveAsTable(
        f"marts.{name}"
    )
    expected = sorted(rows(tables.dim_osv_temp))
    assert sorted(rows(Tables.from_files(spark, str(tmp_path)).dim_osv_temp)) == expected
    named = Tables.from_catalog(spark, "logs", "marts")
    assert sorted(rows(named.dim_osv_temp)) == expected
    moved = Tables.from_catalog(spark, "x", "y", {name: f"marts.{name}"})
    assert sorted(rows(moved.dim_osv_temp)) == expected
    tables.register_views()
    assert spark.sql(f"SELECT count(*) FROM {name}").first()[0] == len(expected)
    spark.sql("DROP DATABASE marts CASCADE")


def test_unknown_table(spark):
    with pytest.raises(AttributeError):
        _ = load(spark, SMALL).no_such_table


def test_plain_tables_keep_no_versions(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("unversioned")
    with pytest.raises(Exception, match="TIME_TRAVEL|time travel"):
        read_table_as_of(spark, "unversioned", "2024-01-01").collect()


@pytest.fixture
def settings(spark):
    """Settings of the session for one test."""
    before = {}

    def change(key, value):
        before.setdefault(key, spark.conf.get(key))
        spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        spark.conf.set(key, value)


ZONED = ["q02_register_time_distribution", "q03_minutes_to_stage_clear",
         "q07_loading_time_engagement", "q09_channel_ratio_all"]


@pytest.mark.parametrize("name", ZONED)
def test_other_session_zones_are_refused(spark, tmp_path, settings, name):
    for table, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / table))
    opened = Tables.from_files(spark, str(tmp_path))
    settings("spark.sql.session.timeZone", "Asia/Seoul")
    with pytest.raises(ValueError, match="Asia/Seoul"):
        Tables.from_files(spark, str(tmp_path))
    with pytest.raises(ValueError, match="Asia/Seoul"):
        Tables.from_catalog(spark, "logs", "marts")
    with pytest.raises(ValueError, match="Asia/Seoul"):
        REPORTS[name](opened)
    settings("spark.sql.session.timeZone", "Etc/UTC")
    assert REPORTS[name](opened).count() == 0


def test_strict_needs_ansi_mode(settings):
    settings("spark.sql.ansi.enabled", "false")
    with pytest.raises(ValueError, match="ansi"):
        nested_split("text", [(",", 1)], "long", strict=True)


def test_versions_are_opened_by_the_catalog(spark, tmp_path):
    with pytest.raises(ValueError, match="catalog"):
        Tables.from_files(spark, str(tmp_path)).as_of("adjust_conversion", "2024-01-01")
    spark.sql("CREATE DATABASE IF NOT EXISTS versions")
    spark.createDataFrame([], SCHEMAS["adjust_conversion"]).write.mode("overwrite").saveAsTable(
        "versions.adjust_conversion"
    )
    tables = Tables.from_catalog(spark, "versions", "versions")
    query = REPORTS["q01_daily_count_as_of"]
    assert query(tables).count() == 0
    with pytest.raises(Exception, match="TIME_TRAVEL|time travel"):
        query(tables, versioned=True).collect()
    spark.sql("DROP DATABASE versions CASCADE")


def test_the_list_of_cut_users_is_bounded(spark, monkeypatch, rows):
    events = read_events(spark, SMALL)
    monkeypatch.setattr(skew, "MAX_CUT_KEYS", 3)
    seen = []
    monkeypatch.setattr(skew.F, "broadcast", lambda df: seen.append(df.count()) or df)
    sliced = tables_from_events(events, slice_rows=1).pve_campaign_result
    assert seen and max(seen) <= 3
    whole = tables_from_events(events).pve_campaign_result
    assert sorted(rows(sliced), key=repr) == sorted(rows(whole), key=repr)


@pytest.mark.parametrize("name", ["common_gamemoney", "f_user_map", "pve_campaign_result"])
def test_slices_change_nothing(spark, rows, name):
    """Every user cut into slices of ten events."""
    events = read_events(spark, SMALL)
    whole = getattr(tables_from_events(events), name)
    sliced = getattr(tables_from_events(events, slice_rows=10), name)
    assert sorted(rows(sliced), key=repr) == sorted(rows(whole), key=repr)
