"""Marts stored by user, long axes without a grid, logs reduced to likely members."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from checks.registry import REG_FROM, REG_TO, REPORTS, comparable, load
from dayzero import operators as ops
from dayzero import plans
from dayzero.operators.grid import axis_grid
from dayzero.sources import SCHEMAS, Tables, store_by_user

SMALL = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for name, schema in SCHEMAS.items():
        typed = [F.col(f.name).cast(f.dataType) for f in schema]
        getattr(load(spark, SMALL), name).select(*typed).write.parquet(str(root / name))
    return Tables.from_files(spark, str(root))


@pytest.fixture(scope="module")
def bucketed(spark, files, tmp_path_factory):
    root = tmp_path_factory.mktemp("bucketed")
    yield store_by_user(files, "by_user", str(root), buckets=4)
    spark.sql("DROP DATABASE by_user CASCADE")


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def user_shuffles(df) -> list[str]:
    return [line for line in physical(df).splitlines() if "hashpartitioning(" in line and "nid#" in line]


MART_REPORTS = {
    "q08": lambda t: plans.channel_ratio_window(t, REG_FROM, REG_TO),
    "q12": plans.weekly_not_entered,
    "q17": plans.return_stats_report,
    "q19": plans.country_month,
}


@pytest.mark.parametrize("name", MART_REPORTS)
def test_marts_by_user_meet_without_a_shuffle(files, bucketed, no_broadcast, rows, name):
    report = MART_REPORTS[name]
    plain = report(files)
    found = report(bucketed)
    assert sorted(rows(found), key=repr) == sorted(rows(plain), key=repr)
    assert user_shuffles(plain)
    by_user = user_shuffles(found)
    if name == "q12":  # users per week and channel are counted anew, as rows of several days
        by_user = [line for line in by_user if "network_name" not in line]
    if name == "q19":  # users per month and country likewise
        by_user = [line for line in by_user if "reg_country" not in line]
    assert by_user == []


def test_revenue_reads_marts_in_place(files, bucketed, no_broadcast, rows):
    """Q10 shuffles its two logs by user, and no mart."""
    report = REPORTS["q10_channel_revenue_window"]
    found, plain = (sorted(rows(comparable(report(t))), key=repr) for t in (bucketed, files))
    assert found == plain
    assert len(user_shuffles(report(bucketed))) < len(user_shuffles(report(files)))


def test_rows_are_dealt_by_user(spark, files, bucketed):
    for name in ("f_max_campaign", "f_user_map"):
        table = getattr(bucketed, name)
        assert table.columns == SCHEMAS[name].names
        assert sorted(map(tuple, table.collect()), key=repr) == sorted(
            map(tuple, getattr(files, name).collect()), key=repr
        )
    details = {r.col_name: r.data_type for r in spark.sql("DESCRIBE EXTENDED by_user.f_user_map").collect()}
    assert details["Num Buckets"] == "4" and details["Bucket Columns"] == "[`nid`]"


FACTS = "k bigint, step int, v double, total double"


@pytest.mark.parametrize("steps", [range(0, 20), range(5, 6), range(3, 18, 4)])
def test_runs_equal_the_grid(spark, frame, rows, steps):
    pick = random.Random(len(steps))
    cells = {(pick.choice([None, *range(6)]), pick.randrange(-3, 25)) for _ in range(50)}
    facts = frame(FACTS, *[(k, s, pick.choice([None, 1.5]), float(s)) for k, s in cells])
    keys = frame("k bigint, other string", *[(k, "x") for k in (0, 1, 2, 9, None, 1)])
    found = ops.densify_runs(keys, facts, ["k"], "step", steps, carry=["total"])
    assert found.columns == ["k", "step", "v", "total"]
    held = {(k, s): (v, t) for k, s, v, t in rows(facts)}
    expected = []
    for k in (0, 1, 2, 9, None):
        total = None
        for s in steps:
            v, t = held.get((k, s), (None, None))
            total = t if (k, s) in held else total
            expected.append((k, s, v, total))
    assert sorted(rows(found), key=repr) == sorted(expected, key=repr)


def test_runs_shuffle_facts_and_not_cells(spark, frame):
    facts = frame(FACTS, *[(k, k * 7, 1.0, 1.0) for k in range(50)])
    dense = ops.densify_runs(facts.select("k"), facts, ["k"], "step", range(10_000), carry=["total"])
    plan = dense._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.index("Generate") < plan.index("Window")
    assert dense.count() == 50 * 10_000
    grid = ops.grid(facts.select("k"), step=range(10_000))
    assert ops.densify(grid, facts, ["k", "step"]).agg(F.sum("v")).first() == dense.agg(F.sum("v")).first()
    assert axis_grid(spark, step=range(3)).count() == 3


def test_runs_need_ascending_steps(frame):
    facts = frame(FACTS, (1, 1, 1.0, 1.0))
    for steps in (range(0), range(5, 0, -1)):
        with pytest.raises(ValueError, match="ascending"):
            ops.densify_runs(facts, facts, ["k"], "step", steps)


@pytest.mark.parametrize("bits", [6, 9, 20])
def test_likely_members(spark, frame, rows, bits):
    pick = random.Random(bits)
    log = frame("nid bigint, x bigint", *[(pick.choice([None, pick.randrange(-900, 900)]), i) for i in range(3000)])
    members = frame("nid bigint, y bigint", *[(k, 1) for k in (None, *range(0, 60), 3, 3)])
    kept = rows(ops.likely_members(log, members, "nid", bits))
    wanted = {r for r in rows(log) if r[0] is not None and 0 <= r[0] < 60}
    assert wanted <= set(kept) and len(kept) == len(set(kept)) and all(k is not None for k, _ in kept)
    others = len(kept) - len(wanted)
    expected = 1500 * (1 - (1 - 2.0**-bits) ** 60)
    assert others <= 1.5 * expected + 20
    assert rows(ops.likely_members(log, members.limit(0), "nid", bits)) == []


def test_bitmaps_are_bounded(frame):
    log = frame("nid bigint", (1,))
    for bits in (5, 27):
        with pytest.raises(ValueError, match="bitmap"):
            ops.likely_members(log, log, "nid", bits)


@pytest.mark.parametrize(
    "name", ["q07_loading_time_engagement", "q20_loading_country_not_entered", "q21_loading_country_played", "q22_loading_played"]
)
def test_logs_are_reduced_before_they_are_folded(files, no_broadcast, rows, name):
    report = REPORTS[name]
    found = report(files, member_bits=12)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    log = next(i for i, line in enumerate(lines) if "Relation" in line and ("rsn" in line or "loading_time_ms" in line))
    above = next(i for i in range(log, -1, -1) if "Join" in lines[i] or "Aggregate" in lines[i])
    assert "Join Inner" in lines[above] and "_member_word" in lines[above]
    assert sorted(rows(found), key=repr) == sorted(rows(report(files)), key=repr)
