"""Versions on plain files against states that are kept whole."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dayzero import plans
from dayzero.operators import advance, cohort_returns, return_state, state_users
from dayzero.sources import (
    SCHEMAS,
    HistoryFiles,
    StateFiles,
    Tables,
    shared_folder,
    snapshot_as_of,
    with_validity,
)

SCHEMA = "k bigint, part string, value double, note string"


def moment(number: int) -> str:
    return str(dt.datetime(2024, 1, 1) + dt.timedelta(hours=number))


def random_commits(seed: int, n: int = 6):
    """(rows, complete, deleted keys) of each commit; keys hold NULLs, values repeat."""
    pick = random.Random(seed)
    keys = [(k, p) for k in (None, *range(12)) for p in (None, "a", "b")]
    for _ in range(n):
        chosen = pick.sample(keys, pick.randint(0, 25))
        rows = [(*key, pick.choice([None, 1.0, 2.0]), pick.choice([None, "x"])) for key in chosen]
        yield rows, pick.random() < 0.3, pick.sample(keys, 5)


@pytest.mark.parametrize("seed", range(3))
def test_every_moment_of_random_commits(spark, tmp_path, seed):
    history = HistoryFiles(spark, str(tmp_path), SCHEMA, ["k", "part"])
    state, states = {}, []
    for number, (rows, complete, deleted) in enumerate(random_commits(seed), 1):
        gone = spark.createDataFrame(deleted, "k bigint, part string")
        df = spark.createDataFrame(rows, SCHEMA)
        assert history.commit(df, moment(10 * number), complete, gone) == number
        if number == 1 or complete:
            state = {}
        for key in deleted if number > 1 else ():
            state.pop(key, None)
        state = {**state, **{row[:2]: row for row in rows}}
        states.append(sorted(state.values(), key=repr))
    assert history.as_of(moment(9)).count() == 0
    for number, expected in enumerate(states, 1):
        for at in (10 * number, 10 * number + 9):
            found = sorted(map(tuple, history.as_of(moment(at)).collect()), key=repr)
            assert found == expected
    for row in history.history().collect():
        assert row["valid_to"] is None or row["valid_to"] > row["valid_from"]


def test_rows_that_stay_equal_are_not_written_as_versions(spark, tmp_path):
    history = HistoryFiles(spark, str(tmp_path), SCHEMA, ["k"])
    df = spark.createDataFrame([(1, "a", None, "x"), (2, "b", 1.0, None)], SCHEMA)
    for number in range(3):
        history.commit(df, moment(number), complete=True)
    assert history.history().count() == 2
    history.commit(df.filter("k = 1"), moment(5), complete=True)
    held = {r["k"]: r["valid_to"] for r in history.history().collect()}
    assert held == {1: None, 2: dt.datetime(2024, 1, 1, 5)}


def test_unfinished_commits_are_not_seen(spark, tmp_path, monkeypatch):
    history = HistoryFiles(spark, str(tmp_path), SCHEMA, ["k"])
    history.commit(spark.createDataFrame([(1, "a", 1.0, "x")], SCHEMA), moment(1))

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(history.log, "add", lost)
        with pytest.raises(RuntimeError):
            history.commit(spark.createDataFrame([(1, "b", 9.0, "y")], SCHEMA), moment(2))
    assert [tuple(r) for r in history.as_of(moment(9)).collect()] == [(1, "a", 1.0, "x")]
    assert history.history().count() == 1
    history.commit(spark.createDataFrame([(1, "c", 3.0, "z")], SCHEMA), moment(3))
    assert [tuple(r) for r in history.as_of(moment(9)).collect()] == [(1, "c", 3.0, "z")]


def test_refused_commits(spark, tmp_path):
    history = HistoryFiles(spark, str(tmp_path), SCHEMA, ["k"])
    row = (1, "a", 1.0, "x")
    with pytest.raises(ValueError, match="one row per"):
        history.commit(spark.createDataFrame([row, row], SCHEMA), moment(1))
    assert history.log.all() == [] and history.history().count() == 0
    history.commit(spark.createDataFrame([row], SCHEMA), moment(2))
    for late in (1, 2):
        with pytest.raises(ValueError, match="last commit"):
            history.commit(spark.createDataFrame([row], SCHEMA), moment(late))


def test_only_folders_that_matter_are_read(spark, tmp_path):
    history = HistoryFiles(spark, str(tmp_path), SCHEMA, ["k"])
    for number in range(1, 6):
        df = spark.createDataFrame([(k, "a", float(number), "x") for k in range(20)], SCHEMA)
        history.commit(df, moment(number))
    recent = {path.split("rows/")[1].rsplit("/", 1)[0] for path in history.as_of(moment(4)).inputFiles()}
    plan = history.as_of(moment(4))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "commit" in plan and recent
    files = history.as_of(moment(4)).select(F.input_file_name()).distinct().collect()
    assert all("commit=5" in f[0] for f in files)


def test_validity_of_a_log(spark, frame, rows):
    log = frame("k bigint, at timestamp, nr bigint", *[
        (1, moment(1), 1), (1, moment(3), 2), (1, moment(3), 3), (2, moment(2), 4), (None, moment(5), 5),
    ])
    found = with_validity(log, ["k"], "at", ["nr"]).select("nr", F.hour("valid_from"), F.hour("valid_to"))
    assert sorted(rows(found)) == [(1, 1, 3), (3, 3, None), (4, 2, None), (5, 5, None)]
    at = F.to_timestamp(F.lit(moment(4)))
    bounded = with_validity(log, ["k"], "at", ["nr"])
    held = bounded.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
    newest = snapshot_as_of(log, "at", at, ["k"], ["nr"])
    assert sorted(rows(held.select("nr"))) == sorted(rows(newest.select("nr"))) == [(3,), (4,)]


def test_daily_counts_as_of(spark, tmp_path, rows):
    keys = ["nid", "network_name"]
    history = HistoryFiles(
        spark, str(tmp_path / "adjust_conversion"), SCHEMAS["adjust_conversion"], keys
    )
    day = 86400
    first = [(1, "a", str(19_000 * day)), (2, "a", str(19_000 * day + 5)), (2, None, str(19_001 * day))]
    history.commit(spark.createDataFrame(first, SCHEMAS["adjust_conversion"]), "2024-01-01")
    moved = [(1, "a", str(19_001 * day + 7))]
    history.commit(spark.createDataFrame(moved, SCHEMAS["adjust_conversion"]), "2024-01-02 12:00")
    tables = Tables.from_files(spark, str(tmp_path), histories={"adjust_conversion": keys})

    def counts(as_of):
        window = {"first": dt.date(2022, 1, 1), "last": dt.date(2022, 12, 31)}
        report = plans.daily_count_as_of(tables, **window, as_of=as_of, versioned=True)
        return [n for _, n in rows(report)]

    assert counts(dt.datetime(2023, 12, 31)) == []
    assert counts(dt.datetime(2024, 1, 2, 11)) == [2, 1]
    assert counts(dt.datetime(2024, 1, 2, 12)) == [1, 2]
    assert tables.adjust_conversion.count() == 3
    with pytest.raises(ValueError, match="not kept"):
        tables.as_of("f_user_map", "2024-01-01")


def test_shared_folder(spark, monkeypatch):
    class Cluster:
        conf = {}

        class sparkContext:  # noqa: N801
            master = "yarn"

    with pytest.raises(ValueError, match="share"):
        shared_folder(Cluster)
    Cluster.conf = {"spark.checkpoint.dir": "s3://bucket/folder/"}
    assert shared_folder(Cluster) == "s3://bucket/folder"


PROGRESS = "nid bigint, reg_datekey date, datekey date, id_campaign bigint, last_tutorial string"


def random_progress(seed: int):
    pick = random.Random(seed)
    rows = []
    for nid in (None, *range(60)):
        reg = dt.date(2024, 1, 1) + dt.timedelta(days=pick.randrange(4))
        for _ in range(pick.randrange(6)):
            day = reg + dt.timedelta(days=pick.choice([0, 0, 1, 2, 5, 9, 12]))
            tutorial = pick.choice(["tutorial not enter", "tutorial not enter", "done", None])
            rows.append((nid, str(reg), str(day), pick.choice([0, 0, 11001, 12005, None]), tutorial))
    return rows


@pytest.mark.parametrize("kind", ["strict", "loose", "played"])
def test_states_of_single_days_add_up(spark, tmp_path, frame, rows, kind):
    progress = frame(PROGRESS, *random_progress(5))
    files = StateFiles(spark, str(tmp_path))
    assert files.read() is None
    days = sorted(d[0] for d in rows(progress.select("datekey").distinct()))
    random.Random(1).shuffle(days)
    for number, day in enumerate([*days, days[0]]):  # any order, one day twice
        new = return_state(progress.filter(F.col("datekey") == F.lit(day)), kind)
        files.advance(new, moment(number), advance)
    kept = files.read()
    assert sorted(rows(kept), key=repr) == sorted(rows(return_state(progress, kind)), key=repr)
    for limit, near in ((None, False), (5, False), (7, True)):
        found = state_users(kept, None if near else limit, near=near)
        plain = cohort_returns(progress, kind, max_days=limit)
        columns = ["reg_datekey", "nid", "days", *(["first_stage", "last_stage"] if near else [])]
        assert sorted(rows(found.select(columns)), key=repr) == sorted(rows(plain.select(columns)), key=repr)
