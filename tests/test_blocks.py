"""Work along an order that is cut into blocks, against plain windows and loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dayzero.operators import as_of_join, running_total, running_total_in_blocks
from dayzero.operators.blocks import block_bounds, block_of
from dayzero.operators.distinct import distinct_counts, distinct_fold, number_users

ROWS = "k bigint, t bigint, nr bigint, v double"


def hot_rows(n: int, seed: int, keys: int = 5):
    """Two thirds of all rows belong to one key; NULLs everywhere."""
    pick = random.Random(seed)
    for nr in range(n):
        key = 0 if pick.random() < 0.66 else pick.choice([None, *range(1, keys)])
        t = pick.choice([None, *range(40)])
        yield key, t, nr, pick.choice([None, 1.0, 2.5, -3.0])


@pytest.mark.parametrize("blocks", [1, 7, 64])
def test_running_totals(spark, frame, rows, blocks):
    df = frame(ROWS, *hot_rows(400, 2)).repartition(5)
    plain = df.withColumn("total", running_total("v", ["k"], ["t", "nr"]))
    cut = running_total_in_blocks(df, "v", ["k"], ["t", "nr"], "total", blocks)
    assert cut.columns == plain.columns
    assert sorted(rows(cut), key=repr) == sorted(rows(plain), key=repr)


def test_no_window_holds_a_hot_key(spark, frame):
    """Of a key with all rows, a block has its share of them."""
    df = frame(ROWS, *[(0, t, t, 1.0) for t in range(6400)])
    placed = df.withColumn("b", block_of("t", block_bounds(df, "t", 64)))
    sizes = [r["n"] for r in placed.groupBy("k", "b").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 64 and max(sizes) < 150
    plan = running_total_in_blocks(df, "v", ["k"], ["t"], "total")._jdf.queryExecution().toString()
    assert "_block" in plan


def test_blocks_follow_the_order(spark):
    df = spark.range(100).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("t"))
    bounds = block_bounds(df, "t", 8)
    assert bounds == sorted(set(bounds)) and len(bounds) == 7
    found = df.select("t", block_of("t", bounds).alias("b")).collect()
    assert all(b == (-1 if t is None else sum(x <= t for x in bounds)) for t, b in found)
    assert block_bounds(df.limit(0), "t", 8) == []


@pytest.mark.parametrize("blocks", [1, 5, 64])
@pytest.mark.parametrize("seed", range(2))
def test_as_of_join(spark, frame, rows, blocks, seed):
    facts = list(hot_rows(200, 10 + seed))
    versions = [(k, t, nr, v) for k, t, nr, v in hot_rows(120, 20 + seed)]
    f = frame(ROWS, *facts).repartition(4)
    v = frame("k bigint, since bigint, version bigint, price double", *versions)
    found = as_of_join(f, v, ["k"], "t", "since", ["version"], blocks)
    expected = []
    for row in facts:
        key, t = row[:2]
        seen = [x for x in versions if x[0] == key and None not in (key, t, x[1]) and x[1] <= t]
        best = max(seen, key=lambda x: (x[1], x[2]))[1:] if seen else (None, None, None)
        expected.append((*row, *best))
    assert found.columns == ["k", "t", "nr", "v", "since", "version", "price"]
    assert sorted(rows(found), key=repr) == sorted(expected, key=repr)


def test_as_of_join_refuses_clashing_names(spark, frame):
    df = frame(ROWS, (1, 1, 1, 1.0))
    with pytest.raises(ValueError, match="share the columns"):
        as_of_join(df, df, ["k"], "t", "t")


def test_as_of_join_of_empty_tables(spark, frame, rows):
    df = frame(ROWS, (1, 1, 1, 1.0))
    none = frame("k bigint, since bigint", (1, 0)).limit(0)
    assert rows(as_of_join(df, none, ["k"], "t", "since")) == [(1, 1, 1, 1.0, None)]
    assert rows(as_of_join(df.limit(0), none, ["k"], "t", "since")) == []


FACTS = "nid bigint, day int, channel string, idle boolean"


def facts(n: int, users: int, seed: int):
    pick = random.Random(seed)
    for _ in range(n):
        nid = pick.choice([None, *[pick.randrange(users) for _ in range(30)]])
        yield nid, pick.randrange(20), pick.choice([None, "a", "b"]), pick.choice([None, True, False])


def test_numbers_are_dense_and_follow_the_order(spark, frame, rows):
    df = frame(FACTS, *facts(3000, 700, 1)).repartition(6)
    found = rows(number_users(df, order="day", parts=4))
    first_day = {r[0]: r[1] for r in rows(df.groupBy("nid").agg(F.min("day"))) if r[0] is not None}
    assert sorted(no for _, no in found) == list(range(1, len(first_day) + 1))
    assert len({nid for nid, _ in found}) == len(first_day)
    by_number = [first_day[nid] for nid, _ in sorted(found, key=lambda r: r[1])]
    assert by_number == sorted(by_number)


def test_counts_from_a_fold(spark, frame, rows, tmp_path):
    df = frame(FACTS, *facts(4000, 500, 3)).repartition(6)
    numbers = number_users(df, order="day")
    shifted = numbers.withColumn("user_no", F.col("user_no") * 300)  # over several ranges
    idle = F.coalesce("idle", F.lit(False))
    fold = distinct_fold(df, shifted, ["day", "channel"], among={"idle": idle})
    fold.write.parquet(str(tmp_path / "fold"))
    fold = spark.read.parquet(str(tmp_path / "fold"))
    assert fold.agg(F.count_distinct("bucket")).first()[0] > 3
    week = F.expr("day div 7").cast("int")
    for by in ([], ["channel"], ["day", "channel"], [week.alias("week")], [week.alias("week"), "channel"]):
        plain = df.groupBy(*by).agg(
            F.count_distinct("nid").alias("UU"), F.count_distinct(F.when(idle, F.col("nid"))).alias("idle")
        )
        found = distinct_counts(fold, by, UU="users", idle="idle")
        assert found.columns == plain.columns
        assert sorted(rows(found), key=repr) == sorted(rows(plain), key=repr)


def test_windows_only_see_parts(spark, frame):
    """The one window without a key is over a row per day and part."""
    df = frame(FACTS, *facts(50, 30, 4))
    plan = number_users(df, order="day")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 2
