"""Spark side of the checks: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import lru_cache, partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from checks.events import PARTNER_LOGIN, read_events, tables_from_events
from dayzero import operators as ops
from dayzero import plans
from dayzero.functions import (
    as_date,
    as_timestamp,
    bucketize,
    minutes_between,
    nested_split,
    stage_label,
    time_range,
    usable_minutes,
    week_of_year,
)
from dayzero.operators.engagement import consecutive_day_counts
from dayzero.operators.grid import axis_grid
from dayzero.operators.loading import loading_time
from dayzero.sources import (
    SCHEMAS,
    HistoryFiles,
    StateFiles,
    Tables,
    shared_folder,
    snapshot_as_of,
    store_by_user,
)

Query = Callable[[SparkSession, str], DataFrame]

# Windows that fit the test log (January 2024).
REG_FROM, REG_TO = "2024-01-02", "2024-01-08"
BEFORE = "2024-01-09"
REASONS = ("session/login", PARTNER_LOGIN)

RAW = {
    "customer": "c_custkey BIGINT, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, "
    "o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "supplier": "s_suppkey BIGINT, s_nationkey INT, s_acctbal DOUBLE",
}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(RAW[name]).parquet(f"{sf_dir}/{name}.parquet")


def since_epoch(unit: str, column: str) -> Column:
    return F.timestamp_diff(unit, as_timestamp("1970-01-01"), F.col(column))


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@lru_cache(maxsize=4)
def load(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables of a folder, opened once per session (plans, not data)."""
    return tables_from_events(read_events(spark, sf_dir))


def comparable(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and doubles with six digits, as the oracle has them."""
    columns = []
    for field in df.schema:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("long")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 6)
        columns.append(column.alias(field.name))
    return df.select(*columns)


# --- the reports -------------------------------------------------------------


# Name -> the report with its arguments, still to be given the tables.
REPORTS: dict[str, Callable[[Tables], DataFrame]] = {
    "q01_daily_count_as_of": partial(
        plans.daily_count_as_of,
        first=dt.date(2024, 1, 2),
        last=dt.date(2024, 1, 10),
        as_of=dt.datetime(2024, 1, 8, 12),
    ),
    "q02_register_time_distribution": partial(
        plans.register_time_distribution, reg_to=REG_TO, before=BEFORE
    ),
    "q03_minutes_to_stage_clear": partial(
        plans.minutes_to_stage_clear, before=BEFORE, cap=600
    ),
    "q03_minutes_to_stage_clear_100": partial(plans.minutes_to_stage_clear, before=BEFORE),
    "q04_return_curve": partial(plans.return_curve_report, reg_to=REG_TO),
    "q05_two_day_matrix_played": partial(plans.two_days_played, reg_to=REG_TO),
    "q06_two_day_matrix_not_entered": partial(plans.two_days_not_entered, reg_to=REG_TO),
    "q07_loading_time_engagement": partial(
        plans.loading_time_engagement,
        reg_from=REG_FROM,
        reg_to=REG_TO,
        before=BEFORE,
        reasons=REASONS,
    ),
    "q08_channel_ratio_window": partial(
        plans.channel_ratio_window, reg_from=REG_FROM, reg_to=REG_TO
    ),
    "q09_channel_ratio_all": partial(plans.channel_ratio),
    "q10_channel_revenue_window": partial(
        plans.channel_revenue_window, first=REG_FROM, last=REG_TO, before=BEFORE
    ),
    "q11_channel_revenue_all": partial(plans.channel_revenue),
    "q12_weekly_not_entered": partial(plans.weekly_not_entered),
    "q13_cumulative_revenue": partial(plans.revenue_by_age),
    "q14_cumulative_revenue_recent": partial(
        plans.recent_revenue_by_age, min_reg="2024-01-03"
    ),
    "q15_transition_played": partial(plans.stage_transitions_played, reg_to=REG_TO),
    "q16_transition_not_entered": partial(
        plans.stage_transitions_not_entered, reg_to=REG_TO
    ),
    "q17_return_stats": partial(plans.return_stats_report, reg_to=REG_TO),
    "q18_return_depth": partial(plans.return_depth_report, reg_to=REG_TO),
    "q19_country_month": partial(plans.country_month),
    "q20_loading_country_not_entered": partial(
        plans.first_login_loading, kind="loose", reg_from=REG_FROM
    ),
    "q21_loading_country_played": partial(
        plans.first_login_loading, kind="played", reg_from=REG_FROM
    ),
    "q22_loading_played": partial(
        plans.first_login_loading, kind="played", reg_from=REG_FROM, countries=None
    ),
    "q23_device_funnel": partial(plans.install_to_login, before=BEFORE),
}


# --- the operators -----------------------------------------------------------


def k01_day0_cohort(spark, sf_dir):
    progress = load(spark, sf_dir).f_max_campaign
    return ops.day0_cohort(
        progress, "strict", REG_FROM, REG_TO, keys=["reg_datekey", "nid"]
    )


def k02_first_return(spark, sf_dir):
    return ops.first_return(load(spark, sf_dir).f_max_campaign, REG_TO, max_days=10)


def k03_return_curve(spark, sf_dir):
    progress = load(spark, sf_dir).f_max_campaign
    users = ops.cohort_returns(progress, "loose", max_days=29)
    return ops.return_curve(users, horizon=29)


def k04_densify(spark, sf_dir):
    lines = raw(spark, sf_dir, "lineitem")
    month = F.month("l_shipdate").alias("ship_month")
    facts = lines.groupBy("l_suppkey", month).agg(F.sum("l_quantity").alias("quantity"))
    spine = ops.grid(
        raw(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey")),
        ship_month=range(1, 13),
    )
    return ops.densify(spine, facts, ["l_suppkey", "ship_month"])


def k04_sparse_axis(spark, sf_dir):
    """Running quantity of each supplier on each of 10,000 days."""
    day = F.datediff(F.to_date("l_shipdate"), as_date("1992-01-01"))
    lines = raw(spark, sf_dir, "lineitem").select("l_suppkey", day.alias("day"), "l_quantity")
    facts = lines.groupBy("l_suppkey", "day").agg(F.sum("l_quantity").alias("quantity"))
    facts = facts.withColumn("total", ops.running_total("quantity", ["l_suppkey"], ["day"]))
    suppliers = raw(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    dense = ops.densify_runs(suppliers, facts, ["l_suppkey"], "day", range(10_000), carry=["total"])
    return dense.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("days"),
        F.count("quantity").alias("days_shipped"),
        F.sum("quantity").alias("quantity"),
        F.count("total").alias("days_since_first"),
        F.sum("total").alias("total_days"),
    )


def k05_nested_split(spark, sf_dir):
    money = load(spark, sf_dir).common_gamemoney
    tail = nested_split("add_rsn", [(";", 1)], "long")
    return money.groupBy("nid", "rsn").agg(
        F.count(loading_time()).alias("n_times"),
        F.sum(loading_time()).alias("time_sum"),
        F.sum(tail).alias("tail_sum"),
    )


def k06_bucketize(spark, sf_dir):
    price = F.when(F.col("l_discount") != 0, F.col("l_extendedprice"))
    bucket = bucketize(price, [5000, 20000, 50000], ["low", "mid", "high"], "rest")
    return (
        raw(spark, sf_dir, "lineitem")
        .groupBy(bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    )


def k07_attribution(spark, sf_dir):
    tables = load(spark, sf_dir)
    return ops.attribute(
        tables.common_register, tables.adjust_conversion, start=REG_FROM, before=BEFORE
    )


def k08_transition_matrix(spark, sf_dir):
    lines = raw(spark, sf_dir, "lineitem").withColumn(
        "quantity", F.col("l_quantity").cast("long")
    )
    return ops.transition_matrix(
        lines,
        n=2,
        key="l_orderkey",
        value="quantity",
        member=F.col("l_returnflag") == "R",
        label=lambda quantity: stage_label(quantity, 40, "many"),
    )


def k09_join_metrics(spark, sf_dir):
    customers = raw(spark, sf_dir, "customer")
    suppliers = raw(spark, sf_dir, "supplier")
    nations = raw(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    by_customer = customers.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("c_acctbal").alias("mean_balance")
    )
    by_supplier = suppliers.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        F.count(F.lit(1)).alias("suppliers")
    )
    return ops.join_metrics(
        nations, [(by_customer, ["n_nationkey"]), (by_supplier, ["n_nationkey"])]
    )


def k10_snapshot_as_of(spark, sf_dir):
    newest = snapshot_as_of(
        raw(spark, sf_dir, "orders"),
        "o_orderdate",
        as_timestamp("1998-01-01"),
        keys=["o_custkey"],
        tie_breakers=["o_orderkey"],
    )
    return newest.select(
        "o_custkey", "o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("day")
    )


def k11_first_event(spark, sf_dir):
    return ops.first_event(
        raw(spark, sf_dir, "orders"),
        "o_custkey",
        ["o_orderdate", "o_orderkey"],
        ["o_orderkey", "o_totalprice", "o_orderstatus"],
    )


def k12_stage_label(spark, sf_dir):
    plays = load(spark, sf_dir).f_pve_campaign_result
    return plays.groupBy(stage_label("id_campaign").alias("stage")).agg(
        F.count(F.lit(1)).alias("plays"), F.count_distinct("nid").alias("UU")
    )


def k13_cumulative_revenue(spark, sf_dir):
    return ops.cumulative_revenue(
        load(spark, sf_dir).f_user_map,
        horizon=10,
        channels=("Nontracking-Organic", "Organic", "QooApp", "nobody"),
        default="Nontracking-Organic",
    )


def k14_device_funnel(spark, sf_dir):
    tables = load(spark, sf_dir)
    return ops.device_funnel(
        tables.dim_osv_temp,
        tables.common_installed,
        tables.common_register,
        tables.common_login,
    )


def k15_minutes_hist(spark, sf_dir):
    tables = load(spark, sf_dir)
    return ops.minutes_between_hist(
        tables.common_register,
        tables.pve_campaign_result.filter(F.col("first_clear") == 1),
        cap=720,
        over_label="over half a day",
    )


def k16_two_day_matrix(spark, sf_dir):
    tables = load(spark, sf_dir)
    players = ops.day0_cohort(tables.f_max_campaign, "played")
    return ops.two_day_matrix(
        consecutive_day_counts(tables.f_pve_campaign_result, players)
    )


# --- versions and states on plain files ---------------------------------------


def _versioned(as_of: dt.datetime) -> Query:
    """The daily count over a history of three commits: a first load, corrected
    and deleted rows, and a complete copy that lacks some rows."""

    def build(spark, sf_dir):
        root = new_folder(spark, "history")
        keys = ["nid", "network_name"]
        schema = SCHEMAS["adjust_conversion"]
        history = HistoryFiles(spark, f"{root}/adjust_conversion", schema, keys)
        conversions = load(spark, sf_dir).adjust_conversion
        seconds = F.col("created_at").cast("long")

        def created(before: str) -> DataFrame:
            moment = dt.datetime.fromisoformat(before).replace(tzinfo=dt.timezone.utc)
            return conversions.filter(seconds < int(moment.timestamp()))

        def user(rest: int, of: int) -> Column:
            return F.col("nid") % of == rest

        history.commit(created("2024-01-05"), "2024-01-05")
        moved = F.when(user(0, 7), seconds + 86400).otherwise(seconds).cast("string")
        changed = created("2024-01-08").filter(~user(0, 13)).withColumn("created_at", moved)
        gone = created("2024-01-08").filter(user(0, 13)).select(*keys)
        history.commit(changed, "2024-01-08", deleted=gone)
        history.commit(created("2024-01-11").filter(~user(1, 4)), "2024-01-11", complete=True)
        tables = Tables.from_files(spark, root, histories={"adjust_conversion": keys})
        window = {"first": dt.date(2024, 1, 2), "last": dt.date(2024, 1, 10)}
        return plans.daily_count_as_of(tables, **window, as_of=as_of, versioned=True)

    return build


def k10_history_as_of(spark, sf_dir):
    """Newest order per customer as three complete commits saw it, at two moments
    between them, and all rows that ever held."""
    orders = raw(spark, sf_dir, "orders")
    schema = "o_custkey bigint, o_orderkey bigint, o_totalprice double"
    history = HistoryFiles(spark, new_folder(spark, "history"), schema, ["o_custkey"])
    for moment in ("1994-01-01", "1996-01-01", "1998-01-01"):
        newest = snapshot_as_of(
            orders, "o_orderdate", as_timestamp(moment), ["o_custkey"], ["o_orderkey"]
        )
        kept = F.lit(True) if moment != "1998-01-01" else F.col("o_custkey") % 10 != 3
        history.commit(newest.filter(kept), moment, complete=True)
    ever = history.history().select(F.lit("ever").alias("moment"), *history.schema.names)
    for moment in ("1995-06-30", "1998-06-30"):
        held = history.as_of(moment).select(F.lit(moment).alias("moment"), "*")
        ever = ever.unionByName(held)
    return ever


def k10_as_of_join(spark, sf_dir):
    """Lines with the newest order, by their shipping day, of the customer who has
    the supplier's number."""
    lines = raw(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity")
    orders = raw(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("l_suppkey"), "o_orderdate", "o_orderkey", "o_totalprice"
    )
    joined = ops.as_of_join(
        lines, orders, ["l_suppkey"], "l_shipdate", "o_orderdate", ["o_orderkey"]
    )
    return joined.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count("o_orderkey").alias("with_order"),
        F.sum("o_orderkey").alias("order_keys"),
        F.round(F.sum("o_totalprice"), 2).alias("prices"),
    )


def w_running_orders(spark, sf_dir):
    """Running totals over all orders of a priority: five keys with all the rows."""
    orders = raw(spark, sf_dir, "orders").select(
        "o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice"
    )
    running = ops.running_total_in_blocks(
        orders, "o_totalprice", ["o_orderpriority"], ["o_orderdate", "o_orderkey"], "running"
    )
    return running.select("o_orderkey", "o_orderpriority", F.round("running", 2).alias("running"))


def _prefiltered(name: str, bits: int) -> Query:
    """A report whose raw log is reduced to likely members of its cohort first."""
    return lambda spark, sf_dir: REPORTS[name](load(spark, sf_dir), member_bits=bits)


def _from_fold(period: Callable[[], Column]) -> Query:
    """The weekly report's counts by some period, from a stored fold by day."""

    def build(spark, sf_dir):
        path = new_folder(spark, "fold")
        plans.not_entered_fold(load(spark, sf_dir)).write.parquet(path)
        return plans.not_entered_by(spark.read.parquet(path), period())

    return build


def _kept_state(spark, sf_dir) -> DataFrame:
    """The return state of the log's first days, then moved on day by day."""
    progress = load(spark, sf_dir).f_max_campaign
    files = StateFiles(spark, new_folder(spark, "state"))
    cuts = ["2024-01-06", "2024-01-07", "2024-01-08", "2030-01-01"]
    for since, until in zip(["2000-01-01", *cuts], cuts):
        days = (F.col("datekey") >= F.lit(since)) & (F.col("datekey") < F.lit(until))
        files.advance(ops.return_state(progress.filter(days)), until, ops.advance)
    return files.read()


def q04_from_state(spark, sf_dir):
    return plans.return_curve_from_state(_kept_state(spark, sf_dir), REG_TO)


def q17_from_state(spark, sf_dir):
    return plans.return_stats_from_state(_kept_state(spark, sf_dir), REG_TO)


def q18_from_state(spark, sf_dir):
    return plans.return_depth_from_state(_kept_state(spark, sf_dir), REG_TO)


KEPT: dict[str, Query] = {
    "q01_daily_count_versioned": _versioned(dt.datetime(2024, 1, 9, 12)),
    "q01_daily_count_versioned_late": _versioned(dt.datetime(2024, 1, 12)),
    "q07_loading_time_prefiltered": _prefiltered("q07_loading_time_engagement", 20),
    "q20_loading_country_prefiltered": _prefiltered("q20_loading_country_not_entered", 8),
    "q21_loading_country_prefiltered": _prefiltered("q21_loading_country_played", 20),
    "q22_loading_prefiltered": _prefiltered("q22_loading_played", 20),
    "q12_weekly_from_fold": _from_fold(lambda: week_of_year("reg_datekey")),
    "q12_monthly_from_fold": _from_fold(lambda: F.month("reg_datekey")),
    **{
        build.__name__: build
        for build in (
            k10_history_as_of,
            k10_as_of_join,
            w_running_orders,
            q04_from_state,
            q17_from_state,
            q18_from_state,
        )
    },
}


# --- families of primitives, on the plain tables -----------------------------


def s01_stored_tables(spark, sf_dir):
    """A report over tables that are written to files and opened from there."""
    root = new_folder(spark, "stored")
    for name in ("common_register", "f_max_campaign"):
        table = getattr(load(spark, sf_dir), name)
        typed = [F.col(field.name).cast(field.dataType) for field in SCHEMAS[name]]
        table.select(*typed).write.parquet(f"{root}/{name}")
    return REPORTS["q02_register_time_distribution"](Tables.from_files(spark, root))


def s01_bucketed_tables(spark, sf_dir):
    """A report over marts that are stored by user."""
    name = f"bucketed_{uuid.uuid4().hex}"
    tables = store_by_user(load(spark, sf_dir), name, new_folder(spark, "bucketed"), buckets=8)
    return REPORTS["q08_channel_ratio_window"](tables)


def s_series(spark, sf_dir):
    month = F.month("o_orderdate").alias("month")
    totals = raw(spark, sf_dir, "orders").groupBy(month).agg(
        F.count(F.lit(1)).alias("orders")
    )
    return ops.densify(axis_grid(spark, month=range(0, 15)), totals, ["month"])


def p_predicates(spark, sf_dir):
    lines = raw(spark, sf_dir, "lineitem")
    shipped = F.col("l_shipdate")
    kept = lines.filter(
        time_range("l_shipdate", "1996-01-01", "1998-01-01")
        & (F.to_date(shipped) != as_date("1997-05-05"))
        & ((F.col("l_returnflag") == "R") | (F.col("l_linestatus") == "O"))
        & F.col("l_linenumber").isin(1, 2, 4, 7)
        & (F.col("l_quantity") > F.col("l_linenumber"))
        & F.col("l_partkey").isNotNull()
    )
    return kept.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("l_quantity").alias("quantity"),
        F.min(F.to_date(shipped)).alias("first_day"),
    )


def p_struct_access(spark, sf_dir):
    plays = load(spark, sf_dir).pve_campaign_result
    return plays.groupBy(
        F.col("campaign_data.id_campaign").alias("id_campaign"), "first_clear"
    ).agg(F.count(F.lit(1)).alias("plays"), F.count_distinct("nid").alias("UU"))


def j_inner_composite(spark, sf_dir):
    tables = load(spark, sf_dir)
    stages = tables.f_max_campaign.filter(F.col("id_campaign") > 0)
    return (
        stages.join(tables.f_user_map.select("nid", "datekey", "daily_revenue"), ["nid", "datekey"])
        .groupBy("id_campaign")
        .agg(
            F.count(F.lit(1)).alias("days"),
            F.sum("daily_revenue").alias("daily_revenue"),
        )
    )


def j_left_composite(spark, sf_dir):
    tables = load(spark, sf_dir)
    new = tables.f_user_map.filter(F.col("nru") == 1).select(
        "reg_datekey", "nid", "reg_country"
    )
    returned = ops.first_return(tables.f_max_campaign)
    joined = new.join(returned, ["reg_datekey", "nid"], "left")
    return joined.groupBy("reg_country").agg(
        F.count(F.lit(1)).alias("users"),
        F.count("datekey").alias("returned"),
        F.max("datekey").alias("last_first_return"),
    )


def j_semi_in(spark, sf_dir):
    big = raw(spark, sf_dir, "orders").filter(F.col("o_totalprice") > 480000)
    return (
        raw(spark, sf_dir, "customer")
        .join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
        .groupBy("c_mktsegment")
        .agg(F.count(F.lit(1)).alias("customers"))
    )


def j_theta_self(spark, sf_dir):
    """Customers with an order of one year below some order of the next year:
    their smallest against their largest, so no pairs are formed."""
    year = F.year("o_orderdate")
    price = F.col("o_totalprice")
    per_customer = (
        raw(spark, sf_dir, "orders")
        .filter(time_range("o_orderdate", "1996-01-01", "1998-01-01"))
        .groupBy("o_custkey")
        .agg(
            F.min(F.when(year == 1996, price)).alias("low"),
            F.max(F.when(year == 1996, price)).alias("high"),
            F.min(F.when(year == 1997, price)).alias("next_low"),
            F.max(F.when(year == 1997, price)).alias("next_high"),
        )
    )
    return per_customer.agg(
        F.count_if(F.col("low") < F.col("next_high")).alias("rising"),
        F.count_if(F.col("high") >= F.col("next_low")).alias("not_rising"),
    )


def j_cross_grid(spark, sf_dir):
    customers = raw(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("customers")
    )
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "NONE"]
    cells = axis_grid(spark, c_nationkey=range(0, 25), c_mktsegment=segments)
    return ops.densify(cells, customers, ["c_nationkey", "c_mktsegment"])


def a_distinct_multi(spark, sf_dir):
    return (
        raw(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count_distinct("l_suppkey").alias("suppliers"),
            F.count_distinct("l_partkey").alias("parts"),
            F.avg("l_quantity").alias("mean_quantity"),
            F.max("l_extendedprice").alias("top_price"),
        )
    )


def a_conditional_distinct(spark, sf_dir):
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))
    return (
        raw(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey")
        .agg(F.count_distinct(returned).alias("returned_parts"))
    )


def a_having_hidden(spark, sf_dir):
    return (
        raw(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.round(F.sum("o_totalprice"), 2).alias("spent"),
            F.count_distinct("o_orderpriority").alias("priorities"),
        )
        .filter(F.col("priorities") > 4)
        .drop("priorities")
    )


def a_group_alias(spark, sf_dir):
    """Grouping by a new value that keeps the name of its input."""
    return (
        load(spark, sf_dir)
        .f_user_map.groupBy(
            F.coalesce("network_name", F.lit("Nontracking-Organic")).alias("network_name")
        )
        .agg(F.count_distinct("nid").alias("UU"), F.count(F.lit(1)).alias("days"))
    )


def w_running_sum(spark, sf_dir):
    monthly = (
        raw(spark, sf_dir, "orders")
        .groupBy(
            "o_orderpriority",
            (F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("month"),
        )
        .agg(F.sum("o_totalprice").alias("total"))
    )
    running = ops.running_total("total", ["o_orderpriority"], ["month"])
    return monthly.select("o_orderpriority", "month", F.round(running, 2).alias("running"))


def w_row_number_nth(spark, sf_dir):
    in_order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return (
        raw(spark, sf_dir, "orders")
        .withColumn("rn", F.row_number().over(in_order))
        .filter(F.col("rn") == 3)
        .select("o_custkey", "o_orderkey", "rn")
    )


def o_label_sort(spark, sf_dir):
    label = stage_label(F.col("l_quantity").cast("long"), 45, "over 45")
    return (
        raw(spark, sf_dir, "lineitem")
        .groupBy(label.alias("l_quantity"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("l_quantity")
    )


def f_time_functions(spark, sf_dir):
    day_start = F.to_timestamp_ntz(F.to_date("ts"))
    tomorrow = F.to_date(F.col("ts") + F.expr("INTERVAL 1 DAY"))
    two_days_ago = F.to_date(F.col("ts") - F.expr("INTERVAL 2 DAY"))
    seconds = since_epoch("SECOND", "ts")
    return (
        raw(spark, sf_dir, "events")
        .groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(usable_minutes("ts")).alias("usable"),
            F.sum(F.minute("ts")).alias("minutes"),
            F.sum(minutes_between(day_start, F.col("ts"))).alias("since_midnight"),
            F.sum(minutes_between(F.col("ts"), day_start)).alias("to_midnight"),
            F.max(tomorrow).alias("tomorrow"),
            F.min(two_days_ago).alias("two_days_ago"),
            F.sum(seconds).alias("seconds"),
            F.max(F.month("ts")).alias("month"),
        )
    )


def f_week_sunday(spark, sf_dir):
    return (
        raw(spark, sf_dir, "orders")
        .groupBy(
            F.year("o_orderdate").alias("year"), week_of_year("o_orderdate").alias("week")
        )
        .agg(F.count(F.lit(1)).alias("orders"))
    )


def f_casts_concat(spark, sf_dir):
    key = F.col("o_custkey")
    padded = F.when(key < 10, F.concat(F.lit("0"), key.cast("string"))).otherwise(
        key.cast("string")
    )
    return (
        raw(spark, sf_dir, "orders")
        .groupBy(padded.alias("customer"))
        .agg(F.sum(F.col("o_orderkey").cast("string").cast("long")).alias("keys"))
    )


def f_split_offset(spark, sf_dir):
    documents = raw(spark, sf_dir, "documents")
    return documents.groupBy(
        "lang", nested_split("text", [("\n", 0), (" ", 1)]).alias("second_word")
    ).agg(F.count(F.lit(1)).alias("n"))


def f_case_coalesce(spark, sf_dir):
    status = (
        F.when(F.col("o_orderstatus") == "F", "done")
        .when(F.col("o_totalprice") > 200000, "large")
    )
    return (
        raw(spark, sf_dir, "orders")
        .groupBy(
            status.alias("status"), F.coalesce(status, F.lit("other")).alias("filled")
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def f_division(spark, sf_dir):
    return (
        raw(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey")
        .agg(
            F.count_if(F.col("l_returnflag") == "R").alias("returned"),
            F.count(F.lit(1)).alias("lines"),
        )
        .select(
            "l_suppkey",
            F.try_divide("returned", F.col("lines") - F.col("returned")).alias("odds"),
            (F.col("returned") / F.col("lines")).alias("share"),
            (F.col("returned") + F.col("lines")).alias("both"),
        )
    )


OPERATORS: dict[str, Query] = {
    build.__name__: build
    for build in (
        k01_day0_cohort,
        k02_first_return,
        k03_return_curve,
        k04_densify,
        k04_sparse_axis,
        k05_nested_split,
        k06_bucketize,
        k07_attribution,
        k08_transition_matrix,
        k09_join_metrics,
        k10_snapshot_as_of,
        k11_first_event,
        k12_stage_label,
        k13_cumulative_revenue,
        k14_device_funnel,
        k15_minutes_hist,
        k16_two_day_matrix,
        s01_stored_tables,
        s01_bucketed_tables,
        s_series,
        p_predicates,
        p_struct_access,
        j_inner_composite,
        j_left_composite,
        j_semi_in,
        j_theta_self,
        j_cross_grid,
        a_distinct_multi,
        a_conditional_distinct,
        a_having_hidden,
        a_group_alias,
        w_running_sum,
        w_row_number_nth,
        o_label_sort,
        f_time_functions,
        f_week_sunday,
        f_casts_concat,
        f_split_offset,
        f_case_coalesce,
        f_division,
    )
}


# --- the ten tables themselves -----------------------------------------------


def _table(name: str) -> Query:
    def build(spark, sf_dir):
        table = getattr(load(spark, sf_dir), name)
        if "_i_t" in table.columns:
            table = table.withColumn("_i_t", since_epoch("MICROSECOND", "_i_t"))
        if "campaign_data" in table.columns:
            table = table.withColumn("campaign_data", F.col("campaign_data.id_campaign"))
        return table

    return build


SOURCES: dict[str, Query] = {f"src_{name}": _table(name) for name in Tables.names()}


def queries() -> dict[str, Query]:
    def finished(build: Query) -> Query:
        return lambda spark, sf_dir: comparable(build(spark, sf_dir))

    def on_tables(report: Callable[[Tables], DataFrame]) -> Query:
        return lambda spark, sf_dir: report(load(spark, sf_dir))

    reports = {name: on_tables(report) for name, report in REPORTS.items()}
    everything = {**reports, **OPERATORS, **KEPT, **SOURCES}
    return {name: finished(build) for name, build in everything.items()}
