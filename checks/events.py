"""The ten input tables, derived from one raw ``events`` log by made-up rules.

A user is registered by their first ``signup`` event and every table holds the
events from that moment on.  All rules are column expressions; rows are only
joined to the user's signup, see ``events_since_signup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from dayzero.constants import COUNTRIES, DEFAULT_CHANNEL, NO_PAYLOAD, NOT_ENTERED
from dayzero.functions import days_between
from dayzero.operators.first_event import time_order
from dayzero.operators.skew import SLICE_ROWS, join_per_key
from dayzero.sources.tables import Tables

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

CLEARED = "tutorial clear"
PARTNER_LOGIN = "partner/login"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def tables_from_events(events: DataFrame, slice_rows: int = SLICE_ROWS) -> Tables:
    """Tables of a log, whose rows are counted once for the hot-user join."""
    # The number is taken out of its text before anything is shuffled.
    events = events.withColumn("k", _number("props")).drop("props")
    signups = signups_of(events)
    kept = events_since_signup(events, slice_rows)
    rules = {
        "adjust_conversion": (_adjust_conversion, signups),
        "common_register": (_common_register, signups),
        "common_login": (_common_login, kept),
        "common_installed": (_common_installed, events),
        "common_gamemoney": (_common_gamemoney, kept),
        "pve_campaign_result": (_pve_campaign_result, events, slice_rows),
        "f_max_campaign": (_f_max_campaign, events, signups),
        "f_pve_campaign_result": (_f_pve_campaign_result, kept),
        "f_user_map": (_f_user_map, kept),
        "dim_osv_temp": (_dim_osv_temp, events),
    }

    def open_table(name: str) -> DataFrame:
        rule, *sources = rules[name]
        return rule(*sources)

    return Tables(open_table)


def signups_of(events: DataFrame) -> DataFrame:
    """First signup of each registered user."""
    signups = events.filter(_is("signup"))
    return signups.groupBy("user_id").agg(F.min("ts").alias("reg_ts"))


def events_since_signup(events: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Events of registered users from their signup on, with the signup time.

    One user may own a large part of the log, so users with many events are
    spread over several join slices.
    """
    return _since_signup(events, _users(events), slice_rows, events.count())


def _users(events: DataFrame) -> DataFrame:
    """Registered users: first signup and number of events."""
    users = events.groupBy("user_id").agg(
        F.min(F.when(_is("signup"), F.col("ts"))).alias("reg_ts"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    return users.filter(F.col("reg_ts").isNotNull())


def _since_signup(
    events: DataFrame, users: DataFrame, slice_rows: int, total_rows: int
) -> DataFrame:
    joined = join_per_key(
        events,
        users,
        key="user_id",
        row_id="event_id",
        n_rows="n_rows",
        slice_rows=slice_rows,
        total_rows=total_rows,
    )
    return joined.filter(F.col("ts") >= F.col("reg_ts"))


def _every(divisor: int, name: str) -> Column:
    return F.col(name) % divisor == 0


def _number(text: str) -> Column:
    return F.regexp_extract(text, r"(\d+)", 1).cast("long")


def _stage() -> Column:
    return F.lit(11001) + (F.col("k") % 8) * 200


def _millis() -> Column:
    return F.floor(F.col("value") * 10000)


def _is(*event_types: str) -> Column:
    return F.col("event_type").isin(*event_types)


def _device() -> list[Column]:
    return [
        F.concat(F.lit("DM"), F.col("user_id") % 7).alias("dm"),
        F.concat(F.lit("OS"), F.col("user_id") % 3).alias("osv"),
    ]


def _days() -> list[Column]:
    return [
        F.col("user_id").alias("nid"),
        F.to_date("reg_ts").alias("reg_datekey"),
        F.to_date("ts").alias("datekey"),
    ]


def _network() -> Column:
    """By user number; the fifth is spelled like the default channel."""
    names = ["Organic", "Facebook Installs", "Google Organic Search"]
    names += [DEFAULT_CHANNEL, "QooApp"]
    listed = F.array(F.lit(None), *[F.lit(name) for name in names])
    return F.get(listed, (F.col("user_id") % 6).cast("int"))


def _country() -> Column:
    listed = F.array(*[F.lit(name) for name in (*COUNTRIES, "JP", None)])
    return F.get(listed, (F.col("user_id") % 11).cast("int"))


def _common_register(signups: DataFrame) -> DataFrame:
    """Some users are logged twice."""
    copies = F.when(_every(50, "user_id"), 2).otherwise(1)
    return signups.select(
        F.col("user_id").alias("nid"),
        F.col("reg_ts").alias("_i_t"),
        *_device(),
        F.explode(F.sequence(F.lit(1), copies)).alias("copy"),
    ).drop("copy")


def _common_login(kept: DataFrame) -> DataFrame:
    return kept.filter(_is("click", "view")).select(
        F.col("event_id").alias("_id"),
        F.col("user_id").alias("nid"),
        F.col("ts").alias("_i_t"),
        F.when(~_every(13, "event_id"), _millis()).alias("loading_time_ms"),
        *_device(),
    )


def _common_installed(events: DataFrame) -> DataFrame:
    model, version = _device()
    return events.filter(_is("signup")).select(
        F.col("event_id").alias("_id"),
        F.col("ts").alias("_i_t"),
        F.when(~_every(17, "event_id"), model).alias("dm"),
        version,
    )


def _common_gamemoney(kept: DataFrame) -> DataFrame:
    payload = F.concat(F.lit("v,"), _millis(), F.lit(";"), F.col("k"))
    return kept.select(
        F.col("user_id").alias("nid"),
        F.col("ts").alias("_i_t"),
        F.when(_is("click"), "session/login")
        .when(_is("view"), PARTNER_LOGIN)
        .otherwise("other")
        .alias("rsn"),
        F.when(_every(11, "event_id"), NO_PAYLOAD).otherwise(payload).alias("add_rsn"),
    )


def _pve_campaign_result(events: DataFrame, slice_rows: int) -> DataFrame:
    """The earliest play of each user and stage is its first clear.  The first
    plays are an aggregate, become a map in the user's row (one entry per
    stage) and are compared in the join that brings the signup.  Both joins
    read the same shuffle of the plays."""
    users, n_rows = _users(events), events.count()
    plays = events.filter(_is("purchase")).select(
        "event_id", "ts", "user_id", _stage().alias("id_campaign")
    )
    firsts = (
        _since_signup(plays, users, slice_rows, n_rows)
        .groupBy("user_id", "id_campaign")
        .agg(F.min_by("event_id", time_order("ts", "event_id")).alias("first"))
        .groupBy("user_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("id_campaign", "first"))).alias("firsts"))
    )
    known = users.join(firsts, "user_id", "left")
    marked = _since_signup(plays, known, slice_rows, n_rows)
    cleared = F.try_element_at("firsts", F.col("id_campaign")) == F.col("event_id")
    return marked.select(
        F.col("user_id").alias("nid"),
        F.col("ts").alias("_i_t"),
        F.struct("id_campaign").alias("campaign_data"),
        F.when(cleared, 1).otherwise(0).alias("first_clear"),
    )


def _f_max_campaign(events: DataFrame, signups: DataFrame) -> DataFrame:
    """Per active day of a user: the highest stage played up to that day.

    A stage counts on a day if its last play there is not before the signup, so
    the log is folded to users, days and stages before it meets the signups.
    Join, day rows and window then share one shuffle by user.
    """
    stage = F.when(_is("purchase"), _stage()).alias("stage")
    played = events.groupBy("user_id", F.to_date("ts").alias("datekey"), stage).agg(
        F.max("ts").alias("last_ts")
    )
    daily = (
        played.join(signups, "user_id")
        .filter(F.col("last_ts") >= F.col("reg_ts"))
        .groupBy(
            F.col("user_id").alias("nid"),
            F.to_date("reg_ts").alias("reg_datekey"),
            "datekey",
        )
        .agg(F.max("stage").alias("stage"))
    )
    so_far = W.partitionBy("nid").orderBy("datekey").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    reached = daily.withColumn(
        "id_campaign", F.coalesce(F.max("stage").over(so_far), F.lit(0))
    )
    return reached.select(
        "nid",
        "reg_datekey",
        "datekey",
        "id_campaign",
        F.when(F.col("id_campaign") == 0, NOT_ENTERED)
        .otherwise(CLEARED)
        .alias("last_tutorial"),
    )


def _f_pve_campaign_result(kept: DataFrame) -> DataFrame:
    return kept.filter(_is("purchase")).select(
        *_days(),
        F.when(~_every(19, "event_id"), _stage()).alias("id_campaign"),
    )


def _f_user_map(kept: DataFrame) -> DataFrame:
    daily = kept.groupBy("user_id", *_days()).agg(
        F.sum(F.when(_is("purchase"), F.col("value"))).alias("daily_revenue")
    )
    return daily.select(
        "nid",
        "reg_datekey",
        "datekey",
        days_between("reg_datekey", "datekey").alias("date_diff_reg"),
        _network().alias("network_name"),
        _country().alias("reg_country"),
        F.when(F.col("datekey") == F.col("reg_datekey"), 1).otherwise(0).alias("nru"),
        "daily_revenue",
    )


def _adjust_conversion(signups: DataFrame) -> DataFrame:
    """One conversion per user, or two channels, or (one user in five) none."""
    second = F.when(_every(9, "user_id"), F.array(_network(), F.lit("Brandpage")))
    epoch = F.to_timestamp_ntz(F.lit("1970-01-01"))
    return signups.filter(~_every(5, "user_id")).select(
        F.col("user_id").alias("nid"),
        F.explode(second.otherwise(F.array(_network()))).alias("network_name"),
        F.timestamp_diff("SECOND", epoch, F.col("reg_ts"))
        .cast("string")
        .alias("created_at"),
    )


def _dim_osv_temp(events: DataFrame) -> DataFrame:
    model = F.concat(F.lit("MODEL"), F.col("user_id") % 7 % 4).alias("model")
    return events.select(model, *_device()).distinct()
