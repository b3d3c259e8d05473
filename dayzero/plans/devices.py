"""Countries, loading times and devices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayzero.constants import COUNTRIES, OTHER_COUNTRY
from dayzero.functions import date_range
from dayzero.functions.dates import DateLike, TimeLike
from dayzero.operators import day0_cohort, device_funnel, first_event, likely_members
from dayzero.operators.cohorts import in_cohort
from dayzero.operators.loading import loading_bucket
from dayzero.sources.tables import Tables


def country_month(tables: Tables) -> DataFrame:
    """Per country and month of registration: users without a tutorial on day 0
    and registered users.  The month of the former is that of their progress
    row; an unknown country has no registered users beside it.

    Each joined user counts in up to two months, so it becomes a row for each.
    """
    new = (
        tables.f_user_map.filter(F.col("nru") == 1)
        .select("nid", "reg_country", F.month("reg_datekey").alias("new_mon"))
        .distinct()
    )
    idle = (
        tables.f_max_campaign.filter(in_cohort("loose"))
        .select("nid", F.month("reg_datekey").alias("idle_mon"))
        .distinct()
    )
    counted_in = F.array(
        F.struct(F.col("new_mon").alias("reg_mon"), F.lit(True).alias("is_new")),
        F.struct(F.col("idle_mon").alias("reg_mon"), F.lit(False).alias("is_new")),
    )
    users = (
        new.join(idle, "nid", "left")
        .select("nid", "reg_country", F.inline(counted_in))
        .groupBy("nid", "reg_country", "reg_mon")
        .agg(F.bool_or("is_new").alias("is_new"), F.bool_and("is_new").alias("only_new"))
    )
    known = F.col("reg_country").isNotNull()
    months = users.groupBy("reg_country", "reg_mon").agg(
        F.count_if(~F.col("only_new")).alias("not_enter_UU"),
        F.count(F.when(F.col("is_new"), F.col("nid"))).alias("new_users"),
        F.bool_or("is_new").alias("any_new"),
    )
    return months.filter(F.col("reg_mon").isNotNull() & (F.col("not_enter_UU") > 0)).select(
        "reg_country",
        "reg_mon",
        "not_enter_UU",
        F.when(known & F.col("any_new"), F.col("new_users")).alias("reg_UU"),
    )


def first_login_loading(
    tables: Tables,
    kind: str,
    reg_from: DateLike = "2019-09-11",
    countries: Sequence[str] | None = COUNTRIES,
    other: str = OTHER_COUNTRY,
    member_bits: int | None = None,
) -> DataFrame:
    """Cohort users by the loading time of their first login and, unless
    ``countries`` is None, by country (``other`` for any not listed).

    ``member_bits`` reads the cohort once more to drop other users' logins
    before they are folded; worth it where the cohort is a small part of the log.
    """
    cohort = day0_cohort(tables.f_max_campaign, kind, reg_from=reg_from)
    logins = tables.common_login
    if member_bits is not None:
        logins = likely_members(logins, cohort, "nid", member_bits)
    first = first_event(logins, "nid", ["_i_t", "_id"], ["loading_time_ms"])
    users = first.join(cohort, "nid", "left_semi").select(
        "nid", loading_bucket(F.col("loading_time_ms") / 1000).alias("loading_time_ms")
    )
    keys = ["loading_time_ms"]
    if countries is not None:
        located = (
            tables.f_user_map.filter(
                (F.col("nru") == 1)
                & F.col("reg_country").isin(*countries)
                & date_range("reg_datekey", reg_from)
            )
            .select("nid", "reg_country")
            .distinct()
        )
        users = users.join(located, "nid", "left").withColumn(
            "reg_country", F.coalesce("reg_country", F.lit(other))
        )
        keys.append("reg_country")
    return users.groupBy(*keys).agg(F.count("nid").alias("UU"))


def install_to_login(tables: Tables, before: TimeLike = "2019-10-10") -> DataFrame:
    """Installs, registrations and logins by device model."""
    return device_funnel(
        tables.dim_osv_temp,
        tables.common_installed,
        tables.common_register,
        tables.common_login,
        before,
    )
