"""Install, registration and login counts by device."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayzero.functions.dates import TimeLike, time_range
from dayzero.operators.metrics import join_metrics

DEVICE = ["dm", "osv"]


def device_funnel(
    devices: DataFrame,
    installs: DataFrame,
    registers: DataFrame,
    logins: DataFrame,
    before: TimeLike | None = None,
) -> DataFrame:
    """Per model: installs, registered users and logged-in users.  Devices with
    a single login event do not count as logged in."""
    early = time_range("_i_t", None, before)
    installed = (
        installs.filter(early)
        .groupBy(*DEVICE)
        .agg(F.count_distinct("_id").alias("install_cnt"))
    )
    registered = (
        registers.filter(early)
        .groupBy(*DEVICE)
        .agg(F.count_distinct("nid").alias("register_cnt"))
    )
    # More than one event number means the smallest is not the largest; this
    # spares a second distinct count, which would double the rows of the log.
    logged_in = (
        logins.filter(early)
        .groupBy(*DEVICE)
        .agg(
            F.count_distinct("nid").alias("login_UU"),
            F.min("_id").alias("first_id"),
            F.max("_id").alias("last_id"),
        )
        .filter(F.col("first_id") < F.col("last_id"))
        .drop("first_id", "last_id")
    )
    counts = join_metrics(
        devices, [(installed, DEVICE), (registered, DEVICE), (logged_in, DEVICE)]
    )
    return counts.groupBy("model").agg(
        F.sum("install_cnt").alias("install_cnt"),
        F.sum("register_cnt").alias("register_cnt"),
        F.sum("login_UU").alias("login_UU"),
    )
