"""When users register and how soon they clear the first stage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayzero.constants import FIRST_STAGE, MINUTE_CAP
from dayzero.functions import epoch_to_date, next_midnight, time_range
from dayzero.functions.dates import DateLike, TimeLike
from dayzero.operators import day0_cohort, minutes_between_hist
from dayzero.sources.snapshot import snapshot_as_of
from dayzero.sources.tables import Tables


def _epoch_seconds(moment: dt.datetime | dt.date) -> int:
    if not isinstance(moment, dt.datetime):
        moment = dt.datetime.combine(moment, dt.time())
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=dt.timezone.utc)
    return int(moment.timestamp())


def daily_count_as_of(
    tables: Tables,
    first: dt.date = dt.date(2019, 8, 1),
    last: dt.date = dt.date(2019, 10, 21),
    as_of: dt.datetime | None = None,
    versioned: bool = False,
) -> DataFrame:
    """Conversions per UTC day from ``first`` through ``last``, seen ``as_of``
    (default: two days ago).  A conversion is there from its creation on, or,
    if the table is ``versioned``, from the version on that brought it.

    All bounds are epoch numbers, so the column is not converted to a time
    before it is compared; kept as BIGINT, they reach its scan.
    """
    seconds = F.col("created_at").cast("long")
    if as_of is None:
        moment = F.unix_timestamp() - F.lit(2 * 86400)
    else:
        moment = F.lit(_epoch_seconds(as_of))
    after_last = last + dt.timedelta(days=1)
    if versioned:
        seen_at = as_of or dt.datetime.now(dt.timezone.utc) - dt.timedelta(days=2)
        stamp = dt.datetime.fromtimestamp(_epoch_seconds(seen_at), dt.timezone.utc)
        seen = tables.as_of("adjust_conversion", f"{stamp:%Y-%m-%d %H:%M:%S}")
    else:
        seen = snapshot_as_of(tables.adjust_conversion, seconds, moment)
    return (
        seen.filter(seconds >= F.lit(_epoch_seconds(first)))
        .filter(seconds < F.lit(_epoch_seconds(after_last)))
        .groupBy(epoch_to_date(seconds).alias("datekey"))
        .agg(F.count(F.lit(1)).alias("cnt_2"))
        .orderBy("datekey")
    )


def register_time_distribution(
    tables: Tables, reg_to: DateLike = "2019-10-01", before: TimeLike = "2019-10-02"
) -> DataFrame:
    """Hour and minute at which users who did not enter had registered."""
    clocks = (
        tables.common_register.filter(time_range("_i_t", None, before))
        .select("nid", F.hour("_i_t").alias("Hour"), F.minute("_i_t").alias("min"))
        .distinct()
    )
    idle = day0_cohort(tables.f_max_campaign, "strict", reg_to=reg_to)
    return (
        clocks.join(idle, "nid", "left_semi")
        .groupBy("Hour", "min")
        .agg(F.count("nid").alias("UU"))
        .orderBy("Hour", "min")
    )


def minutes_to_stage_clear(
    tables: Tables,
    before: TimeLike = "2019-10-02",
    stage: int = FIRST_STAGE,
    cap: int = MINUTE_CAP,
) -> DataFrame:
    """Minutes from registration to the first clear of ``stage`` that day."""
    cleared = tables.pve_campaign_result.filter(
        (F.col("campaign_data.id_campaign") == stage)
        & (F.col("first_clear") == 1)
        & time_range("_i_t", None, next_midnight(before))
    )
    registered = tables.common_register.filter(time_range("_i_t", None, before))
    return minutes_between_hist(registered, cleared, cap)
