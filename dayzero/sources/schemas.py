"""Schemas of the ten input tables.  They are always given to the reader, so
loading a table never costs a pass that infers types."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


_LONG, _INT, _TEXT = T.LongType(), T.IntegerType(), T.StringType()
_DAY, _TIME, _REAL = T.DateType(), T.TimestampType(), T.DoubleType()

# Event logs.
LOGS: dict[str, T.StructType] = {
    "adjust_conversion": _schema(nid=_LONG, network_name=_TEXT, created_at=_TEXT),
    "common_register": _schema(nid=_LONG, _i_t=_TIME, dm=_TEXT, osv=_TEXT),
    "common_login": _schema(
        _id=_LONG, nid=_LONG, _i_t=_TIME, loading_time_ms=_LONG, dm=_TEXT, osv=_TEXT
    ),
    "common_installed": _schema(_id=_LONG, _i_t=_TIME, dm=_TEXT, osv=_TEXT),
    "common_gamemoney": _schema(nid=_LONG, _i_t=_TIME, rsn=_TEXT, add_rsn=_TEXT),
    "pve_campaign_result": _schema(
        nid=_LONG,
        _i_t=_TIME,
        campaign_data=_schema(id_campaign=_LONG),
        first_clear=_INT,
    ),
}

# Daily marts and dimensions.
MARTS: dict[str, T.StructType] = {
    "f_max_campaign": _schema(
        nid=_LONG, reg_datekey=_DAY, datekey=_DAY, id_campaign=_LONG, last_tutorial=_TEXT
    ),
    "f_pve_campaign_result": _schema(
        nid=_LONG, reg_datekey=_DAY, datekey=_DAY, id_campaign=_LONG
    ),
    "f_user_map": _schema(
        nid=_LONG,
        reg_datekey=_DAY,
        datekey=_DAY,
        date_diff_reg=_INT,
        network_name=_TEXT,
        reg_country=_TEXT,
        nru=_INT,
        daily_revenue=_REAL,
    ),
    "dim_osv_temp": _schema(model=_TEXT, dm=_TEXT, osv=_TEXT),
}

SCHEMAS = {**LOGS, **MARTS}
