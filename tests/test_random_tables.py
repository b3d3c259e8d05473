"""The reports on irregular random tables: NULL keys, repeated rows, users with
several registration days, unreadable payloads.  The SQL side repeats and joins
rows plainly, so it also checks the counting shortcuts of the Spark side."""

from __future__ import annotations

import datetime as dt
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from checks import oracle
from checks.compare import difference
from checks.registry import REPORTS, comparable
from dayzero.constants import REVENUE_CHANNELS
from dayzero.sources import Tables

TIME = pa.timestamp("us")
ZONED = pa.timestamp("us", tz="UTC")
COLUMN_TYPES = {
    "nid": pa.int64(), "_id": pa.int64(), "id_campaign": pa.int64(),
    "loading_time_ms": pa.int64(), "date_diff_reg": pa.int32(), "nru": pa.int32(),
    "first_clear": pa.int32(), "daily_revenue": pa.float64(), "_i_t": TIME,
    "reg_datekey": pa.date32(), "datekey": pa.date32(),
    "campaign_data": pa.struct([("id_campaign", pa.int64())]),
}


def random_tables(seed: int) -> dict[str, pa.Table]:
    pick = random.Random(seed)
    users = [None, *range(1, 16)]
    stages = [0, 0, 0, 11001, 11201, 11001, 12201, 12401]
    channels = [None, "Nontracking-Organic", "non-tracking-organic", "Organic", "QooApp"]

    def day(last=12):
        return dt.date(2024, 1, pick.randint(1, last))

    def moment():
        minute = pick.choice([0, 1, 2, 53, 54, 55, 59])
        return dt.datetime(2024, 1, pick.randint(1, 10), pick.choice([0, 9, 10, 23]),
                           minute, pick.randint(0, 59), pick.randint(0, 999999))

    def user_day():
        registered = day(9)
        later = pick.choice([0, 0, 0, 1, 1, 2, 3, 8, 17, -1])
        return dict(nid=pick.choice(users), reg_datekey=registered,
                    datekey=registered + dt.timedelta(days=later))

    def device():
        return dict(dm=pick.choice([None, "a", "b"]), osv=pick.choice(["x", "y"]))

    def payload():
        return pick.choice(
            ["UNDEFINED", None, "a", "a,xx;y", "v,;1", "v,-5;1", "v,-250000;2", "v,1.5;1"]
            + [f"v,{pick.randint(0, 1_200_000)};{pick.randint(0, 9)}" for _ in range(8)]
        )

    def user_map_row():
        row = user_day()
        age = (row["datekey"] - row["reg_datekey"]).days
        return row | dict(
            date_diff_reg=age,
            network_name=pick.choice([*channels, *REVENUE_CHANNELS[:3]]),
            reg_country=pick.choice([None, "KR", "US", "JP"]),
            nru=pick.choice([int(age == 0), 1, 0, None]),
            daily_revenue=pick.choice([None, round(pick.uniform(0, 90), 2)]),
        )

    makers = {
        "adjust_conversion": lambda: dict(
            nid=pick.choice(users),
            network_name=pick.choice(channels),
            created_at=str(int(moment().replace(tzinfo=dt.timezone.utc).timestamp())),
        ),
        "common_register": lambda: dict(nid=pick.choice(users), _i_t=moment()) | device(),
        "common_login": lambda: dict(
            _id=pick.randint(1, 60),
            nid=pick.choice(users),
            _i_t=moment(),
            loading_time_ms=pick.choice([None, -700, -1, pick.randint(0, 1_000_000)]),
        )
        | device(),
        "common_installed": lambda: dict(_id=pick.randint(1, 30), _i_t=moment()) | device(),
        "common_gamemoney": lambda: dict(
            nid=pick.choice(users),
            _i_t=moment(),
            rsn=pick.choice(["session/login", "partner/login", "other"]),
            add_rsn=payload(),
        ),
        "pve_campaign_result": lambda: dict(
            nid=pick.choice(users),
            _i_t=moment(),
            campaign_data=dict(id_campaign=pick.choice([11001, 11201, None])),
            first_clear=pick.choice([0, 1]),
        ),
        "f_max_campaign": lambda: user_day()
        | dict(
            id_campaign=pick.choice([*stages, None]),
            last_tutorial=pick.choice(["tutorial not enter"] * 3 + ["tutorial clear", None]),
        ),
        "f_pve_campaign_result": lambda: user_day()
        | dict(id_campaign=pick.choice([None, *stages[3:]])),
        "f_user_map": user_map_row,
        "dim_osv_temp": lambda: dict(model=pick.choice(["m1", "m2"])) | device(),
    }
    sizes = {"common_gamemoney": 400, "f_max_campaign": 120, "f_user_map": 150,
             "f_pve_campaign_result": 150, "dim_osv_temp": 5}
    tables = {}
    for name, make in makers.items():
        made = [make() for _ in range(sizes.get(name, 60))]
        schema = pa.schema([(c, COLUMN_TYPES.get(c, pa.string())) for c in made[0]])
        tables[name] = pa.Table.from_pylist(made, schema)
    return tables


@pytest.fixture(scope="module", params=[1, 2, 3])
def engines(request, spark, tmp_path_factory):
    root = tmp_path_factory.mktemp(f"random{request.param}")
    db = duckdb.connect()
    for name, table in random_tables(request.param).items():
        db.register("arrow_rows", table)
        db.execute(f"CREATE TABLE {name} AS FROM arrow_rows")
        zoned = pa.schema(
            [field.with_type(ZONED) if field.type == TIME else field for field in table.schema]
        )
        pq.write_table(table.cast(zoned), root / f"{name}.parquet")
    return Tables.from_files(spark, str(root), suffix=".parquet"), db


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_report(engines, name):
    tables, db = engines
    sql = f"WITH {oracle.FIRST_DAY} {oracle.ON_TABLES[name]}"
    assert difference(comparable(REPORTS[name](tables)), db, sql) is None
