"""The ten input tables as one bundle of lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from dayzero.sources.history import HistoryFiles
from dayzero.sources.schemas import LOGS, SCHEMAS
from dayzero.sources.snapshot import read_table_as_of

# Names of the zone whose days and hours the reports are about.
UTC = {"UTC", "Etc/UTC", "GMT", "Etc/GMT", "Z", "Zulu", "Etc/Zulu", "UCT", "+00:00"}


# Later than any commit of a history.
FAR_FUTURE = "9999-12-31"


def require_utc(spark: SparkSession) -> None:
    """Days, hours and minutes follow the session zone, so it has to be UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in UTC:
        raise ValueError(f"spark.sql.session.timeZone is {zone}: the reports need UTC")


class Tables:
    """Opens a table when it is first used, by its name: ``tables.common_login``.

    Raises ``ValueError`` when the session does not run in UTC.
    """

    adjust_conversion: DataFrame
    common_register: DataFrame
    common_login: DataFrame
    common_installed: DataFrame
    common_gamemoney: DataFrame
    pve_campaign_result: DataFrame
    f_max_campaign: DataFrame
    f_pve_campaign_result: DataFrame
    f_user_map: DataFrame
    dim_osv_temp: DataFrame

    def __init__(
        self,
        open_table: Callable[[str], DataFrame],
        open_as_of: Callable[[str, str], DataFrame] | None = None,
    ) -> None:
        self._open_table = open_table
        self._open_as_of = open_as_of

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        table = self._open_table(name)
        require_utc(table.sparkSession)
        setattr(self, name, table)
        return table

    def as_of(self, name: str, moment: str) -> DataFrame:
        """A table as it was at a moment, where its format keeps versions."""
        if name not in SCHEMAS:
            raise AttributeError(name)
        if self._open_as_of is None:
            raise ValueError("only catalog tables and histories can be opened as of a moment")
        return self._open_as_of(name, moment)

    @staticmethod
    def names() -> tuple[str, ...]:
        return tuple(SCHEMAS)

    @classmethod
    def from_files(
        cls,
        spark: SparkSession,
        root: str,
        fmt: str = "parquet",
        suffix: str = "",
        schemas: Mapping[str, StructType] | None = None,
        histories: Mapping[str, Sequence[str]] | None = None,
    ) -> Tables:
        """One file or folder per table below ``root``; ``schemas`` replaces
        those of single tables, as for a ``created_at`` kept as BIGINT.

        ``histories`` names the tables that are kept as ``HistoryFiles``, with
        their keys: these can be opened as of a moment, and else as they are now.
        """
        require_utc(spark)
        known = {**SCHEMAS, **(schemas or {})}
        kept = {
            name: HistoryFiles(spark, f"{root}/{name}{suffix}", known[name], keys)
            for name, keys in (histories or {}).items()
        }

        def open_table(name: str) -> DataFrame:
            if name in kept:
                return kept[name].as_of(FAR_FUTURE)
            return spark.read.schema(known[name]).format(fmt).load(f"{root}/{name}{suffix}")

        def open_as_of(name: str, moment: str) -> DataFrame:
            if name not in kept:
                raise ValueError(f"{name} is not kept as a history")
            return kept[name].as_of(moment)

        return cls(open_table, open_as_of if kept else None)

    @classmethod
    def from_catalog(
        cls,
        spark: SparkSession,
        logs: str,
        marts: str,
        renamed: Mapping[str, str] | None = None,
    ) -> Tables:
        """Catalog tables of two databases, one for the event logs and one for
        the marts; ``renamed`` gives full names for tables kept elsewhere."""
        names = {name: f"{logs if name in LOGS else marts}.{name}" for name in SCHEMAS}
        names.update(renamed or {})
        require_utc(spark)
        return cls(
            lambda name: spark.table(names[name]),
            lambda name, moment: read_table_as_of(spark, names[name], moment),
        )

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame]) -> Tables:
        return cls(frames.__getitem__)

    def register_views(self) -> None:
        """Offer the tables to ``spark.sql`` under their own names."""
        for name in self.names():
            getattr(self, name).createOrReplaceTempView(name)
