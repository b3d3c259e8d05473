"""Reading a table as it was at an earlier moment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def snapshot_as_of(
    df: DataFrame,
    version: str | Column,
    as_of: Column,
    keys: Sequence[str] = (),
    tie_breakers: Sequence[str] = (),
) -> DataFrame:
    """Rows whose ``version`` is not after ``as_of``.  With ``keys``, only the
    newest such row of each key (``tie_breakers`` decide equal versions).

    The newest row is a rank-1 filter, which Spark also applies before the
    shuffle, so each task sends at most one row per key it holds.
    """
    version = F.col(version) if isinstance(version, str) else version
    seen = df.filter(version <= as_of)
    if not keys:
        return seen
    newest_first = W.partitionBy(*keys).orderBy(
        version.desc(), *[F.desc(name) for name in tie_breakers]
    )
    return (
        seen.withColumn("_rank", F.row_number().over(newest_first))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def read_table_as_of(spark: SparkSession, table: str, as_of: str) -> DataFrame:
    """Snapshot of a catalog table whose format keeps versions itself; Spark
    raises an error for formats that do not, such as plain Parquet."""
    return spark.read.option("timestampAsOf", as_of).table(table)
