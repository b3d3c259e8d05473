"""Marts stored by user, so that joins and counts per user need no shuffle.

A bucketed table is dealt by the user's number when it is written. Aggregates by user, by
user and anything else, and joins on the user between tables of equal
numbers of buckets then read one bucket of each side per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from dayzero.sources.schemas import MARTS
from dayzero.sources.tables import Tables

USER = "nid"
#: Tables with a few rows per user and day. A raw log has users with any number
#: of rows, which a bucket could not split.
BY_USER = tuple(name for name, schema in MARTS.items() if USER in schema.names)
# Joins on the user and a day may then use the dealing by the user alone.
BUCKET_SETTING = "spark.sql.requireAllClusterKeysForCoPartition"


def store_by_user(
    tables: Tables,
    database: str,
    path: str,
    buckets: int,
    names: Sequence[str] = BY_USER,
) -> Tables:
    """Write tables as catalog tables of ``database`` below ``path``, bucketed and
    sorted by user; returns all tables, with these in place of the old ones.

    Choose ``buckets`` so that one of the largest table is 128 MB to 1 GB. The
    session should set ``spark.sql.requireAllClusterKeysForCoPartition`` to
    false, as ``build_session`` does.
    """
    stored = {}
    for name in names:
        table = getattr(tables, name)
        spark = table.sparkSession
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        dealt = table.repartition(buckets, USER).write.bucketBy(buckets, USER).sortBy(USER)
        dealt.option("path", f"{path.rstrip('/')}/{name}").saveAsTable(f"{database}.{name}")
        stored[name] = spark.table(f"{database}.{name}")

    def open_table(name: str):
        return stored[name] if name in stored else getattr(tables, name)

    return Tables(open_table)
