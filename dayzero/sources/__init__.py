"""Input tables: schemas, loading, snapshots and the event-log adapter."""

from dayzero.sources.buckets import store_by_user
from dayzero.sources.folders import shared_folder
from dayzero.sources.history import HistoryFiles, StateFiles, holds_at, with_validity
from dayzero.sources.schemas import SCHEMAS
from dayzero.sources.snapshot import read_table_as_of, snapshot_as_of
from dayzero.sources.tables import Tables

__all__ = [
    "SCHEMAS",
    "HistoryFiles",
    "StateFiles",
    "Tables",
    "holds_at",
    "read_table_as_of",
    "shared_folder",
    "snapshot_as_of",
    "store_by_user",
    "with_validity",
]
