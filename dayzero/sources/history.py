"""Versions of a table on plain files: rows with the time from and until which they hold.

Every commit writes one folder. It holds the rows that are open after it, and
apart from them the rows that it closed. A row is closed once, so the closed rows
of all commits and the open rows of the last one are the whole history, and the
table as it was at a moment is a filter on that: open rows that had begun by then, and rows
that began by then and were closed by a later commit. Folders of earlier commits
are skipped by their number, so a recent moment reads the table and little more.

    rows/commit=<n>/is_open=<true|false>/   the rows, with valid_from and valid_to
    commits/commit=<n>/                     one row, written last: the moment

A commit counts from the moment its last folder is complete; what a failed one left is
written over by the next. There may be one writer at a time and any readers.
Open rows of earlier commits are not read again and may be deleted.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from dayzero.functions.dates import TimeLike, as_timestamp

BOUNDS = "valid_from timestamp_ntz, valid_to timestamp_ntz"


def with_validity(
    versions: DataFrame, keys: Sequence[str], version: str, tie_breakers: Sequence[str] = ()
) -> DataFrame:
    """A log of versions with ``valid_from`` and ``valid_to`` (NULL: still valid).

    Of versions of one key and time only the last by ``tie_breakers`` ever held.
    """
    in_order = W.partitionBy(*keys).orderBy(version, *tie_breakers)
    until = F.lead(version).over(in_order)
    bounded = versions.withColumns({"valid_from": F.col(version), "valid_to": until})
    return bounded.filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))


def holds_at(moment: Column) -> Column:
    """Rows that hold at a moment."""
    begun = F.col("valid_from") <= moment
    return begun & (F.col("valid_to").isNull() | (F.col("valid_to") > moment))


class CommitLog:
    """Numbers and moments of the commits below a folder.

    A commit is one row in a folder of its own, written after all it stands for.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.path = spark, f"{root.rstrip('/')}/commits"

    def all(self) -> list[tuple[int, dt.datetime]]:
        """All commits in order; none where the folder does not exist yet."""
        try:
            listed = self.spark.read.schema("commit int, moment timestamp_ntz").parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted((row["commit"], row["moment"]) for row in listed.collect())

    def next(self, moment: TimeLike) -> tuple[int, dt.datetime]:
        """Number and moment of the commit to come, which has to be later than the last."""
        at = dt.datetime.fromisoformat(str(moment))
        commits = self.all()
        if commits and at <= commits[-1][1]:
            raise ValueError(f"the last commit is of {commits[-1][1]}, not before {at}")
        return (commits[-1][0] if commits else 0) + 1, at

    def add(self, number: int, at: dt.datetime) -> None:
        made = self.spark.range(1).select(as_timestamp(at).alias("moment"))
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commit={number}")


class HistoryFiles:
    """A table with one row per key whose earlier states can be read.

    ``schema`` is that of the table, ``keys`` the columns that name a row; they
    may be NULL and then are a key of their own.
    """

    def __init__(
        self, spark: SparkSession, root: str, schema: T.StructType | str, keys: Sequence[str]
    ) -> None:
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.payload = [name for name in self.schema.names if name not in self.keys]
        self.log = CommitLog(spark, root)

    def _rows(self) -> DataFrame:
        bounds = T.StructType.fromDDL(f"{BOUNDS}, commit int, is_open boolean")
        schema = T.StructType([*self.schema, *bounds])
        return self.spark.read.schema(schema).parquet(f"{self.root}/rows")

    def _known(self, through: int, after: int = 0) -> DataFrame:
        """Rows of the history as of commit ``through`` that were not closed by commit ``after``."""
        is_last = F.col("is_open") & (F.col("commit") == through)
        closed = ~F.col("is_open") & (F.col("commit") <= through) & (F.col("commit") > after)
        return self._rows().filter(is_last | closed).drop("commit", "is_open")

    def _nothing(self, schema: T.StructType) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def history(self) -> DataFrame:
        """All rows there ever were, with ``valid_from`` and ``valid_to``."""
        commits = self.log.all()
        if not commits:
            return self._nothing(T.StructType([*self.schema, *T.StructType.fromDDL(BOUNDS)]))
        return self._known(commits[-1][0])

    def as_of(self, moment: TimeLike) -> DataFrame:
        """The table as it was at a moment; empty before the first commit."""
        at = dt.datetime.fromisoformat(str(moment))
        commits = self.log.all()
        seen = [number for number, made in commits if made <= at]
        if not seen:
            return self._nothing(self.schema)
        known = self._known(commits[-1][0], after=seen[-1])
        return known.filter(holds_at(as_timestamp(at))).select(*self.schema.names)

    def commit(
        self,
        rows: DataFrame,
        moment: TimeLike,
        complete: bool = False,
        deleted: DataFrame | None = None,
    ) -> int:
        """Merge new and changed rows; returns the commit's number.

        With ``complete``, keys that ``rows`` lacks are closed, else only those
        that ``deleted`` names. Rows as they already were stay open unchanged.
        Raises ``ValueError`` where a key occurs twice or the moment is not after
        that of the last commit.
        """
        number, at = self.log.next(moment)
        typed = [F.col(field.name).cast(field.dataType) for field in self.schema]
        rows = rows.select(*typed)
        if rows.groupBy(*self.keys).count().filter("count > 1").limit(1).count():
            raise ValueError(f"rows to commit must have one row per {self.keys}")
        merged = self._merged(rows, number - 1, at, complete, deleted)
        merged.write.partitionBy("is_open").mode("overwrite").parquet(
            f"{self.root}/rows/commit={number}"
        )
        self.log.add(number, at)
        return number

    def _merged(
        self,
        rows: DataFrame,
        last: int,
        at: dt.datetime,
        complete: bool,
        deleted: DataFrame | None,
    ) -> DataFrame:
        """Open rows after the commit and rows that it closes, told apart by ``is_open``."""
        columns = self.schema.names
        none = F.lit(None).cast("timestamp_ntz")
        given = rows.select(F.struct(*columns).alias("new"), *self._key_columns("n"))
        if not last:
            opened = given.select("new.*", as_timestamp(at).alias("valid_from"), none.alias("valid_to"))
            return opened.withColumn("is_open", F.lit(True))
        held = self._rows().filter(F.col("is_open") & (F.col("commit") == last))
        held = held.select(F.struct(*columns, "valid_from").alias("old"), *self._key_columns("o"))
        both = held.join(given, self._same_key("o", "n"), "full")
        gone = F.lit(complete) & F.col("new").isNull()
        if deleted is not None:
            names = deleted.select(*self._key_columns("d")).distinct().withColumn("is_deleted", F.lit(True))
            both = both.join(names, self._same_key("o", "d"), "left")
            gone = gone | (F.col("is_deleted").isNotNull() & F.col("new").isNull())
        same = F.lit(True)
        for name in self.payload:
            same = same & F.col(f"old.{name}").eqNullSafe(F.col(f"new.{name}"))
        replaced = F.col("new").isNotNull() & ~same
        ends = F.col("old").isNotNull() & (gone | replaced)
        old = [F.col(f"old.{name}").alias(name) for name in columns]
        kept = F.struct(
            *old,
            F.col("old.valid_from").alias("valid_from"),
            F.when(ends, as_timestamp(at)).otherwise(none).alias("valid_to"),
            (~ends).alias("is_open"),
        )
        begun = F.struct(
            *[F.col(f"new.{name}").alias(name) for name in columns],
            as_timestamp(at).alias("valid_from"),
            none.alias("valid_to"),
            F.lit(True).alias("is_open"),
        )
        begins = F.col("new").isNotNull() & (F.col("old").isNull() | replaced)
        states = F.array_compact(
            F.array(F.when(F.col("old").isNotNull(), kept), F.when(begins, begun))
        )
        return both.select(F.explode(states).alias("state")).select("state.*")

    def _key_columns(self, prefix: str) -> list[Column]:
        return [F.col(key).alias(f"{prefix}_key_{i}") for i, key in enumerate(self.keys)]

    def _same_key(self, left: str, right: str) -> Column:
        same = F.lit(True)
        for i in range(len(self.keys)):
            same = same & F.col(f"{left}_key_{i}").eqNullSafe(F.col(f"{right}_key_{i}"))
        return same


class StateFiles:
    """A table that each commit replaces by a merged one, such as ``return_state``.

    Only the last commit is read; those before it may be deleted.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, root)

    def read(self) -> DataFrame | None:
        """The state after the last commit; None before the first."""
        commits = self.log.all()
        if not commits:
            return None
        return self.spark.read.parquet(f"{self.root}/state/commit={commits[-1][0]}")

    def advance(
        self, new: DataFrame, moment: TimeLike, merge: Callable[[DataFrame, DataFrame], DataFrame]
    ) -> DataFrame:
        """Merge the state of new rows into the stored one; returns what is stored now."""
        number, at = self.log.next(moment)
        before = self.read()
        after = new if before is None else merge(before, new)
        after.write.mode("overwrite").parquet(f"{self.root}/state/commit={number}")
        self.log.add(number, at)
        return self.read()
