"""A join that survives keys owning a large part of the rows.

Adaptive execution splits large partitions of a join between two files, but not
those of a join whose other side is an aggregate by the join key, as the row per
key is here: splitting would break the partitioning that the aggregate gave it.
So hot keys are cut by hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that a single join task may get.
SLICE_ROWS = 4_000_000
# Keys that may be cut; the list of them is broadcast.
MAX_CUT_KEYS = 100_000


def join_per_key(
    facts: DataFrame,
    per_key: DataFrame,
    key: str,
    row_id: str,
    n_rows: str,
    slice_rows: int = SLICE_ROWS,
    total_rows: int | None = None,
) -> DataFrame:
    """Inner join of a large log with one row per key.

    ``per_key`` also says how many rows each key has in ``facts`` (``n_rows``,
    dropped from the result).  A key with more than ``slice_rows`` is cut into
    slices: its rows are spread by ``row_id`` and its one ``per_key`` row is
    repeated once per slice.  All other keys have a single slice.

    The list of cut keys is broadcast.  A slice is at least the
    ``MAX_CUT_KEYS``-th part of all rows, and a cut key has more rows than a
    slice, so the list never has more than ``MAX_CUT_KEYS`` entries of two
    numbers.  ``total_rows`` are the rows that ``n_rows`` adds up to, by default
    those of ``facts``, which are then counted; of a file format with counts in
    its footers only those are read.
    """
    total_rows = facts.count() if total_rows is None else total_rows
    slice_rows = max(slice_rows, -(-total_rows // MAX_CUT_KEYS))
    sliced = per_key.withColumn("_slices", F.ceil(F.col(n_rows) / slice_rows))
    cut = sliced.filter(F.col("_slices") > 1).select(key, "_slices")
    spread = facts.join(F.broadcast(cut), key, "left").withColumn(
        "_slice",
        F.coalesce(F.pmod(F.xxhash64(row_id), F.col("_slices")), F.lit(0)),
    )
    repeated = sliced.withColumn(
        "_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1))
    )
    return spread.drop("_slices").join(
        repeated.drop("_slices", n_rows), [key, "_slice"]
    ).drop("_slice")
