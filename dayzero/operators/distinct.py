"""Exact distinct-user counts that can be added up.

A distinct count per day cannot be added to one per week. A bitmap of users can:
users get dense numbers, a fold keeps one bitmap per group and range of 32,768
numbers, and coarser groups are the OR of finer ones. The fold is stored once and
answers every grouping of its attributes without reading the facts again. No group is
held whole by one task, as each range of numbers is a row of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Parts into which the users of one value of ``order`` are cut to be numbered.
PARTS = 64


def number_users(
    users: DataFrame, key: str = "nid", order: str | None = None, parts: int = PARTS
) -> DataFrame:
    """Distinct keys with the numbers 1, 2, ... (``user_no``), without a window over all of them.

    Users of one value of ``order`` (their registration day, say) have
    neighbouring numbers, so that groups by it need few bitmaps. Numbers are
    counted within parts of such a value; of these there is one folded row each,
    with the number of users before it.
    """
    by = F.lit(0) if order is None else F.col(order)
    known = users.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(by).alias("_order"))
    known = known.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)))
    within = F.row_number().over(W.partitionBy("_order", "_part").orderBy(key))
    known = known.withColumn("_nth", within.cast("long"))
    sizes = known.groupBy("_order", "_part").agg(F.count(F.lit(1)).alias("_size"))
    so_far = F.sum("_size").over(W.orderBy("_order", "_part")) - F.col("_size")
    sizes = sizes.select(
        F.col("_order").alias("_o"), F.col("_part").alias("_p"), so_far.alias("_before")
    )
    same = F.col("_order").eqNullSafe(F.col("_o")) & (F.col("_part") == F.col("_p"))
    numbered = known.join(sizes, same)
    return numbered.select(key, (F.col("_before") + F.col("_nth")).alias("user_no"))


def distinct_fold(
    facts: DataFrame,
    numbers: DataFrame,
    by: Sequence[str],
    key: str = "nid",
    among: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per group and range of user numbers, with a bitmap of the users.

    ``among`` names further bitmaps of the users who have a row that meets a
    condition; the bitmap of all users is ``users``. Facts are reduced to one
    row per group and user before they meet the numbers.
    """
    conditions = dict(among or {})
    rows = facts.groupBy(*by, key).agg(
        F.lit(1).alias("_one"), *[F.bool_or(c).alias(name) for name, c in conditions.items()]
    )
    rows = rows.join(numbers, key, "left")  # a group of rows without a key counts none
    place = F.bitmap_bit_position("user_no")

    def bitmap(name: str, met: Column) -> Column:
        return F.bitmap_construct_agg(F.when(met, place)).alias(name)

    maps = [bitmap("users", F.lit(True)), *[bitmap(n, F.col(n)) for n in conditions]]
    return rows.groupBy(*by, F.bitmap_bucket_number("user_no").alias("bucket")).agg(*maps)


def distinct_counts(fold: DataFrame, by: Sequence[str | Column], **counts: str) -> DataFrame:
    """Distinct users per group, from a fold of finer groups; ``counts`` gives
    the bitmap that each resulting column counts (``UU="users"``)."""
    groups = [F.col(c) if isinstance(c, str) else c for c in by]
    names = [fold.select(g).columns[0] for g in groups]
    maps = fold.select(
        *[g.alias(f"_g{i}") for i, g in enumerate(groups)], "bucket", *sorted(set(counts.values()))
    )
    keys = [f"_g{i}" for i in range(len(groups))]
    merged = maps.groupBy(*keys, "bucket").agg(
        *[F.bitmap_count(F.bitmap_or_agg(m)).alias(m) for m in sorted(set(counts.values()))]
    )
    totals = merged.groupBy(*keys).agg(*[F.sum(m).alias(name) for name, m in counts.items()])
    return totals.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *counts)
