"""Ordered work within a key that may own a large part of all rows.

A window over such a key is one task. Here the rows of every key are cut into blocks
along the order, at quantiles of all rows, so a key with very many rows is cut into as many
blocks. What earlier blocks leave behind (a sum, the last value) comes from
one folded row per key and block, and each block continues from there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCKS = 64


def block_bounds(df: DataFrame, order: str, blocks: int = BLOCKS) -> list:
    """Ascending values of ``order`` that cut the rows into about equal blocks.

    The values are approximate quantiles, found in one aggregate; which ones
    they are changes the blocks and not the results.
    """
    shares = [i / blocks for i in range(1, blocks)]
    cuts = F.percentile_approx(order, shares, 10 * blocks) if shares else F.array()
    found = df.agg(cuts.alias("cuts")).first()["cuts"]
    return sorted(set(found or ()))


def block_of(order: str | Column, bounds: Sequence) -> Column:
    """Number of bounds up to the value, by halving; NULL comes first, like in a sort."""
    value = F.col(order) if isinstance(order, str) else order

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        below = value < F.lit(bounds[middle])
        return F.when(below, within(low, middle)).otherwise(within(middle + 1, high))

    return F.when(value.isNull(), F.lit(-1)).otherwise(within(0, len(bounds)))


def running_total_in_blocks(
    df: DataFrame,
    column: str,
    partition: Sequence[str],
    order: Sequence[str],
    name: str,
    blocks: int = BLOCKS,
) -> DataFrame:
    """``df`` with the sum of all rows up to the current one, NULL until a value occurs.

    Equals ``running_total``, also where one key has most of the rows. The
    first column of ``order`` cuts the blocks; rows of one value of it stay together.
    """
    placed = df.withColumn("_block", block_of(order[0], block_bounds(df, order[0], blocks)))
    by_key = W.partitionBy(*partition).orderBy("_block")
    earlier = F.sum("_sum").over(by_key.rowsBetween(W.unboundedPreceding, -1))
    sums = placed.groupBy(*partition, "_block").agg(F.sum(column).alias("_sum"))
    sums = sums.withColumn("_earlier", earlier).drop("_sum")
    same = F.col("p._block") == F.col("s._block")
    for key in partition:
        same = same & F.col(f"p.{key}").eqNullSafe(F.col(f"s.{key}"))
    joined = placed.alias("p").join(sums.alias("s"), same).select("p.*", "s._earlier")
    within = W.partitionBy(*partition, "_block").orderBy(*order)
    own = F.sum(column).over(within.rowsBetween(W.unboundedPreceding, W.currentRow))
    total = F.when(own.isNull(), F.col("_earlier")).otherwise(own + F.coalesce("_earlier", own - own))
    return joined.withColumn(name, total).drop("_block", "_earlier")


def as_of_join(
    facts: DataFrame,
    versions: DataFrame,
    on: Sequence[str],
    at: str,
    version: str,
    tie_breakers: Sequence[str] = (),
    blocks: int = BLOCKS,
) -> DataFrame:
    """Each fact with the newest version of its key that is not after it, or NULLs.

    Facts and versions are merged in one order per key and block, so the work grows
    with their number and no fact meets a version that it does not get. Of equal
    versions the last by ``tie_breakers`` counts. NULL keys and times match nothing.
    ``versions`` adds its columns other than ``on``.
    """
    added = [c for c in versions.columns if c not in on]
    clash = sorted(set(added) & set(facts.columns))
    if clash:
        raise ValueError(f"facts and versions share the columns {clash}")
    keys = [F.col(key).alias(f"_k{i}") for i, key in enumerate(on)]
    names = [f"_k{i}" for i in range(len(on))]
    usable = F.col(version).isNotNull()
    for key in on:
        usable = usable & F.col(key).isNotNull()
    seen = versions.filter(usable)
    fact_rows = facts.select(
        *keys, F.col(at).alias("_time"), F.lit(1).alias("_side"), F.struct("*").alias("_fact")
    )
    ranked = F.struct(F.col(version).alias("_v"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tie_breakers)])
    version_rows = seen.select(
        *keys,
        F.col(version).alias("_time"),
        F.lit(0).alias("_side"),
        ranked.alias("_rank"),
        F.struct(*added).alias("_version"),
    )
    merged = fact_rows.unionByName(version_rows, allowMissingColumns=True)
    merged = merged.withColumn("_block", block_of("_time", block_bounds(facts, at, blocks)))
    newest = F.max_by("_version", "_rank")
    left = merged.groupBy(*names, "_block").agg(newest.alias("_newest"))
    by_key = W.partitionBy(*names).orderBy("_block")
    carried = F.last("_newest", ignorenulls=True).over(by_key.rowsBetween(W.unboundedPreceding, -1))
    left = left.withColumn("_version", carried).filter(F.col("_version").isNotNull())
    left = left.select(*names, "_block", "_version", F.lit(-1).alias("_side"))
    merged = merged.unionByName(left, allowMissingColumns=True)
    within = W.partitionBy(*names, "_block").orderBy(
        F.when(F.col("_side") == -1, 0).otherwise(1), "_time", "_side", "_rank"
    )
    found = F.last("_version", ignorenulls=True).over(within.rowsBetween(W.unboundedPreceding, W.currentRow))
    matched = merged.withColumn("_found", found).filter(F.col("_side") == 1)
    usable_fact = F.col("_time").isNotNull()
    for key in names:
        usable_fact = usable_fact & F.col(key).isNotNull()
    taken = [F.when(usable_fact, F.col(f"_found.{c}")).alias(c) for c in added]
    return matched.select("_fact.*", *taken)
