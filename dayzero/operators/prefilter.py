"""A raw log reduced to the likely members of a cohort before it is folded and shuffled.

Spark's runtime filters do not reach below the aggregate that folds a log by user. Here the
cohort's users set bits of a bitmap by a hash of their key, and log rows whose bit is not
set are dropped where they are read. What passes by chance is dropped by the exact join
that follows, so results do not change, however many members there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a word of the bitmap, as a power of two.
WORD = 6
MOST_BITS = 26


def likely_members(log: DataFrame, members: DataFrame, key: str = "nid", bits: int = 23) -> DataFrame:
    """Rows of ``log`` whose key is in ``members``, and about one in
    ``2**bits / members`` of the others; rows without a key go.

    The bitmap of ``2**bits`` bits is broadcast as rows of 64 bits: at most
    131,072 rows of two numbers for 23 bits (8 million users or so), eight times that for the largest.
    """
    if not WORD <= bits <= MOST_BITS:
        raise ValueError(f"a bitmap has 2**{WORD} to 2**{MOST_BITS} bits")
    bit = _shift("shiftleft", F.lit(1).cast("long"), _place(key, bits))
    words = members.filter(F.col(key).isNotNull()).select(
        F.shiftright(_place(key, bits), WORD).alias("_member_word"), bit.alias("_bit")
    )
    words = words.groupBy("_member_word").agg(F.bit_or("_bit").alias("_bits"))
    met = F.col(key).isNotNull() & (F.shiftright(_place(key, bits), WORD) == F.col("_member_word"))
    found = log.join(F.broadcast(words), met)
    is_set = _shift("shiftrightunsigned", F.col("_bits"), _place(key, bits)).bitwiseAND(1) == 1
    return found.filter(is_set).drop("_member_word", "_bits")


def _place(key: str, bits: int) -> Column:
    return F.xxhash64(key).bitwiseAND((1 << bits) - 1)


def _shift(name: str, value: Column, place: Column) -> Column:
    return F.call_function(name, value, place.bitwiseAND((1 << WORD) - 1).cast("int"))
