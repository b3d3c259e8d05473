"""Histogram of the minutes between two events of a user."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayzero.constants import MINUTE_CAP
from dayzero.functions.labels import minutes_label

DAY_MINUTES = 1440
# Bits per word of a bitmap, and words for the clock minutes and their differences.
WORD = 6
BITS = 1 << WORD
CLOCK_WORDS = -(-DAY_MINUTES // BITS)
GAP_WORDS = 2 * CLOCK_WORDS


def minutes_between_hist(
    starts: DataFrame,
    ends: DataFrame,
    cap: int = MINUTE_CAP,
    over_label: str | None = None,
) -> DataFrame:
    """Users by whole minutes from a start to an end event of the same day
    (``nid``, ``_i_t`` on both sides); minutes beyond ``cap`` share one label.
    """
    both = _clock_minutes(starts, START).unionByName(_clock_minutes(ends, END))
    days = both.groupBy("nid", "day").agg(F.collect_list("clock").alias("clocks"))
    complete = F.exists("clocks", lambda c: c.kind == START) & F.exists(
        "clocks", lambda c: c.kind == END
    )
    gaps = days.filter(complete).select(
        "nid", F.explode(_gaps_of_clocks(starts.sparkSession.sparkContext)).alias("minutes")
    )
    minutes = gaps.groupBy("minutes").agg(F.count_distinct("nid").alias("users"))
    return (
        minutes.groupBy(minutes_label("minutes", cap, over_label).alias("min_time"))
        .agg(F.sum("users").alias("UU"))
        .orderBy("min_time")
    )


START, END = 0, 1


def _clock_minutes(events: DataFrame, kind: int) -> DataFrame:
    """First and last microsecond within each clock minute of a user's day.

    All pairs of two clock minutes differ by one of two minute counts, decided
    by the closest and the farthest pair, so the events in between change
    nothing.  A user then has at most 2,880 rows a day, whatever they logged.
    """
    day = F.to_date("_i_t")
    midnight = F.to_timestamp_ntz(day)
    micros = F.timestamp_diff("MICROSECOND", midnight, F.col("_i_t").cast("timestamp_ntz"))
    timed = events.select("nid", day.alias("day"), micros.alias("micros"))
    timed = timed.filter(F.col("nid").isNotNull() & F.col("day").isNotNull())
    minute = F.expr("micros div 60000000").cast("int")
    second = F.col("micros") % 60_000_000
    folded = timed.groupBy("nid", "day", minute.alias("minute")).agg(
        F.min(second).alias("low"), F.max(second).alias("high")
    )
    return folded.select(
        "nid", "day", F.struct(F.lit(kind).alias("kind"), "minute", "low", "high").alias("clock")
    )


@lru_cache(maxsize=1)
def _gaps_of_clocks(context: SparkContext) -> Column:
    """The expression is long and always the same, so it is put together once per Spark context."""
    return _minute_gaps(F.col("clocks"))


def _minute_gaps(clocks: Column) -> Column:
    """The distinct whole minutes, cut toward zero, from any start to any end.

    Clock minutes ``d`` apart are ``d`` whole minutes apart if the end is not
    earlier within its minute than the start, else ``d - 1``; where the end
    comes first it is ``d + 1`` if the end is later within its minute, else
    ``d``.  So four sets of ``d`` are wanted, by how the two compare.
    """
    later = _gap_bits(clocks, end="high", start="low", falling=True, ends_first=True)
    earlier = _gap_bits(clocks, end="low", start="high", falling=False, ends_first=False)
    really_later = _gap_bits(clocks, end="high", start="low", falling=True, ends_first=False)
    not_later = _gap_bits(clocks, end="low", start="high", falling=False, ends_first=True)
    return F.array_distinct(
        F.concat(
            F.filter(later, lambda d: d >= 0),
            F.transform(F.filter(earlier, lambda d: d >= 0), lambda d: F.greatest(d - 1, F.lit(0))),
            F.transform(F.filter(really_later, lambda d: d < 0), lambda d: d + 1),
            F.filter(not_later, lambda d: d < 0),
        )
    )


def _gap_bits(clocks: Column, end: str, start: str, falling: bool, ends_first: bool) -> Column:
    """Distances in clock minutes of the pairs whose end is ordered before their start.

    The clock minutes of both kinds are sorted by their place within the minute
    (falling: an end that is later comes first; ``ends_first`` lets ties count).
    Ends are gathered in a bitmap of the day's minutes as the list goes on; a start
    shifts the bitmap of the ends so far by its own minute, which gives its
    distances to all of them at once, and adds it to the result.  A user with events in all minutes
    costs 2,880 steps on bitmaps instead of two million pairs.
    """
    sign = -1 if falling else 1

    def placed(c: Column) -> Column:
        is_end = c.kind == END
        place = F.when(is_end, c[end]).otherwise(c[start]) * sign
        turn = F.when(is_end, F.lit(0 if ends_first else 1)).otherwise(F.lit(1 if ends_first else 0))
        return F.struct(
            place.alias("place"), turn.alias("turn"), c.minute.alias("minute"), is_end.alias("is_end")
        )

    def empty(n: int) -> Column:
        return F.array_repeat(F.lit(0).cast("long"), n)

    def step(state: Column, c: Column) -> Column:
        bit = _shift_left(F.lit(1).cast("long"), c.minute.bitwiseAND(BITS - 1))
        with_end = F.transform(
            state.ends,
            lambda word, i: F.when(i == F.shiftright(c.minute, WORD), word.bitwiseOR(bit)).otherwise(word),
        )
        with_gaps = F.transform(
            state.gaps, lambda word, i: word.bitwiseOR(_shifted_word(state.ends, DAY_MINUTES - c.minute, i))
        )
        return F.when(
            c.is_end, F.struct(with_end.alias("ends"), state.gaps.alias("gaps"))
        ).otherwise(F.struct(state.ends.alias("ends"), with_gaps.alias("gaps")))

    first = F.struct(empty(CLOCK_WORDS).alias("ends"), empty(GAP_WORDS).alias("gaps"))
    ordered = F.array_sort(F.transform(clocks, placed))
    return F.aggregate(ordered, first, step, lambda state: _positions(state.gaps))


def _shift_left(word: Column, by: Column) -> Column:
    return F.call_function("shiftleft", word, by)


def _shifted_word(words: Column, by: Column, i: Column) -> Column:
    """Word ``i`` of a bitmap that is shifted to higher places."""
    whole, part = F.shiftright(by, WORD), by.bitwiseAND(BITS - 1)
    nothing = F.lit(0).cast("long")
    high = _shift_left(F.coalesce(F.get(words, i - whole), nothing), part)
    below = F.coalesce(F.get(words, i - whole - 1), nothing)
    low = F.call_function("shiftrightunsigned", below, F.lit(BITS) - part)
    return F.when(part == 0, high).otherwise(high.bitwiseOR(low))


def _positions(words: Column) -> Column:
    """Places of the bits that are set, as distances in clock minutes."""
    none = F.array().cast("array<int>")
    bits = F.sequence(F.lit(0), F.lit(BITS - 1))

    def within(word: Column, i: Column) -> Column:
        found = F.filter(bits, lambda bit: F.bit_get(word, bit) == 1)
        return F.when(word == 0, none).otherwise(
            F.transform(found, lambda bit: i * BITS + bit - DAY_MINUTES)
        )

    return F.flatten(F.transform(words, within))
