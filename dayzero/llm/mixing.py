"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

Each source gets a share of all words by its weight. A target above `max_epochs` times the source's size is cut to that,
and what it gives up is dealt to the others by weight until none is above (solved in one pass over the sources in the
order in which they reach their caps). A source is taken in whole epochs first. What is left of its target is filled
from its documents in the order of exponential keys -ln(u) / w, u a hash of the document's id in (0, 1), w its quality
weight: the documents whose running total stays within the budget are taken. A document that no longer fits is passed
over, and five more passes take later ones of the same range of keys that do. The few words that are then left go to the
source's smallest documents that were not taken, those of one size by their keys, so that in the end a source is short
of its target by less than any document it could still take.

A source's keys are first summed in ranges, so only the one range in which the budget ends is sorted. Its share of the
source falls as the table grows, which keeps a source with a third of all rows from meeting in one task.

Sources are ordered by code point, NULL last, and weights repeat in that order. Null or empty texts have size 0 and are
taken 0 words. A source of size 0 has target 0. Rows with equal ids have equal keys; they are ordered by their size and
text, and equal rows are interchangeable; the last words take all of them or none. An empty table gives an empty result. Input columns are carried in one struct,
so they may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayzero.llm.common import WORD_GAP, word_array, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Documents to a range of keys, on average over the table.
RANGE_ROWS = 1000
#: Ranges of keys at most, as each source's sums are ordered in one task. Beyond, the sorted ranges hold more documents.
MAX_RANGES = 1_000_000
FILL_PASSES = 5


def quality_weight(text: Column) -> Column:
    """0.1 to 1: the share of a text's non-blank characters that are no symbols."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), WORD_GAP, "")
    plain = F.translate(bare, "#*$%&|<>", "")
    return F.coalesce(F.greatest(F.lit(0.1), F.length(plain) / F.nullif(F.length(bare), F.lit(0))), F.lit(1.0))


def exponential_key(id_: Column, weight: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(id_, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: int) -> DataFrame:
    """(source, source_size) to targets, one row per source.

    Sources reach their caps in the order of cap / weight. With the first k of them at their caps, the others get the
    same number of words per weight; a source is at its cap if that number, with those before it cut, is above its own.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    position = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (position + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        ranked.withColumn("words", F.sum("source_size").over(all_rows) * F.lit(share))
        .withColumn("caps", F.sum("cap").over(all_rows))
        .withColumn("rest_caps", F.sum("cap").over(rest))
        .withColumn("rest_weight", F.sum("weight").over(rest))
        .withColumn("level", (F.col("words") - (F.col("caps") - F.col("rest_caps"))) / F.col("rest_weight"))
        .withColumn("cut", F.col("cap") / F.col("weight") <= F.col("level"))
    )
    # Beyond the caps the number falls from source to source, so the largest is that of the first one that is not cut.
    level = F.max(F.when(~F.col("cut"), F.col("level"))).over(all_rows)
    return ranked.select(
        "source",
        "source_size",
        F.when(F.col("cut"), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight"))).alias("target"),
    )


def mix(
    docs: DataFrame,
    carried: list[str],
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.0,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: row (struct of the carried columns), size, source_size, target, copies, taken.

    copies is how often the document is taken, taken is copies * size. The rows are written to the shared folder with their
    sizes and keys, so each text is read and counted once.
    """
    text = F.col(text_col)
    sized = docs.select(
        F.struct(*[F.col(c) for c in carried]).alias("row"),
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.size(word_array(text)).cast("long").alias("size"),
        exponential_key(F.col(id_col), quality_weight(text), seed).alias("key"),
        F.xxhash64(text).alias("tie"),
    )
    sized = written(sized, "mix-sizes")
    ranges = min(MAX_RANGES, max(1, sized.count() // RANGE_ROWS))
    sized = sized.withColumn(
        "range", F.least(F.floor((1 - F.exp(-F.col("key"))) * ranges), F.lit(ranges - 1)).cast("long")
    )
    totals = written(sized.groupBy("source", "range").agg(F.sum("size").alias("words")), "mix-ranges")
    goals = source_targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    goals = goals.withColumn(
        "epochs",
        F.when(F.col("source_size") > 0, F.least(F.lit(max_epochs), F.floor(F.col("target") / F.col("source_size") + 1e-9)))
        .otherwise(0)
        .cast("long"),
    ).withColumn("budget", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0)))
    goals = written(goals, "mix-targets")
    before = F.sum("words").over(Window.partitionBy("source").orderBy("range"))
    ends = (
        totals.withColumn("through", before)
        .join(goals.select(F.col("source").alias("g_source"), "budget"), F.col("source").eqNullSafe(F.col("g_source")))
        .where(F.col("through") > F.col("budget"))
        .groupBy(F.col("source").alias("e_source"))
        .agg(F.min(F.struct("range", (F.col("through") - F.col("words")).alias("before"))).alias("end"))
    )
    plan = written(
        goals.join(ends, F.col("source").eqNullSafe(F.col("e_source")), "left").select(
            F.col("source").alias("g_source"),
            "source_size",
            "target",
            "epochs",
            "budget",
            F.coalesce("end.range", F.lit(ranges)).alias("end_range"),
            F.coalesce("end.before", F.lit(0)).alias("before"),
        ),
        "mix-plan",
    )
    planned = sized.join(plan, F.col("source").eqNullSafe(F.col("g_source")))
    clear = planned.where(F.col("range") != F.col("end_range")).withColumn("chosen", F.col("range") < F.col("end_range"))
    edge = written(_fill(planned.where(F.col("range") == F.col("end_range"))), "mix-edge")
    decided = _top_up(clear.unionByName(edge.select(clear.columns)), edge)
    copies = F.col("epochs") + F.col("chosen").cast("long")
    return decided.select(
        "row",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def _fill(edge: DataFrame) -> DataFrame:
    """Chosen rows of the range of keys in which a source's budget ends."""
    columns = [*edge.columns, "chosen"]
    order = Window.partitionBy("source").orderBy("key", "id", "size", "tie")
    whole = Window.partitionBy("source")
    edge = edge.withColumn("room", F.col("budget") - F.col("before")).withColumn("chosen", F.lit(False))
    for _ in range(1 + FILL_PASSES):
        fits = ~F.col("chosen") & (F.col("size") <= F.col("room"))
        edge = edge.withColumn("total", F.sum(F.when(fits, F.col("size")).otherwise(0)).over(order))
        new = fits & (F.col("total") <= F.col("room"))
        edge = edge.withColumn("new", new)
        edge = edge.withColumn("room", F.col("room") - F.sum(F.when(F.col("new"), F.col("size")).otherwise(0)).over(whole))
        edge = edge.withColumn("chosen", F.col("chosen") | F.col("new"))
    return edge.select(*columns, "room")


def _top_up(rows: DataFrame, edge: DataFrame) -> DataFrame:
    """rows with the smallest documents chosen that fit into what is left of their source's budget.

    Sizes are counted first: all documents below some size fit, and of that size so many. These are the first by their
    keys, of which each task keeps no more than any source can need.
    """
    rooms = edge.groupBy(F.col("source").alias("t_source")).agg(F.min("room").alias("room")).where("room >= 1")
    rooms = written(rooms, "mix-rooms")
    same = F.col("source").eqNullSafe(F.col("t_source"))
    open_ones = rows.where("not chosen and size > 0").select("source", "size", "key", "id", "tie")
    open_ones = open_ones.join(rooms, same).where(F.col("size") <= F.col("room")).drop("t_source")
    sizes = open_ones.groupBy("source", "room", "size").agg(F.sum("size").alias("words"))
    sizes = sizes.withColumn("through", F.sum("words").over(Window.partitionBy("source").orderBy("size")))
    beyond = sizes.where(F.col("through") > F.col("room")).groupBy("source", "room").agg(
        F.min(F.struct("size", (F.col("through") - F.col("words")).alias("below"))).alias("at")
    )
    beyond = beyond.select(
        F.col("source").alias("b_source"),
        F.col("at.size").alias("b_size"),
        F.floor((F.col("room") - F.col("at.below")) / F.col("at.size")).cast("long").alias("many"),
    )
    beyond = written(beyond, "mix-sizes-left")
    most = beyond.agg(F.max("many")).first()[0] or 0
    last = open_ones.join(beyond, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")))
    last = last.groupBy("source", "many", "key", "id", "tie").agg(F.count("*").alias("n"))
    by_key = Window.partitionBy("source").orderBy("key", "id", "tie")
    last = last.withColumn("nth", F.row_number().over(by_key)).where(F.col("nth") <= F.lit(most))
    last = last.withColumn("through", F.sum("n").over(by_key)).where(F.col("through") <= F.col("many"))
    last = last.groupBy(F.col("source").alias("l_source")).agg(F.max(F.struct("key", "id", "tie")).alias("last"))
    limits = rooms.join(beyond, F.col("t_source").eqNullSafe(F.col("b_source")), "left")
    limits = limits.join(last, F.col("t_source").eqNullSafe(F.col("l_source")), "left")
    limits = written(limits.select("t_source", "room", "b_size", "last"), "mix-limits")
    limits = limits.withColumnRenamed("room", "t_room")
    small = F.col("size") < F.coalesce("b_size", F.floor("t_room") + 1)
    first = (F.col("size") == F.col("b_size")) & (F.struct("key", "id", "tie") <= F.col("last"))
    fits = F.coalesce(~F.col("chosen") & (F.col("size") > 0) & (small | F.coalesce(first, F.lit(False))), F.lit(False))
    # Few sources have room left; the others have no limits.
    joined = rows.join(limits, same, "left")
    return joined.withColumn("chosen", F.col("chosen") | (fits & F.col("t_room").isNotNull())).select(*rows.columns)
