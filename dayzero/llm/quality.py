"""Quality rules: counts of a text, two fixed limits, and robust multivariate outliers per language and source.

The outliers are found by minimum covariance determinant. Each document's counts become a vector of six transformed
rates. For each language and source a centre and covariance are fitted to the half of its different texts that lie
closest together, so junk that is alike may hold any smaller part: from the medians, with quartile ranges, median
deviations or the floors as spreads, by concentration steps (fit, measure, keep the closest) until the determinant no
longer falls; a warning counts the starts that MAX_STEPS steps did not settle. Of the three the fit with the smallest
determinant is refitted once to all texts within the 97.5 % distance. Equal texts count once. A document is rejected if
its squared Mahalanobis distance is above `cutoff`. A floor is added to each variance, so a rate that hardly varies does
not make harmless texts outliers. One repeated line, and the words of one, are excused: clean texts may open and close
with the same line. A text of which 40 % of the lines are repeated goes wherever other texts repeat none.

Every step is one aggregate: documents are counted with their moments in ranges of distance, and the ranges are summed
from the closest on. A language and source with a third of all documents sends a few hundred rows per task.

Documents that fail a fixed limit are rejected and fit nothing. A source with fewer than `min_group` other documents of
a language is pooled with the like ones of that language, those pools that are still smaller with each other; if even
that is smaller, its documents pass. NULL is a language or source of its own.

Null or empty texts have no words and are rejected. Equal rows get equal results; an empty table gives an empty result.
Input columns are carried in one struct, so they may have any names.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayzero.llm.common import WORD_GAP, let, word_array, written

log = logging.getLogger(__name__)

WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"

SUBSET = 0.5
#: Most concentration steps, and the fall of the logarithm of the determinant's root that still counts as one.
MAX_STEPS, FALL = 12, 1e-6
MIN_GROUP = 50
#: Squared distance above which a document is rejected; the chi-squared law with 6 degrees exceeds it once in 10 million.
CUTOFF = 45.0
#: Standard deviations that are added, in the order of vector(). Each is small enough for its rate alone to reject a text.
FLOORS = (0.06, 0.04, 0.09, 0.05, 0.06, 0.1)
#: Repeated lines and repeated words that do not count: one line, and two times the words of a long one.
EXCUSED_LINES, EXCUSED_WORDS = 1, 24
PRIOR, PRIOR_CHARS = 10, 5
DIMS = range(len(FLOORS))


def n_repeat_words(words: Column, width: int = WINDOW_WORDS) -> Column:
    """Words in windows of `width` words that occur twice or more in the text."""

    def covered(starts: Column) -> Column:
        last = F.size(starts) - 1
        steps = F.transform(
            starts,
            lambda at, i: F.when(i == last, F.lit(width)).otherwise(F.least(F.lit(width), F.get(starts, i + 1) - at)),
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    def repeated(ordered: Column) -> Column:
        """Starts of windows that have an equal neighbour in the order of their hashes."""
        same = F.transform(
            ordered,
            lambda own, i: F.when(
                ((i > 0) & (F.get(ordered, i - 1)["window"] == own["window"]))
                | F.coalesce(F.get(ordered, i + 1)["window"] == own["window"], F.lit(False)),
                own["start"],
            ),
        )
        return let(F.sort_array(F.array_compact(same)), covered)

    def counted(windows: Column) -> Column:
        starts = F.transform(windows, lambda window, i: F.struct(window.alias("window"), i.cast("long").alias("start")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(starts), repeated)
        )

    def of_hashes(hashes: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - width),
            lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]),
        )
        return F.when(F.size(hashes) <= width, F.lit(0).cast("long")).otherwise(let(windows, counted))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def text_counts(text: Column) -> Column:
    """Struct of n_words, n_repeat_words, n_stutters (words equal to the one before), word_chars, n_symbols, n_lines, n_dup_lines and n_letters."""
    text = F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(text, WORD_GAP, "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    of_words = let(
        word_array(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            n_repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda own, i: (i > 0) & (F.get(w, i - 1) == own))).cast("long").alias("n_stutters"),
        ),
    )
    of_lines = let(
        lines,
        lambda found: F.struct(
            F.size(found).cast("long").alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        ),
    )
    of_chars = let(
        bare,
        lambda b: F.struct(
            F.length(b).cast("long").alias("word_chars"),
            (F.length(b) - F.length(F.translate(b, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.length(F.regexp_replace(b, r"\P{L}+", "")).cast("long").alias("n_letters"),
        ),
    )
    return F.struct(of_words.alias("words"), of_lines.alias("lines"), of_chars.alias("chars"))


def vector() -> list[Column]:
    """Log word length; roots of the rates of symbols, repeated lines, repeated words, other signs and stutters.

    Each rate is taken as if some plain text were added, because the rates of a short text scatter: PRIOR words of
    PRIOR_CHARS characters each, or one line.
    """
    added = {"word_chars": PRIOR * PRIOR_CHARS, "n_words": PRIOR, "n_lines": 1}

    def root(part: str, whole: str, excused: int = 0) -> Column:
        return F.sqrt(F.greatest(F.col(part) - excused, F.lit(0)) / (F.col(whole) + added[whole]))

    return [
        F.log((F.col("word_chars") + added["word_chars"]) / (F.col("n_words") + added["n_words"])),
        root("n_symbols", "word_chars"),
        root("n_dup_lines", "n_lines", EXCUSED_LINES),
        root("n_repeat_words", "n_words", EXCUSED_WORDS),
        root("n_others", "word_chars"),
        root("n_stutters", "n_words"),
    ]


def count_documents(docs: DataFrame, carried: list[str], text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """row, text_hash, lang, source, the counts, base_failed and the vector x0.. of every row."""
    counted = docs.select(
        F.struct(*[F.col(c) for c in carried]).alias("row"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.col(lang_col).alias("lang"),
        F.col(source_col).alias("source"),
        text_counts(F.col(text_col)).alias("counts"),
    ).select("row", "text_hash", "lang", "source", "counts.words.*", "counts.lines.*", "counts.chars.*")
    counted = counted.withColumn("n_others", F.col("word_chars") - F.col("n_letters") - F.col("n_symbols"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumns({f"x{i}": x for i, x in enumerate(vector())})


def chi2_below(x: float, degrees: int) -> float:
    """Share of the chi-squared law below x, by the series of the incomplete gamma function."""
    a, x = degrees / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi2_quantile(share: float, degrees: int) -> float:
    low, high = 1e-9, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, degrees) < share else (low, mid)
    return low


def consistency(share: float, degrees: int) -> float:
    """What the covariance of the closest share of a normal sample falls short by."""
    return share / chi2_below(chi2_quantile(share, degrees), degrees + 2)


def _groups(rows: DataFrame, min_group: int) -> DataFrame:
    """g_lang, g_source, gid and whether the group is large enough, of every language and source."""
    sizes = rows.groupBy("lang", "source").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n"))
    own = F.col("n") >= min_group
    of_lang = F.sum(F.when(~own, F.col("n"))).over(Window.partitionBy("lang"))
    level = F.when(own, 0).when(of_lang >= min_group, 1).otherwise(2)
    sizes = sizes.withColumn("level", level)
    gid = (
        F.when(F.col("level") == 0, F.xxhash64(F.lit(0), "lang", "source"))
        .when(F.col("level") == 1, F.xxhash64(F.lit(1), "lang"))
        .otherwise(F.lit(0))
    )
    rest = F.sum(F.when(F.col("level") == 2, F.col("n"))).over(Window.partitionBy("level"))
    return sizes.select(
        F.col("lang").alias("g_lang"),
        F.col("source").alias("g_source"),
        gid.alias("gid"),
        ((F.col("level") < 2) | (rest >= min_group)).alias("fitted"),
    )


def _start(rows: DataFrame) -> DataFrame:
    """First centres and spreads, to the nearest 0.005: medians, and one start each for three spreads of each number.

    A third of alike documents moves a quartile, but not the median of the deviations; the floors alone are the third.
    """
    steps = 200
    pieces = rows.select("gid", F.posexplode(F.array(*[F.round(F.col(f"x{i}") * steps) for i in DIMS])).alias("dim", "bin"))
    bins = pieces.groupBy("gid", "dim", "bin").agg(F.count("*").alias("n"))

    def quantile(share: float) -> Column:
        return F.min(F.when(F.col("through") >= share * F.col("total"), F.col("bin"))) / steps

    def placed(bins: DataFrame) -> DataFrame:
        through = F.sum("n").over(Window.partitionBy("gid", "dim").orderBy("bin"))
        total = F.sum("n").over(Window.partitionBy("gid", "dim"))
        return bins.withColumn("through", through).withColumn("total", total)

    quartiles = placed(bins).groupBy("gid", "dim").agg(
        quantile(0.5).alias("middle"), ((quantile(0.75) - quantile(0.25)) / 1.349).alias("spread0")
    )
    off = bins.join(quartiles, ["gid", "dim"]).withColumn("bin", F.abs(F.col("bin") - F.round(F.col("middle") * steps)))
    off = placed(off.groupBy("gid", "dim", "bin").agg(F.sum("n").alias("n")))
    off = off.groupBy("gid", "dim").agg((quantile(0.5) / 0.6745).alias("spread1"))
    starts = quartiles.join(off, ["gid", "dim"]).select(
        "gid", "dim", "middle", F.posexplode(F.array("spread0", "spread1", F.lit(0.0))).alias("start", "spread")
    )
    out = []
    for i, floor in enumerate(FLOORS):
        own = F.col("dim") == i
        out.append(F.max(F.when(own, F.col("middle"))).alias(f"m{i}"))
        out.append(F.sqrt(F.max(F.when(own, F.col("spread") * F.col("spread"))) + floor * floor).alias(f"l{i}_{i}"))
    return starts.groupBy("gid", "start").agg(*out).withColumns({f"l{i}_{j}": F.lit(0.0) for i in DIMS for j in range(i)})


def _size() -> Column:
    """Logarithm of the root of a fit's determinant."""
    return F.round(sum((F.log(F.col(f"l{i}_{i}")) for i in DIMS), F.lit(0.0)), 9)


def _numbers(fits: DataFrame) -> list[str]:
    return [c for c in fits.columns if c not in ("gid", "start", "size", "fell")]


def _best(fits: DataFrame) -> DataFrame:
    """Each group's fit with the smallest determinant; starts that end alike are taken in their order."""
    best = fits.groupBy("gid").agg(F.min_by(F.struct(*_numbers(fits)), F.struct(_size(), "start")).alias("best"))
    return best.select("gid", "best.*")


def _settled(vectors: DataFrame) -> DataFrame:
    """Fits of each group and start, after steps that each make some determinant fall."""
    first = written(_start(vectors), "quality-fits")
    fits = written(_fit(_measured(vectors, first), SUBSET, None, 1.0).withColumn("fell", F.lit(True)), "quality-fits")
    for _ in range(MAX_STEPS - 1):
        # Written before they are compared: the nested expressions of the factor would be planned again in each use.
        after = written(_fit(_measured(vectors, fits.drop("fell")), SUBSET, None, 1.0), "quality-fits")
        numbers = _numbers(after)
        before = fits.select(F.col("gid").alias("b_gid"), F.col("start").alias("b_start"), F.struct(*numbers).alias("b"), _size().alias("b_size"))
        after = after.select("gid", "start", F.struct(*numbers).alias("a"), _size().alias("a_size"))
        both = after.join(before, (F.col("gid") == F.col("b_gid")) & (F.col("start") == F.col("b_start")))
        fell = F.col("a_size") < F.col("b_size") - FALL
        fits = both.select("gid", "start", F.when(fell, F.col("a")).otherwise(F.col("b")).alias("f"), fell.alias("fell"))
        fits = written(fits.select("gid", "start", "f.*", "fell"), "quality-fits")
        falling = fits.where("fell").count()
        if not falling:
            break
    else:
        log.warning("%d starts of the quality fit still improve after %d steps", falling, MAX_STEPS)
    return fits.drop("fell")


def _measured(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """rows with d2, the squared distance from their group's centre, by forward substitution in the Cholesky factor.

    Once for each start, if the fits are of several.
    """
    rows = rows.join(fits.withColumnRenamed("gid", "f_gid"), F.col("gid") == F.col("f_gid"), "left")
    for i in DIMS:
        left = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            left = left - F.col(f"l{i}_{j}") * F.col(f"z{j}")
        rows = rows.withColumn(f"z{i}", left / F.col(f"l{i}_{i}"))
    squares = [F.col(f"z{i}") * F.col(f"z{i}") for i in DIMS]
    rows = rows.withColumn("d2", sum(squares[1:], squares[0]))
    return rows.drop("f_gid", *[f"z{i}" for i in DIMS], *[c for c in fits.columns if c not in ("gid", "start")])


def _fit(measured: DataFrame, share: float | None, within: float | None, scale: float) -> DataFrame:
    """Centre and Cholesky factor of each group's documents: its closest share, or those within a distance."""
    keys = [c for c in ("gid", "start") if c in measured.columns]
    pairs = [(i, j) for i in DIMS for j in range(i + 1)]
    if within is None:
        rows = measured.withColumn("range", F.floor(F.log1p("d2") * 20))
    else:
        rows = measured.where(F.col("d2") <= within).withColumn("range", F.lit(0))
    sums = {"n": F.count("*").cast("double")}
    sums |= {f"s{i}": F.sum(f"x{i}") for i in DIMS}
    sums |= {f"q{i}_{j}": F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs}
    ranges = rows.groupBy(*keys, "range").agg(*[c.alias(k) for k, c in sums.items()])
    if share is not None:
        nearer = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        total = F.sum("n").over(Window.partitionBy(*keys))
        ranges = ranges.select(*keys, "range", total.alias("total"), *[F.sum(k).over(nearer).alias(k) for k in sums])
        enough = ranges.where(F.col("n") >= share * F.col("total"))
        ranges = enough.groupBy(*keys).agg(F.min_by(F.struct(*sums), "range").alias("first")).select(*keys, "first.*")
    fit = ranges.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in DIMS})
    for i, j in pairs:
        cov = (F.col(f"q{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * scale
        if i == j:
            cov = F.greatest(cov, F.lit(0.0)) + FLOORS[i] ** 2
        for k in range(j):
            cov = cov - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        # The floors keep the matrix positive; the bound only meets rounding.
        fit = fit.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(cov, F.lit(1e-8))) if i == j else cov / F.col(f"l{j}_{j}"))
    return fit.select(*keys, *[f"m{i}" for i in DIMS], *[f"l{i}_{j}" for i, j in pairs])


def judge_quality(
    docs: DataFrame,
    carried: list[str],
    cutoff: float = CUTOFF,
    min_group: int = MIN_GROUP,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """row (struct of the carried columns), the counts, base_failed, distance (squared; null if not fitted) and kept."""
    counted = written(count_documents(docs, carried, text_col, lang_col, source_col), "quality-counts")
    groups = written(_groups(counted, min_group), "quality-groups")
    known = counted.join(
        groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    ).drop("g_lang", "g_source")
    different = known.where(~F.col("base_failed") & F.col("fitted")).dropDuplicates(["gid", "text_hash"])
    vectors = written(different.select("gid", *[f"x{i}" for i in DIMS]), "quality-vectors")
    scale = consistency(SUBSET, len(FLOORS))
    fits = written(_fit(_measured(vectors, _settled(vectors)), SUBSET, None, scale), "quality-fits")
    fits = written(_best(fits), "quality-fits")
    near = chi2_quantile(0.975, len(FLOORS))
    fits = written(_fit(_measured(vectors, fits), None, near, consistency(0.975, len(FLOORS))), "quality-fits")
    judged = _measured(known, fits)
    distance = F.when(F.col("fitted") & ~F.col("base_failed"), F.col("d2"))
    return judged.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        distance.alias("distance"),
        (~F.col("base_failed") & F.coalesce(distance <= cutoff, F.lit(True))).alias("kept"),
    )
