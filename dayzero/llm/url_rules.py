"""URL filter: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

A rule is a host and a path. It fits the host and its subdomains if the url's path starts with the rule's path; the
longest rule that fits decides. Each url is expanded into the expressions (host suffix, path up to a slash) that a rule
could have, at most (labels of the longest rule host) x (slashes of the deepest rule path) of them. Expressions meet
rules on the first four bytes of a digest; the full digest and the full path prefix confirm.

Nulls and odd rows: a null url, or one without "://", has an empty host and path and fits no rule, so it gets the
default verdict. Repeated rows are judged alike and all returned. An empty table gives an empty result. Only the id and
url columns are read, so other columns may have any names. Rules with a null host or path fit nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayzero.llm.common import ascii_lower


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.substring_index(_bare(url), "/", 1)), F.lit(""))


def _bare(url: Column) -> Column:
    """Host and path: what follows the first "://", up to a query or fragment."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.substring_index(F.substring_index(rest, "?", 1), "#", 1)


def path_of(url: Column) -> Column:
    bare = _bare(url)
    return F.coalesce(F.when(F.instr(bare, "/") > 0, F.substring(bare, F.instr(bare, "/"), F.length(bare))), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as (verdict, host, path)."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _folder(path: Column) -> Column:
    """Path up to its last slash: the part of a rule that is looked up."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """id, host, path, rule (null if none fits) and verdict of every row.

    Rules that are equally long are ordered: the longer host wins, then "block".
    """
    known = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        ascii_lower(F.col("host")).alias("r_host"),
        F.col("path").alias("r_path"),
        F.col("verdict").alias("r_verdict"),
    )
    known = known.withColumn("r_digest", _digest(F.col("r_host"), _folder(F.col("r_path"))))
    known = known.withColumn("r_prefix", _prefix(F.col("r_digest")))
    # Two numbers: no rule has more labels or slashes, so longer expressions cannot fit any.
    deepest = known.agg(
        F.max(F.size(F.split("r_host", r"\."))).alias("labels"),
        F.max(F.length("r_path") - F.length(F.replace("r_path", F.lit("/"), F.lit("")))).alias("slashes"),
    ).first()
    labels, slashes = max(deepest["labels"] or 1, 1), max(deepest["slashes"] or 0, 0)

    seen = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    sites = seen.select("host", "path").distinct()
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in range(1, labels + 1)]))
    folders = F.array_distinct(
        F.array(F.lit(""), *[F.concat(F.substring_index("path", "/", n), F.lit("/")) for n in range(1, slashes + 1)])
    )
    asked = (
        sites.withColumn("suffix", F.explode(suffixes))
        .withColumn("folder", F.explode(folders))
        .where(F.startswith("path", "folder"))
        .withColumn("digest", _digest(F.col("suffix"), F.col("folder")))
        .withColumn("prefix", _prefix(F.col("digest")))
    )
    fits = asked.join(known, F.col("prefix") == F.col("r_prefix")).where(
        (F.col("digest") == F.col("r_digest")) & F.startswith("path", "r_path")
    )
    best = (
        fits.groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    (F.length("r_host") + F.length("r_path")).alias("long"),
                    F.length("r_host").alias("long_host"),
                    (F.col("r_verdict") == "block").alias("hard"),
                    F.concat("r_host", "r_path").alias("rule"),
                    F.col("r_verdict").alias("verdict"),
                )
            ).alias("best")
        )
        .select(
            F.xxhash64("host", "path").alias("b_key"),
            F.col("host").alias("b_host"),
            F.col("path").alias("b_path"),
            F.col("best.rule").alias("rule"),
            F.col("best.verdict").alias("verdict"),
        )
    )
    # The hash is a key of its own, so a url with many rows reaches the join in a fresh exchange that can be split.
    return (
        seen.withColumn("key", F.xxhash64("host", "path"))
        .join(best, (F.col("key") == F.col("b_key")) & (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left")
        .select(id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    )
