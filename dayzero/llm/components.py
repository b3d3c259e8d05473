"""Connected components of a table of links, by alternating star contractions.

Each round first links every node's larger neighbours to its smallest one (large star), then its smaller neighbours and
itself to the smallest of these (small star). The links end as one star per component around its smallest node, after a
number of rounds that grows with the logarithm of the longest chain. A round is a partial aggregate and a join on the
node; a hub with many links is a key of the join whose rows adaptive execution can split. Rounds are written to the shared
folder, so a lost executor costs one round at most and no links pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayzero.llm.common import written


def _starred(links: DataFrame) -> DataFrame:
    """links (node, other) with m, the smallest of a node and its others.

    The join key is negated so that it has an exchange of its own: the aggregate's could not be split at a hub.
    """
    least = links.groupBy("node").agg(F.least(F.min("other"), F.min("node")).alias("m"))
    least = least.select((-F.col("node")).alias("key"), "m")
    return links.withColumn("key", -F.col("node")).join(least, "key").select("node", "other", "m")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of a link; the component is its smallest node. Nodes are longs."""
    links = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("other"))
    links = written(links.distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _starred(both).where(F.col("other") > F.col("node")).select(F.col("other").alias("node"), F.col("m").alias("other"))
        large = written(large.where(F.col("node") != F.col("other")).distinct(), "links")
        small = _starred(large)
        small = small.select(F.col("other").alias("node"), F.col("m").alias("other")).unionByName(
            small.select("node", F.col("m").alias("other"))
        )
        links = written(small.where(F.col("node") != F.col("other")).distinct(), "links")
        state = tuple(
            links.agg(
                F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)")), F.count_distinct("node")
            ).first()
        )
        # One link per node and no node that is both an end and a centre: all are stars.
        if state == before:
            break
        before = state
    return links.select("node", F.col("other").alias("component")).unionByName(
        links.select(F.col("other").alias("node"), F.col("other").alias("component")).distinct()
    )
