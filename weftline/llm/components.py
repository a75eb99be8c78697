"""Connected components of a link table by alternating large-star and small-star steps.

Each step points nodes at the smallest node they know of; the number of rounds grows with the logarithm
of the number of nodes. All steps are joins and aggregations of the link table: a node with very many
links is aggregated where its rows are before any shuffle, and its rows may be split in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import checkpointed

MOST_ROUNDS = 60


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) to (node, component): the smallest node reachable, for each linked node."""
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = checkpointed(links)
    before = _state(links)
    for _ in range(MOST_ROUNDS if before[0] else 0):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = checkpointed(small.distinct())
        after = _state(links)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
