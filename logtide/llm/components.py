"""Connected components from links, by alternating large and small stars.

Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii: Connected components in MapReduce and
beyond (2014). Every round is a hash aggregate and a join over the links; nothing is
collected, and each round's links are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logtide.plans.common import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node next to it, itself included."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b")
    return (
        moved.where("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        .union(least.select(F.col("m").alias("a"), "b")).distinct()
    )


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(
        F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.count_if(F.col("a") >= F.col("b"))
    ).first())


def components(links: DataFrame) -> DataFrame:
    """From links (a < b, distinct) one row (node, component) per linked node but the smallest of each.

    ``component`` is the smallest node that can be reached. No links give no rows.
    """
    links = materialize(links.select("a", "b"), "links")
    state = _state(links)
    while state[0]:
        links = materialize(_small_star(_large_star(links)), "links")
        reached = _state(links)
        if reached == state:
            break
        state = reached
    return links.select(F.col("b").alias("node"), F.col("a").alias("component"))
