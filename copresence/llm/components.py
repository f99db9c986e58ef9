"""Connected components of a graph that no single machine holds.

Alternating large-star and small-star steps (Kiveris et al., 2014): each replaces the links of a node by links to its smallest
neighbour, until every component is a star. Links are grouped with a map-side minimum and joined back, so that a node with very
many neighbours never meets in one task as a list; each round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copresence.llm.common import cut


def _star(links: DataFrame, larger_only: bool) -> DataFrame:
    """links(a, b): each b goes to the smallest of a and its neighbours, for neighbours larger (or smaller) than a."""
    if larger_only:
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        moved = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b")
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select("m", F.explode(F.array("a", "b")).alias("b")).select(F.col("m").alias("a"), "b")
    return moved.filter("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links(a, b) of any ordered type -> (node, root): the smallest node of each component, for every node that has a link."""
    now = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most_rounds):
        now = cut(_star(_star(now, True), False))
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == (new.n, new.h):
            break
        state = (new.n, new.h)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
